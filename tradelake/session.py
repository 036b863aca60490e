"""Session settings and the shared work folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

# Settings every job here relies on. All of them can be set on a live session.
# The lookup joins carry no broadcast hint: the planner compares the measured
# size of a side with autoBroadcastJoinThreshold and falls back to a shuffled
# join (which AQE splits when a key is hot) beyond it.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.optimizer.dynamicPartitionPruning.enabled": "true",
}

_local_folder: str | None = None


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session made elsewhere."""
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: str = "*", memory: str = "8g", **settings: str) -> SparkSession:
    """A single-JVM session for tests and the bench. Clusters bring their own."""
    n = os.cpu_count() if cores == "*" else int(cores)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tradelake")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(n))
    )
    for key, value in {**RUNTIME_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def side_by_side(spark: SparkSession, *tasks: Callable[[], object]) -> list:
    """Results of independent tasks, whose jobs run at the same time; the first failure is raised.

    For work on different tables: short jobs leave most executors idle.
    """
    with ThreadPoolExecutor(max(1, len(tasks))) as pool:
        runs = [pool.submit(inheritable_thread_target(spark)(task)) for task in tasks]
        return [run.result() for run in runs]


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder for written intermediate tables.

    It lies under spark.checkpoint.dir, which every executor can reach. Only a
    local session without that setting falls back to a folder on this machine.
    """
    global _local_folder
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        if _local_folder is None:
            _local_folder = tempfile.mkdtemp(prefix="tradelake-")
            atexit.register(shutil.rmtree, _local_folder, ignore_errors=True)
        base = _local_folder
    return f"{base.rstrip('/')}/tradelake/{purpose}-{uuid.uuid4().hex[:12]}"
