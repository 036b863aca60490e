import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
for folder in (ROOT, ROOT / "tests"):
    if str(folder) not in sys.path:
        sys.path.insert(0, str(folder))


@pytest.fixture(scope="session")
def spark():
    from tradelake.session import local_session

    return local_session("4", "6g", **{"spark.sql.shuffle.partitions": "4"})


@pytest.fixture
def store(spark):
    from tradelake.operators.store import TableStore
    from tradelake.session import work_folder

    return TableStore(spark, work_folder(spark, "test"))


@pytest.fixture
def now():
    from pyspark.sql import functions as F

    return F.lit("2024-05-01 00:00:00").cast("timestamp")
