import csv
import io
import random

import pytest

from tradelake.sources import quoted_csv


@pytest.fixture
def small_splits(spark):
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "90")
    yield spark
    spark.conf.set(name, before)


def written(rows, ending="\n"):
    out = io.StringIO()
    csv.writer(out, lineterminator=ending).writerows(rows)
    return out.getvalue()


def got(spark, path):
    """Records of each file in order, as the reader places them."""
    out = {}
    for r in sorted(quoted_csv.read(spark, path).collect(), key=lambda r: (r["_file"], r["_block"], r["_pos"])):
        out.setdefault(r["_file"].rsplit("/", 1)[1], []).append([r["a"], r["b"], r["c"]])
    return out


def cell(rng):
    parts = ["x", "long word ", ",", "\n", '"', "\n\n", "é", " ", "7", "\r\n", "\t"]
    return "".join(rng.choice(parts) for _ in range(rng.choice([1, 2, 5, 12]))) + "."


@pytest.mark.parametrize("seed", range(6))
def test_records_equal_the_csv_module(small_splits, tmp_path, seed):
    rng = random.Random(seed)
    want = {}
    for name in ("a.csv", "b.csv"):
        rows = [[f"{k}", cell(rng), cell(rng)] for k in range(rng.choice([1, 30, 60]))]
        if seed % 2:
            rows[len(rows) // 2][1] = "many\nlines\n" * 60 + "end"  # over many splits
        (tmp_path / name).write_text(written([["a", "b", "c"], *rows]), newline="")
        want[name] = rows
    assert got(small_splits, str(tmp_path)) == want


def test_places_are_dense_and_tasks_read_splits(small_splits, tmp_path):
    rows = [[str(k), "one\ntwo", "z"] for k in range(80)]
    (tmp_path / "a.csv").write_text("﻿" + written([["a", "b", "c"], *rows], "\r\n"), newline="")
    records = quoted_csv.records(small_splits, str(tmp_path)).collect()
    assert sorted(r["_number"] for r in records) == list(range(1, 82))
    blocks = {}
    for r in records:
        blocks.setdefault(r["_block"], []).append(r["_pos"])
    assert len(blocks) > 8 and all(sorted(p) == list(range(len(p))) for p in blocks.values())
    assert got(small_splits, str(tmp_path))["a.csv"] == rows


def test_blank_lines_are_no_records(small_splits, tmp_path):
    (tmp_path / "a.csv").write_text('a,b,c\n\n1,"x\n\n  \ny",2\n  \n\t\r\n3,,"" \n\n')
    records = quoted_csv.records(small_splits, str(tmp_path)).orderBy("_number").collect()
    assert [r["text"] for r in records] == ["a,b,c", '1,"x\n\n  \ny",2', '3,,"" ']


def test_unpaired_quotes_are_an_error(small_splits, tmp_path):
    (tmp_path / "a.csv").write_text('a,b,c\n1,"open,2\n3,4,5\n')
    with pytest.raises(Exception, match="quotes do not pair up"):
        quoted_csv.read(small_splits, str(tmp_path)).collect()


def test_files_share_a_header(small_splits, tmp_path):
    (tmp_path / "a.csv").write_text("a,b,c\n1,2,3\n")
    (tmp_path / "b.csv").write_text("a,c,b\n1,2,3\n")
    with pytest.raises(Exception, match="another header"):
        quoted_csv.read(small_splits, str(tmp_path)).collect()


def test_lines_meet_once(small_splits, tmp_path):
    (tmp_path / "a.csv").write_text(written([["a", "b", "c"], *[[str(k), "p\nq", "r"] for k in range(50)]]))
    df = quoted_csv.read(small_splits, str(tmp_path))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    by_split = [line for line in plan.splitlines() if "Exchange hashpartitioning(_file" in line and "_block" in line]
    assert sum("ReusedExchange" not in line for line in by_split) <= 2, plan
