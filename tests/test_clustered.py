"""Clustered document table: in-place changes, plan shapes, pages of the list."""
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lexloom.operators import clustered as K, store as D

T0 = datetime(2024, 1, 1)


def rows(spark, ids, text="t", at=T0, metadata=None):
    return spark.createDataFrame([(i, f"{i}.txt", f"/s/{i}", text, metadata, at, at) for i in ids],
                                 D.DOCUMENT_SCHEMA)


@pytest.fixture
def name(spark, tmp_path, request):
    name = f"t_{abs(hash(request.node.name))}"
    K.open_table(spark, name, str(tmp_path / "docs"), parts=8, buckets=4)
    yield name
    spark.sql(f"DROP TABLE {name}")


def files(tmp_path):
    return {str(p): p.stat().st_mtime_ns for p in Path(tmp_path, "docs").rglob("*.parquet")}


def test_changes_equal_the_plain_operators(spark, name):
    first, second = rows(spark, [f"d{i}" for i in range(200)], metadata="m"), rows(spark, [f"d{i}" for i in range(150, 260)], "new")
    K.upsert(spark, name, first)
    K.upsert(spark, name, second)
    want = D.upsert_documents(first, second)
    assert sorted(K.read_table(spark, name).collect()) == sorted(want.collect())
    K.upsert(spark, name, second)                                     # again
    assert sorted(K.read_table(spark, name).collect()) == sorted(want.collect())
    upd = spark.createDataFrame([("d3", "x", T0 + timedelta(1)), ("d3", "y", T0 + timedelta(2)), ("q", "z", T0), (None, "n", T0)],
                                "document_id string, metadata string, now timestamp")
    K.update_metadata(spark, name, upd)
    want = D.update_metadata(want, upd)
    assert sorted(K.read_table(spark, name).collect(), key=str) == sorted(want.collect(), key=str)
    ids = spark.createDataFrame([(f"d{i}",) for i in range(100)] + [("q",), ("q",), (None,)], "document_id string")
    got = sorted(tuple(r) for r in K.delete(spark, name, ids).collect())
    left, outcome = D.delete_documents(want, ids.where("document_id is not null"))
    assert got == sorted(tuple(r) for r in outcome.collect())
    assert sorted(K.read_table(spark, name).collect(), key=str) == sorted(left.collect(), key=str)
    assert K.get_row(spark, name, "d120").count() == 1 and K.get_row(spark, name, "d3").count() == 0


def test_only_touched_partitions_are_written(spark, name, tmp_path):
    K.upsert(spark, name, rows(spark, [f"d{i}" for i in range(400)]))
    before = files(tmp_path)
    parts = K.upsert(spark, name, rows(spark, ["d7"], "new"))
    after = files(tmp_path)
    assert len(parts) == 1 and len(before) == len(after)
    changed = {Path(p).parent.name for p in after if before.get(p) != after[p]}
    assert changed == {f"{K.PART}={parts[0]}"}
    assert K.upsert(spark, name, rows(spark, [])) == []


def test_the_last_row_of_a_partition_can_go(spark, name, tmp_path):
    K.upsert(spark, name, rows(spark, ["a", "b"]))
    ids = spark.createDataFrame([("a",), ("b",)], "document_id string")
    assert K.delete(spark, name, ids).where("deleted").count() == 2
    assert K.read_table(spark, name).count() == 0 and not files(tmp_path)
    assert K.delete(spark, name, ids).where("deleted").count() == 0


def test_another_session_finds_the_table(spark, name, tmp_path):
    K.upsert(spark, name, rows(spark, ["a", "b"]))
    K.open_table(spark, f"{name}_again", str(tmp_path / "docs"), parts=8, buckets=4)
    assert K.read_table(spark, f"{name}_again").count() == 2
    spark.sql(f"DROP TABLE {name}_again")


@pytest.mark.parametrize("change", ["merged", "updated"])
def test_the_base_is_not_shuffled(spark, name, change):
    K.upsert(spark, name, rows(spark, [f"d{i}" for i in range(50)]))
    base = K.touched(spark, name, [1, 2])
    if change == "merged":
        new = rows(spark, ["d1"]).withColumn(K.PART, F.lit(1))
        out = K.merged(base, new, "document_id", 4)
    else:
        out = K.updated(base, spark.createDataFrame([("d1", "m", T0)], "document_id string, metadata string, now timestamp"),
                        "document_id", 4)
    text = out._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and "SortMergeJoin" in text
    before, scan = text.index("Exchange"), text.index("FileScan")
    assert "PartitionFilters: [" in text and "Bucketed: true" in text and before > scan


def test_pages_are_the_list(spark):
    df = spark.createDataFrame([(f"k{i:03}", None if i % 7 == 0 else T0 + timedelta(hours=i % 5)) for i in range(100)],
                               "document_id string, created_at timestamp").repartition(4)
    want = [tuple(r) for r in D.list_documents(df).collect()]
    got, after = [], None
    while page := D.list_page(df, 9, after).collect():
        got += [tuple(r) for r in page]
        after = (page[-1].created_at, page[-1].document_id)
    assert got == want


def test_a_page_is_a_heap_and_reaches_the_scan(spark, tmp_path):
    rows(spark, ["a"]).write.parquet(str(tmp_path / "p"))
    text = D.list_page(spark.read.parquet(str(tmp_path / "p")), 5, (T0, "a"))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in text and "LessThanOrEqual(created_at" in text
