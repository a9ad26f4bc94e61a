"""Streams with state: contents that come again, and requests that wait."""
import datetime as dt

from pyspark.sql import functions as F

from lexloom.streaming import ingest, requests as RQ


def versions(spark, store):
    return spark.read.schema(ingest.VERSIONS).parquet(*[f[3] for f in ingest._folders(spark, store)])


def test_contents_once(spark, tmp_path):
    src, store = tmp_path / "in", str(tmp_path / "store")
    src.mkdir()
    def run(name):
        ingest.contents_once(spark, str(src), store, str(tmp_path / name), max_files=1).awaitTermination()
    (src / "a.txt").write_text("one")
    (src / "b.txt").write_text("one")
    (src / "c.txt").write_text("two")
    run("first")
    assert versions(spark, store).count() == 2                   # the stream itself has dropped the second
    (src / "renamed.txt").write_text("one")
    (src / "d.txt").write_text("three")
    (src / "e.exe").write_text("one")
    run("first")                                                 # restarted: the state is still there
    assert versions(spark, store).count() == 4
    run("second")                                                # another stream delivers all again
    got = sorted((r.text, r.status) for r in ingest.read_store(spark, store).where("status = 'ok'").collect())
    assert got == [("one", "ok"), ("three", "ok"), ("two", "ok")]
    before = versions(spark, store).count()
    run("second")
    assert versions(spark, store).count() == before


def test_state_expires(spark, tmp_path):
    import os
    src, store = tmp_path / "in", str(tmp_path / "store")
    src.mkdir()
    day = 86400
    for i, when in enumerate([0, 10 * day, 20 * day, 30 * day]):
        (src / f"{i}.txt").write_text(f"text {i}")
        os.utime(src / f"{i}.txt", (1_700_000_000 + when,) * 2)
        query = ingest.contents_once(spark, str(src), store, str(tmp_path / "check"), within="5 days")
        query.awaitTermination()
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert rows and rows[-1] <= 2                                # not all four keys


def at(hours):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=hours)


def store_of(spark, path, name, *rows):
    df = spark.createDataFrame(rows, "document_id string, text string")
    ingest.append_versions(df.withColumn("updated_at", F.lit(at(0))), path, name)


def settled(spark, paths, number, *rows, **more):
    batch = spark.createDataFrame(list(rows), RQ.REQUESTS)
    RQ.settle(batch, number, *paths, "5 hours", **more)
    return sorted((r.req_id, r.status) for r in spark.read.schema(RQ.ANSWERS).parquet(
        f"{paths[1]}/answers/b{number:012d}").collect())


def test_requests_wait(spark, tmp_path):
    paths = (str(tmp_path / "store"), str(tmp_path / "out"))
    store_of(spark, paths[0], "one", ("a", "Điều 1. A\nb"), ("blank", ""))
    first = [("1", "a", at(0)), ("2", "late", at(0)), ("3", None, at(0)), ("4", "", at(0)), ("5", "blank", at(0)),
             ("6", "never", at(0)), ("1b", "a", at(0))]
    want = [("1", "ok"), ("1b", "ok"), ("3", "missing_id"), ("4", "missing_id"), ("5", "empty")]
    assert settled(spark, paths, 0, *first) == want
    assert settled(spark, paths, 0, *first) == want              # the batch again
    store_of(spark, paths[0], "two", ("late", "Điều 1. B\nc"))
    assert settled(spark, paths, 1, ("7", "never", at(4))) == [("2", "ok")]
    assert settled(spark, paths, 2, ("8", "a", at(6))) == [("6", "not_found"), ("8", "ok")]
    assert settled(spark, paths, 1, ("7", "never", at(4))) == [("2", "ok")]
    RQ.end_waiting(spark, *paths, 99)
    answers = sorted((r.req_id, r.status) for r in RQ.read_answers(spark, paths[1]).collect())
    assert answers == sorted(want + [("2", "ok"), ("6", "not_found"), ("8", "ok"), ("7", "not_found")])
    made = {r.req_id: r.metadata for r in RQ.read_answers(spark, paths[1]).collect()}
    assert "Điều 1" in made["1"] and made["5"] is None


def test_nothing_asked(spark, tmp_path):
    paths = (str(tmp_path / "store"), str(tmp_path / "out"))
    assert settled(spark, paths, 0) == []
    RQ.end_waiting(spark, *paths, 1)
    assert RQ.read_answers(spark, paths[1]).count() == 0


def test_batch_during_compaction_stays(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    store_of(spark, path, "one", ("a", "old"), ("b", "old"))
    align = ingest.align_schema

    def late(df, schema):
        monkeypatch.setattr(ingest, "align_schema", align)
        store_of(spark, path, "two", ("a", "new"))               # comes after the folders were listed
        return align(df, schema)
    monkeypatch.setattr(ingest, "align_schema", late)
    ingest.compact_store(spark, path)
    def texts():
        return {r.document_id: r.text for r in ingest.read_store(spark, path).collect()}
    assert texts() == {"a": "new", "b": "old"}
    assert len(ingest._current(spark, path)) == 2
    ingest.compact_store(spark, path)
    assert texts() == {"a": "new", "b": "old"} and len(ingest._current(spark, path)) == 1
    store_of(spark, path, "two", ("a", "again"))                 # delivered again: left out
    store_of(spark, path, "three", ("b", "newer"))
    assert texts() == {"a": "new", "b": "newer"}


def test_unfinished_compaction_counts_for_nothing(spark, tmp_path):
    path = str(tmp_path / "store")
    store_of(spark, path, "one", ("a", "x"))
    ingest.compact_store(spark, path)
    folder = ingest._current(spark, path)[0][3].replace("file:", "")
    (tmp_path / "store" / folder.rsplit("/", 1)[-1] / "_SUCCESS").unlink()
    assert [r.text for r in ingest.read_store(spark, path).collect()] == ["x"]


def test_counts_follow_any_batches(spark):
    import random
    from collections import Counter

    from lexloom.operators import classify as C
    rng, held = random.Random(3), {}
    counts = spark.createDataFrame([], "label string, n_documents long")
    for _ in range(4):
        changed = {rng.randrange(30): rng.choice(["a", "b", None]) for _ in range(15)}
        base = spark.createDataFrame(list(held.items()), "k int, label string")
        batch = spark.createDataFrame(list(changed.items()), "k int, label string")
        counts = spark.createDataFrame(C.maintain_counts(counts, C.label_deltas(base, batch, "k")).collect(),
                                       "label string, n_documents long")
        held.update(changed)
        held = {k: v for k, v in held.items() if v is not None}
        want = Counter(held.values())
        assert all(want[r.label] == r.n_documents for r in counts.collect()) and counts.count() >= len(want)
