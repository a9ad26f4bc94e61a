"""File sources and sinks, and the stream against the batch result."""
import json
import os

import pytest
from pyspark.sql import functions as F

from lexloom.operators import segment as S
from lexloom.sources import files as FS
from lexloom.streaming import ingest


@pytest.fixture
def folder(tmp_path):
    src = tmp_path / "in"
    (src / "sub").mkdir(parents=True)
    (src / "a.txt").write_bytes("Điều 1. A\r\nx\ry".encode())
    (src / "sub" / "B.MD").write_bytes("caf\xe9".encode("latin-1"))
    (src / "c.pdf").write_bytes(b"%PDF")
    (src / "d.exe").write_bytes(b"x")
    (src / "noext").write_bytes(b"x")
    (src / "big.markdown").write_bytes(b"x" * 2000)
    for name in ("e.Txt", "f.tXT", "g.Md", "h.Markdown", "i.MARKDOWN"):
        (src / "sub" / name).write_bytes(name.encode())
    return src


MIXED = {n: n for n in ("e.Txt", "f.tXT", "g.Md", "h.Markdown", "i.MARKDOWN")}


def names(df):
    return sorted(os.path.basename(r.path) for r in df.collect())


def test_gates(spark, folder):
    accepted, rejected = FS.accept_files(FS.scan_files(spark, str(folder)), max_bytes=1999)
    assert names(accepted) == sorted(["B.MD", "a.txt", "c.pdf", *MIXED])
    assert {(os.path.basename(r.path), r.reason) for r in rejected.collect()} == {
        ("d.exe", "unsupported_extension"), ("noext", "unsupported_extension"), ("big.markdown", "too_large")}
    assert FS.accept_files(FS.scan_files(spark, str(folder)), max_bytes=2000)[0].count() == 9


def test_text_files(spark, folder):
    got = {os.path.basename(r.path): r.text for r in FS.read_text_files(spark, str(folder)).collect()}
    assert got == {"a.txt": "Điều 1. A\nx\ny", "B.MD": "café", "big.markdown": "x" * 2000, **MIXED}
    small = FS.read_text_files(spark, str(folder), max_bytes=1999)
    assert "big.markdown" not in names(small)
    left = {os.path.basename(r.path): r.reason for r in FS.unread_files(spark, str(folder), 1999).collect()}
    assert left == {"c.pdf": "needs_parser", "d.exe": "unsupported_extension", "noext": "unsupported_extension",
                    "big.markdown": "too_large"}


def test_keys_are_stable_and_depend_on_content(spark, folder):
    def keys():
        return {r.filename: r.document_id for r in FS.assign_keys(FS.scan_files(spark, str(folder))).collect()}
    first = keys()
    assert keys() == first and len(set(first.values())) == len(first)
    (folder / "a.txt").write_bytes(b"other")
    assert keys()["a.txt"] != first["a.txt"] and keys()["c.pdf"] == first["c.pdf"]
    row = FS.assign_keys(FS.scan_files(spark, str(folder), "a.txt")).first()
    assert row.stored_name == row.modificationTime.strftime("%Y%m%d_%H%M%S") + "_a.txt"


def test_parser_types_have_no_text(spark, folder):
    accepted, _ = FS.accept_files(FS.scan_files(spark, str(folder)))
    status = {os.path.basename(r.path): (r.status, r.text) for r in FS.extract_text(accepted).collect()}
    assert status["c.pdf"] == ("needs_parser", None) and status["B.MD"] == ("ok", "café")


def test_sinks(spark, folder, tmp_path):
    from lexloom.operators import render as M
    df = spark.createDataFrame([(1, 'Điều 1. "A"')], "doc_key int, text string")
    FS.write_markdown(M.structure_documents(df), str(tmp_path / "md"))
    assert spark.read.parquet(str(tmp_path / "md")).first().metadata.endswith('Điều 1. "A"')
    FS.write_json(M.blocks_to_json(S.split_documents(df)), str(tmp_path / "json"))
    line = json.loads(spark.read.text(str(tmp_path / "json")).first().value)
    assert line["content"] == 'Điều 1. "A"' and line["metadata"]["source"] == "Điều 1"


def stored(spark, path):
    return sorted((r.filename, r.status, r.text or "") for r in ingest.read_store(spark, path).collect())


def test_stream_equals_batch_and_takes_new_files(spark, folder, tmp_path):
    out, state = str(tmp_path / "store"), str(tmp_path / "state")
    assert ingest.read_store(spark, out).count() == 0
    ingest.compact_store(spark, out)
    ingest.stream_ingest(spark, str(folder), out, state, max_files=3, max_bytes=1999).awaitTermination()
    batch = sorted((r.filename, r.status, r.text or "")
                   for r in FS.file_outcomes(FS.scan_files(spark, str(folder)), 1999).collect())
    assert stored(spark, out) == batch and len(batch) == 11
    assert {s for _, s, _ in batch} == {"ok", "needs_parser", "unsupported_extension", "too_large"}
    (folder / "late.txt").write_text("muộn")
    ingest.stream_ingest(spark, str(folder), out, state, max_bytes=1999).awaitTermination()
    batch = sorted([*batch, ("late.txt", "ok", "muộn")])
    assert stored(spark, out) == batch
    # All files again through another checkpoint, and a compaction.
    ingest.stream_ingest(spark, str(folder), out, state + "2", max_bytes=1999).awaitTermination()
    assert stored(spark, out) == batch
    ingest.compact_store(spark, out)
    assert stored(spark, out) == batch


def version(spark, i, text, day=1):
    at = f"2024-01-{day:02d} 00:00:00"
    return spark.sql(f"select '{i}' document_id, '{i}' filename, '' filepath, '{text}' text, timestamp'{at}' created_at,"
                     f" timestamp'{at}' updated_at, 'ok' status")


def test_batches_append_and_replays_change_nothing(spark, tmp_path):
    out = str(tmp_path / "store")
    ingest.append_versions(version(spark, "a", "1", 5), out, "s-0")
    files = {f: os.path.getmtime(f) for f in map(str, (tmp_path / "store").rglob("*.parquet"))}
    ingest.append_versions(version(spark, "a", "2", 2).union(version(spark, "b", "1")), out, "s-1")
    ingest.append_versions(version(spark, "a", "other"), out, "s-1")            # delivered again
    assert [x[::2] for x in stored(spark, out)] == [("a", "2"), ("b", "1")]     # arrival decides
    assert all(os.path.getmtime(f) == t for f, t in files.items())              # nothing is rewritten
    ingest.compact_store(spark, out)
    ingest.append_versions(version(spark, "b", "late"), out, "s-1")             # also after a compaction
    assert [x[::2] for x in stored(spark, out)] == [("a", "2"), ("b", "1")]
    ingest.append_versions(version(spark, "b", "3"), out, "s-2")
    assert [x[::2] for x in stored(spark, out)] == [("a", "2"), ("b", "3")]


def test_batches_without_a_marker_do_not_count(spark, tmp_path):
    out = tmp_path / "store"
    ingest.append_versions(version(spark, "a", "1"), str(out), "s-0")
    ingest.append_versions(version(spark, "a", "2"), str(out), "s-1")
    (out / "g000000-s000000001-s-1" / "_SUCCESS").unlink()                      # the driver was lost here
    assert [x[::2] for x in stored(spark, str(out))] == [("a", "1")]
    ingest.append_versions(version(spark, "a", "2"), str(out), "s-1")
    assert [x[::2] for x in stored(spark, str(out))] == [("a", "2")]
    ingest.compact_store(spark, str(out))
    (out / "g000001-s000000002-compacted" / "_SUCCESS").unlink()
    assert [x[::2] for x in stored(spark, str(out))] == [("a", "2")]


def test_stored_names_are_utc(spark, folder):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        here = {r.filename: r.stored_name for r in FS.assign_keys(FS.scan_files(spark, str(folder))).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert here == {r.filename: r.stored_name for r in FS.assign_keys(FS.scan_files(spark, str(folder))).collect()}


def odd_folder(tmp_path):
    src = tmp_path / "odd"
    for name in ("a b.txt", "100%.txt", "x%20y.md", "dấu/é.txt", "deep/er/and/c=d.txt", "_no.txt", ".no.txt", "_no/a.txt",
                 "_k=1/a.txt", "deep/#h.txt", "z._COPYING_", "empty.txt"):
        (src / name).parent.mkdir(parents=True, exist_ok=True)
        (src / name).write_text("" if name == "empty.txt" else name)
    (src / "none").mkdir()
    (src / "broken.txt").symlink_to(src / "nowhere")
    (src / "link.txt").symlink_to(src / "a b.txt")
    return src


def test_list_equals_the_file_source(spark, tmp_path):
    src = odd_folder(tmp_path)
    columns = ["path", "modificationTime", "length"]
    for path in (str(src), f"file://{src}", f"{src}/*.txt", f"{src}/a b.txt", str(src / "none")):
        listed = FS.list_files(spark, path)
        want = FS.scan_files(spark, path)                                       # leaves empty files out
        assert sorted(listed.where("length > 0").collect()) == sorted(want.select(columns).collect()), path
        assert sorted(FS.read_contents(listed).where("length > 0").collect()) == sorted(want.collect()), path
    empty = FS.read_text_files(spark, str(src)).where("length = 0").collect()
    assert [(r.path.rsplit("/", 1)[1], r.text) for r in empty] == [("empty.txt", "")]
    with pytest.raises(FileNotFoundError):
        FS.list_files(spark, str(src / "missing"))


def test_large_files_are_read_in_short_batches(spark, tmp_path, monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(FS, "HELD_ROWS", 3)
    monkeypatch.setattr(FS, "HELD_BYTES", 10)
    paths = []
    for i, size in enumerate([1, 1, 1, 1, 20, 1, 9, 1, 1]):
        paths.append(str(tmp_path / f"{i}.txt"))
        (tmp_path / f"{i}.txt").write_bytes(bytes([i]) * size)
    got = list(FS._read_files([pa.RecordBatch.from_pydict({"path": paths})]))
    assert [b.num_rows for b in got] == [3, 2, 2, 2]
    rows = [r for b in got for r in b.to_pylist()]
    assert [r["path"] for r in rows] == paths and all(r["content"][0] == i for i, r in enumerate(rows))


def test_driver_keeps_no_list_of_files(spark, tmp_path):
    src, state = tmp_path / "in", tmp_path / "state"
    src.mkdir()
    for i in range(40):
        (src / f"arrival-{i}.txt").write_text(f"text {i}")
    plan = FS.read_text_files(spark, str(src))._jdf.queryExecution().toString()
    assert "binaryFile" not in plan and "FileScan" not in plan
    ingest.stream_ingest(spark, str(src), str(tmp_path / "store"), str(state)).awaitTermination()
    log = "".join(f.read_text() for f in (state / "sources").rglob("*") if f.is_file() and f.suffix != ".crc")
    assert "arrivals/part-" in log and "arrival-" not in log
    assert len(stored(spark, str(tmp_path / "store"))) == 40


def test_arrivals_are_noted_oldest_first(spark, tmp_path):
    src, notes = tmp_path / "in", str(tmp_path / "notes")
    src.mkdir()
    for i in range(7):
        (src / f"{i}.txt").write_text("x")
        os.utime(src / f"{i}.txt", (1_700_000_000 - i,) * 2)
    ingest.note_arrivals(spark, str(src), notes, 3)
    (src / "late.txt").write_text("x")
    for _ in range(2):
        ingest.note_arrivals(spark, str(src), notes, 3)
    parts = sorted((tmp_path / "notes").glob("part-*.parquet"), key=os.path.getmtime)
    held = [sorted(names(spark.read.parquet(str(p)))) for p in parts]
    assert all(len(h) <= 3 for h in held)
    assert sum(held, [])[-1] == "late.txt" and len(sum(held, [])) == 8
    first = [max(int(n[0]) for n in h) for h in held[:-1]]
    assert first == sorted(first, reverse=True)
