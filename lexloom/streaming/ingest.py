"""Continuous ingest: files arrive, are gated, decoded, keyed and stored.

The store is append-only. Every batch writes its rows to a folder of its own and
reading takes the newest version of each document, so a batch costs what it holds,
whatever the size of the store. A folder counts once its `_SUCCESS` marker is there:
a lost driver leaves an unmarked folder that nobody reads and the replayed batch
writes anew, and a batch that was committed is not written again. Compaction names the
folders that it replaces and writes their newest versions as one; readers take all
committed folders but those that a committed compaction names. They switch at one
marker, and a batch that comes while a compaction runs is named by none and stays.
"""
from __future__ import annotations

import hashlib
import re
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions import fixed_values as fv
from ..operators.store import DOCUMENT_SCHEMA, align_schema, latest_versions
from ..session import materialize, shuffled, stage_folder
from ..sources.files import BINARY_SCHEMA, LISTED, file_outcomes, list_files

STORE_SCHEMA = T.StructType(DOCUMENT_SCHEMA.fields + [T.StructField("status", T.StringType())])
VERSIONS = T.StructType(STORE_SCHEMA.fields + [T.StructField("seq", T.LongType())])
COMPACTED = "compacted"
FOLDER = re.compile(r"g(\d{6})-s(\d{9})-(.*)")


def _folders(spark: SparkSession, path: str) -> list[tuple[int, int, str, str]]:
    """(generation, sequence number, batch name, folder) of the committed batches."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    out = []
    for f in fs.listStatus(root):
        m = FOLDER.fullmatch(f.getPath().getName())
        marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS")
        if m and fs.exists(marker):
            out.append((int(m[1]), int(m[2]), m[3], f.getPath().toString()))
    return sorted(out)


def _current(spark: SparkSession, path: str) -> list[tuple[int, int, str, str]]:
    """The committed folders that no committed compaction replaces."""
    found = _folders(spark, path)
    lists = [f"{path}/_replaced/{f[3].rsplit('/', 1)[-1]}" for f in found if f[2] == COMPACTED]
    gone = {r[0] for r in spark.read.text(lists).collect()} if lists else set()      # a name for each batch
    return [f for f in found if f[3].rsplit("/", 1)[-1] not in gone]


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of every stored document; an empty table when nothing was
    stored yet."""
    found = _current(spark, path)
    if not found:
        return spark.createDataFrame([], STORE_SCHEMA)
    rows = spark.read.schema(VERSIONS).parquet(*[f[3] for f in found])
    return latest_versions(rows, order=("seq", "updated_at")).drop("seq")


def append_versions(batch: DataFrame, path: str, name: str) -> None:
    """Store a batch under a name. A batch of that name that is already there, also
    before a compaction, is the same one delivered again, and is left as it is."""
    spark = batch.sparkSession
    found = _folders(spark, path)
    if any(f[2] == name for f in found):
        return
    generation, seq = (found[-1][0], max(f[1] for f in found) + 1) if found else (0, 0)
    rows = align_schema(batch, STORE_SCHEMA).withColumn("seq", F.lit(seq).cast("long"))
    rows.write.mode("overwrite").parquet(f"{path}/g{generation:06d}-s{seq:09d}-{name}")


def compact_store(spark: SparkSession, path: str) -> None:
    """Write the newest versions of the folders there are as one. They keep their sequence
    numbers, so a batch that is stored meanwhile is newer. One compaction runs at a
    time; replaced folders may be deleted when no reader uses them."""
    found = _current(spark, path)
    if not found:
        return
    generation, seq = _folders(spark, path)[-1][0] + 1, max(f[1] for f in found) + 1
    name = f"g{generation:06d}-s{seq:09d}-{COMPACTED}"
    names = spark.createDataFrame([(f[3].rsplit("/", 1)[-1],) for f in found], "value string")
    names.coalesce(1).write.mode("overwrite").text(f"{path}/_replaced/{name}")
    rows = spark.read.schema(VERSIONS).parquet(*[f[3] for f in found])
    rows = latest_versions(rows, order=("seq", "updated_at"))
    align_schema(rows, VERSIONS).write.mode("overwrite").parquet(f"{path}/{name}")


def file_stream(spark: SparkSession, in_dir: str, max_files: int | None = None,
                max_bytes: int = fv.MAX_FILE_BYTES, by_content: bool = False) -> DataFrame:
    """Arriving files as document rows, rejected ones with their reason; no state."""
    reader = (spark.readStream.format("binaryFile").schema(BINARY_SCHEMA)
              .option("recursiveFileLookup", "true"))
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return file_outcomes(reader.load(in_dir), max_bytes, by_content)


def note_arrivals(spark: SparkSession, in_dir: str, notes: str, max_files: int | None = None) -> None:
    """Append (path, modificationTime, length) of the files below a folder that the notes do
    not hold yet; like the file source, a path counts once. With `max_files`, no file of the
    notes holds more, and they are appended one by one, oldest arrivals first. The driver
    sees the names of these few files and no list of arrivals."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(notes)
    root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(root)
    known = spark.read.schema(LISTED).parquet(notes).select("path")
    new = materialize(list_files(spark, in_dir).join(shuffled(known), "path", "left_anti"))
    if new.isEmpty():
        return
    if max_files is None:
        new.write.mode("append").parquet(notes)
        return
    ordered = f"{stage_folder(spark)}/{uuid.uuid4().hex}"
    new.orderBy("modificationTime", "path").write.option("maxRecordsPerFile", max_files).parquet(ordered)
    # The stream goes by the time of each file.
    for part in sorted(spark.read.schema(LISTED).parquet(ordered).inputFiles()):
        spark.read.schema(LISTED).parquet(part).coalesce(1).write.mode("append").parquet(notes)


def noted_stream(spark: SparkSession, in_dir: str, notes: str, max_files: int | None = None,
                 max_bytes: int = fv.MAX_FILE_BYTES, by_content: bool = False) -> DataFrame:
    """`file_stream` of the files that are there now. The stream reads notes of them, which
    the tasks have written; the files themselves are read in tasks as well."""
    note_arrivals(spark, in_dir, notes, max_files)
    # What is noted stays to be read, however old it is.
    reader = spark.readStream.schema(LISTED).option("maxFileAge", "36500d")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", 1)
    return file_outcomes(reader.parquet(notes), max_bytes, by_content)


def _arrivals(spark: SparkSession, in_dir: str, checkpoint: str, max_files: int | None, max_bytes: int,
              available_now: bool, by_content: bool = False) -> DataFrame:
    """The files that are there now, noted beside the checkpoint; of a stream that goes on,
    Spark's source, which lists the folder on the driver at every trigger."""
    if available_now:
        return noted_stream(spark, in_dir, f"{checkpoint}/arrivals", max_files, max_bytes, by_content)
    return file_stream(spark, in_dir, max_files, max_bytes, by_content)


def start_upserts(rows: DataFrame, out: str, checkpoint: str,
                  available_now: bool = True) -> StreamingQuery:
    """Store a stream of document rows. `out` and `checkpoint` are shared storage;
    batches are named by the checkpoint, so that another stream's do not collide."""
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]
    writer = (rows.writeStream.option("checkpointLocation", checkpoint)
              .foreachBatch(lambda batch, n: append_versions(batch, out, f"{stream}-{n}")))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stream_ingest(spark: SparkSession, in_dir: str, out: str, checkpoint: str,
                  max_files: int | None = None, max_bytes: int = fv.MAX_FILE_BYTES,
                  available_now: bool = True) -> StreamingQuery:
    """Ingest files as they arrive in a folder."""
    rows = _arrivals(spark, in_dir, checkpoint, max_files, max_bytes, available_now)
    return start_upserts(rows, out, checkpoint, available_now)


def contents_once(spark: SparkSession, in_dir: str, out: str, checkpoint: str, within: str = "30 days",
                  max_files: int | None = None, max_bytes: int = fv.MAX_FILE_BYTES,
                  available_now: bool = True) -> StreamingQuery:
    """Ingest arriving files by their content: a file that comes again within a time, under
    whatever name, is dropped by the stream. The state is keyed by the hash of the content
    and holds no text; a key expires once the newest file is `within` younger, so the
    state follows the arrivals of that time and not the store. It lives in the checkpoint
    and survives restarts. What another stream or an expired key lets through has the
    same id in the store and counts once there too."""
    rows = _arrivals(spark, in_dir, checkpoint, max_files, max_bytes, available_now, by_content=True)
    once = rows.withWatermark("created_at", within).dropDuplicatesWithinWatermark(["document_id"])
    return start_upserts(once, out, checkpoint, available_now)
