"""Requests for structured documents, answered as they and the documents come.

A batch of requests joins the documents stored by then. A request whose document has
not come waits: it goes into the waiting set, which the next batch takes up again, until
its document is there or its deadline has passed by the time of the latest request. Each
batch writes its answers and then the new waiting set to folders named by the batch; the
marker of the latter commits both. A batch that is repeated starts from the waiting set
of the batch before it and writes the same again, so every request is answered once.
"""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import is_blank
from ..operators.lookups import metadata_requests
from ..operators.render import structure_documents
from ..session import materialize
from .ingest import read_store

REQUESTS = "req_id string, document_id string, asked_at timestamp"
ANSWERS = "req_id string, document_id string, status string, metadata string"
_BATCH = re.compile(r"b(\d{12})")


def _waiting_before(spark: SparkSession, out: str, batch: int) -> DataFrame:
    """The waiting set that the last committed batch before this one left, with the time
    of the latest request so far."""
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = jvm.Path(f"{out}/waiting")
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = []
    for f in (fs.listStatus(root) if fs.exists(root) else []):
        m = _BATCH.fullmatch(f.getPath().getName())
        if m and int(m[1]) < batch and fs.exists(jvm.Path(f.getPath(), "_SUCCESS")):
            found.append((int(m[1]), f.getPath().toString()))
    schema = f"{REQUESTS}, clock timestamp"
    return spark.read.schema(schema).parquet(max(found)[1]) if found else spark.createDataFrame([], schema)


def settle(batch: DataFrame, number: int, store: str, out: str, deadline: str, last: bool = False) -> None:
    """Answer a batch and what waits; `last` ends the waiting of all."""
    spark = batch.sparkSession
    asked = batch.select("req_id", "document_id", "asked_at", F.col("asked_at").alias("clock")).unionByName(
        _waiting_before(spark, out, number))
    clock = asked.agg(F.max("clock")).first()[0]
    docs = read_store(spark, store)
    asked = asked.drop("clock")
    needed = asked.select("document_id").distinct()
    docs = materialize(docs.join(needed, "document_id", "left_semi").select("document_id", "text"))
    known = metadata_requests(asked, docs).drop("text")
    late = F.lit(True) if last else F.lit(clock) > F.col("asked_at") + F.expr(f"interval {deadline}")
    known = materialize(known.withColumn("_waits", (F.col("status") == "not_found") & ~late))
    made = structure_documents(docs.where("text <> ''"), key="document_id")
    answers = known.where("not _waits").join(made, "document_id", "left")
    empty = (F.col("status") == "ok") & F.coalesce(is_blank(F.col("metadata")), F.lit(True))
    status = F.when(empty | (F.col("status") == "no_text"), "empty").otherwise(F.col("status"))
    (answers.select("req_id", "document_id", status.alias("status"), F.when(status == "ok", F.col("metadata")).alias("metadata"))
     .write.mode("overwrite").parquet(f"{out}/answers/b{number:012d}"))
    (known.where("_waits").select("req_id", "document_id", "asked_at", F.lit(clock).cast("timestamp").alias("clock"))
     .write.mode("overwrite").parquet(f"{out}/waiting/b{number:012d}"))


def answer_stream(requests: DataFrame, store: str, out: str, checkpoint: str, deadline: str = "1 day",
                  available_now: bool = True) -> StreamingQuery:
    """Answer a stream of (req_id, document_id, asked_at) from the documents in a store, which
    may grow meanwhile. One stream writes to `out`; all paths are shared storage."""
    writer = (requests.writeStream.option("checkpointLocation", checkpoint)
              .foreachBatch(lambda batch, n: settle(batch, n, store, out, deadline)))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def end_waiting(spark: SparkSession, store: str, out: str, batch: int) -> None:
    """Answer all that still waits after a stream has ended, as a batch of that number."""
    settle(spark.createDataFrame([], REQUESTS), batch, store, out, "0 seconds", last=True)


def read_answers(spark: SparkSession, out: str) -> DataFrame:
    """The answers of all batches."""
    return spark.read.schema(ANSWERS).parquet(f"{out}/answers/*")
