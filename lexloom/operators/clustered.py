"""The document table as a clustered Parquet table that batches change in place.

Rows are dealt twice by a hash of their key: into partitions, which are what a batch
rewrites, and within each into buckets, by which the engine joins. A batch reads and
overwrites only the partitions that its keys fall into (dynamic partition overwrite),
and in its join only the batch is shuffled: the stored side is read bucket by bucket.
The number of buckets is the number of tasks of a change, the number of partitions the
finest share of the table that is rewritten; both are fixed when the table is made.

A change is computed from the old files before any is replaced; a repeated batch gives
the same table again. Rows without a key are left out, since no lookup could find them.
One writer at a time: two changes at once could each undo the other's partitions.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..session import materialize
from .store import DOCUMENT_SCHEMA, align_schema, latest_versions

PART = "_part"


def _folder(spark: SparkSession, path: str):
    """(file system, path) of a folder wherever it lies."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def open_table(spark: SparkSession, name: str, path: str, schema: T.StructType = DOCUMENT_SCHEMA,
               key: str = "document_id", parts: int = 64, buckets: int = 64) -> None:
    """Register the table of a folder, new or filled by another session; the numbers of
    partitions and buckets must be those it was made with."""
    files, folder = _folder(spark, path)
    files.mkdirs(folder)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}, {PART} int) USING parquet "
              f"OPTIONS (partitionOverwriteMode 'dynamic') PARTITIONED BY ({PART}) "
              f"CLUSTERED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}' "
              f"TBLPROPERTIES ('parts' = '{parts}', 'buckets' = '{buckets}', 'key' = '{key}')")
    spark.sql(f"MSCK REPAIR TABLE {name}")


def _shape(spark: SparkSession, name: str) -> tuple[str, int, int, str]:
    """(key, partitions, buckets, folder)"""
    of = {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
    folder = [r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect() if r.col_name == "Location"]
    return of["key"], int(of["parts"]), int(of["buckets"]), folder[0]


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name).drop(PART)


def get_row(spark: SparkSession, name: str, value) -> DataFrame:
    """Rows of one key: one bucket of one partition is read."""
    key, parts, _, _ = _shape(spark, name)
    part = F.pmod(F.xxhash64(F.lit(value)), F.lit(parts)).cast("int")
    return spark.table(name).where((F.col(PART) == part) & (F.col(key) == F.lit(value))).drop(PART)


def _batch(rows: DataFrame, key: str, parts: int) -> tuple[DataFrame, list[int]]:
    """The batch, computed once, and the partitions it touches: at most `parts` numbers."""
    rows = materialize(rows.where(F.col(key).isNotNull()).withColumn(
        PART, F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")))
    return rows, sorted(r[0] for r in rows.select(PART).distinct().collect())


def touched(spark: SparkSession, name: str, parts: list[int]) -> DataFrame:
    """The stored rows of some partitions, pruned at the scan."""
    return spark.table(name).where(F.col(PART).isin(parts))


def merged(base: DataFrame, new: DataFrame, key: str, buckets: int) -> DataFrame:
    """Stored rows with those of the batch in place of theirs or beside them. Only the
    batch is dealt, into the buckets of the stored side."""
    columns = base.columns
    old = base.select(F.col(key).alias("_k"), F.struct(*columns).alias("_old"))
    add = new.select(F.col(key).alias("_n"), F.struct(*columns).alias("_new")).repartition(buckets, "_n")
    row = F.coalesce("_new", "_old")
    return (old.join(add.hint("merge"), F.col("_k") == F.col("_n"), "full_outer")
            .select(*[row[c].alias(c) for c in columns]))


def upsert(spark: SparkSession, name: str, incoming: DataFrame, order=("updated_at",)) -> list[int]:
    """Insert or replace whole rows, as `store.upsert_documents`; returns the partitions
    rewritten."""
    key, parts, buckets, _ = _shape(spark, name)
    schema = T.StructType([f for f in spark.table(name).schema.fields if f.name != PART])
    new, at = _batch(align_schema(latest_versions(incoming, key, order), schema), key, parts)
    if at:
        merged(touched(spark, name, at), new, key, buckets).write.mode("overwrite").insertInto(name)
    return at


def updated(base: DataFrame, last: DataFrame, key: str, buckets: int) -> DataFrame:
    """Stored rows with metadata and time of their update, if they have one."""
    upd = last.select(F.col(key).alias("_n"), F.struct("metadata", "now").alias("_u")).repartition(buckets, "_n")
    hit, new = F.col("_u").isNotNull(), {"metadata": "_u.metadata", "updated_at": "_u.now"}
    return base.join(upd.hint("merge"), F.col(key) == F.col("_n"), "left").select(*[
        F.when(hit, F.col(new[c])).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in base.columns])


def update_metadata(spark: SparkSession, name: str, updates: DataFrame) -> list[int]:
    """Set metadata and `updated_at` of stored rows, as `store.update_metadata`; returns
    the partitions looked at."""
    key, parts, buckets, _ = _shape(spark, name)
    last, at = _batch(latest_versions(updates.select(key, "metadata", "now"), key, ("now",)), key, parts)
    if at:
        updated(touched(spark, name, at), last, key, buckets).write.mode("overwrite").insertInto(name)
    return at


def delete(spark: SparkSession, name: str, ids: DataFrame) -> DataFrame:
    """Take rows away; (key, deleted, filepath) of every id asked for, as
    `store.delete_documents`. A partition that loses its last row loses its folder, since
    an overwrite without rows would leave it as it was."""
    key, parts, buckets, folder = _shape(spark, name)
    wanted, at = _batch(ids.select(key).distinct(), key, parts)
    asked = wanted.select(F.col(key).alias("_n")).repartition(buckets, "_n").hint("merge")
    base = touched(spark, name, at)
    stored = base.select(key, "filepath", F.lit(True).alias("_found"))
    outcome = materialize(asked.join(stored, F.col("_n") == F.col(key), "left").select(
        F.col("_n").alias(key), F.coalesce("_found", F.lit(False)).alias("deleted"), "filepath"))
    kept = base.join(asked, F.col(key) == F.col("_n"), "left_anti")
    left = {r[0] for r in kept.select(PART).distinct().collect()}
    had = {r[0] for r in base.select(PART).distinct().collect()}
    if left:
        kept.write.mode("overwrite").insertInto(name)
    for part in sorted(had - left):
        spark.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION ({PART} = {part})")
        files, gone = _folder(spark, f"{folder}/{PART}={part}")
        files.delete(gone, True)
    return outcome
