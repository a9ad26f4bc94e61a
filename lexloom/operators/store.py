"""The document table: upsert, update, lookup, listing, delete, schema.

Every operator maps tables to tables. Versions of one document are reduced on the
map side before the shuffle, so an id with very many versions is no hot key.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T

DOCUMENT_SCHEMA = T.StructType([
    T.StructField("document_id", T.StringType(), False),
    T.StructField("filename", T.StringType()),
    T.StructField("filepath", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("metadata", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
])


def is_stored(df: DataFrame) -> bool:
    """Whether a DataFrame is a table of files as it lies there: to read it again costs
    a scan of the columns asked for and no other work."""
    return df._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation"


def latest_versions(df: DataFrame, key: str = "document_id", order=("updated_at",),
                    stored: bool | None = None) -> DataFrame:
    """The last row per key by the order columns; equal ones by a hash of the row. Equal
    rows count once.

    Computed rows take one shuffle with a partial maximum: of each task at most one row
    a key travels. A stored table is read twice instead: first key and order alone,
    without the wide columns, then the rows that have a key's last order; those that
    tie are settled by a partial minimum of the hash."""
    rest = [c for c in df.columns if c != key and c not in order]
    row, digest = F.struct(*df.columns), F.xxhash64(*rest) if rest else F.lit(0).cast("long")
    if is_stored(df) if stored is None else stored:
        best = (df.groupBy(key).agg(F.max(F.struct(*order)).alias("_b"))
                .select(F.col(key).alias("_k"), *[F.col(f"_b.{c}").alias(f"_b_{c}") for c in order]))
        same = [F.col(key).eqNullSafe(F.col("_k"))] + [F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in order]
        df = df.join(best, reduce(lambda a, b: a & b, same), "left_semi")
        last = F.min_by(row, digest)
    else:
        last = F.max_by(row, F.struct(*order, F.bitwise_not(digest).alias("_h")))
    return df.groupBy(F.col(key).alias("_k")).agg(last.alias("_r")).select("_r.*")


def upsert_documents(base: DataFrame, incoming: DataFrame, key: str = "document_id",
                     order=("updated_at",)) -> DataFrame:
    """Insert or replace: an incoming row replaces the stored one whole, so
    both timestamps are the incoming ones and metadata not given is cleared.
    Of several incoming versions the last counts. Applying the same batch again
    changes nothing."""
    new = latest_versions(incoming, key, order)
    kept = base.join(new.select(key), key, "left_anti")
    return align_schema(kept, base.schema).unionByName(align_schema(new, base.schema))


def update_metadata(base: DataFrame, updates: DataFrame, key: str = "document_id") -> DataFrame:
    """Set `metadata` and `updated_at` where an update (key, metadata, now)
    exists; `created_at` stays and updates without a document are ignored. Of
    several updates for one document the last counts."""
    last = latest_versions(updates.select(key, "metadata", "now"), key, ("now",))
    upd = last.select(key, F.struct("metadata", "now").alias("_u"))
    hit = F.col("_u").isNotNull()
    joined = base.join(upd, key, "left")
    return joined.select(*[
        F.when(hit, F.col("_u.metadata")).otherwise(F.col(c)).alias(c) if c == "metadata"
        else F.when(hit, F.col("_u.now")).otherwise(F.col(c)).alias(c) if c == "updated_at"
        else F.col(c) for c in base.columns])


def get_document(df: DataFrame, document_id, key: str = "document_id") -> DataFrame:
    """Rows of one id; the equality reaches the Parquet scan."""
    return df.where(F.col(key) == F.lit(document_id))


def list_documents(df: DataFrame, key: str = "document_id") -> DataFrame:
    """Newest first; equal times in key order."""
    return df.orderBy(F.col("created_at").desc(), F.col(key))


def list_page(df: DataFrame, size: int, after: tuple | None = None, key: str = "document_id") -> DataFrame:
    """The next `size` rows of `list_documents` behind a cursor, the (created_at, key) of
    the last row seen; NULL times come last. Each task keeps `size` rows in a heap and
    files whose statistics lie before the cursor are not read. Pages put together are the
    whole list; a row added meanwhile moves no other between pages."""
    at = F.col("created_at")
    if after is not None:
        time, last = after
        ties = F.col(key) > F.lit(last)
        if time is None:
            df = df.where(at.isNull() & ties)
        else:
            time = F.lit(time).cast("timestamp")
            df = df.where(at.isNull() | ((at <= time) & ((at < time) | ties)))
    return df.orderBy(at.desc(), F.col(key)).limit(size)


def delete_documents(base: DataFrame, ids: DataFrame, key: str = "document_id"):
    """(remaining, outcome): documents left, and per requested id whether it
    was found and which file it had."""
    wanted = ids.select(key).distinct()
    remaining = base.join(wanted, key, "left_anti")
    stored = base.select(key, "filepath", F.lit(True).alias("_found"))
    outcome = wanted.join(stored, key, "left").select(
        key, F.coalesce("_found", F.lit(False)).alias("deleted"), "filepath")
    return remaining, outcome


def align_schema(df: DataFrame, schema: T.StructType = DOCUMENT_SCHEMA) -> DataFrame:
    """Columns of the schema in its order; a missing one is added as NULL."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType)
                       .alias(f.name) for f in schema.fields])
