"""Sharding by a hierarchical weighted hash tree, with gapless slots.

A topology has one row per shard: region, rack, shard and weight. A row descends
from region to rack to shard. At each level every child draws -ln(u) / weight with
u a hash of the row's key and the child's name; the smallest draw wins, so each
child gets its share of the weight. A changed weight leaves all other draws as
they are: rows only move into children whose weight grew and out of those whose
weight shrank, and below untouched nodes nothing moves. Only built-in functions
are used, and no shuffle is needed to find the shard.

A shard added by `topology` opens a region of its own. At the region level rows
then move only into that region, and it has only the new shard to give them to.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: The layout of the first shards: racks to a region, shards to a rack.
RACKS, SHARDS = 4, 5


def topology(n_shards: int, base: int = 40) -> list[tuple[str, str, int, float]]:
    """(region, rack, shard, weight) of shards 0 to n - 1, all of weight 1: the
    first `base` in racks of SHARDS and regions of RACKS, each later one alone."""
    rows = []
    for s in range(n_shards):
        rack = s // SHARDS
        region = rack // RACKS
        rows.append((f"region{region}", f"rack{rack}", s, 1.0) if s < base
                    else (f"region-of-{s}", f"rack-of-{s}", s, 1.0))
    return rows


def _draw(key: Column, level: str, name: str, weight: float) -> Column:
    # 52 bits of the hash, moved off zero, are a number between 0 and 1.
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(level), F.lit(name)), 12)
    return -F.log((bits + 0.5) / F.lit(float(2 ** 52))) / F.lit(float(weight))


def _choose(key: Column, level: str, children: dict[str, float]) -> Column:
    """The name of the child with the smallest draw; equal draws: the smaller name."""
    names = sorted(children)
    if len(names) == 1:
        return F.lit(names[0])
    return F.least(*[F.struct(_draw(key, level, n, children[n]).alias("draw"),
                              F.lit(n).alias("name")) for n in names])["name"]


def assign_shard(df: DataFrame, key: Column, shards: list[tuple[str, str, int, float]],
                 out: str) -> DataFrame:
    """Add the int column `out`, the shard of a key (null keys count as one key).
    Shards of weight 0 or less get nothing. The list describes the storage and
    does not grow with the rows."""
    shards = [s for s in shards if s[3] > 0]
    racks: dict = {}
    regions: dict = {}
    for region, rack, shard, weight in shards:
        leaf = racks.setdefault((region, rack), {})
        leaf[str(shard)] = leaf.get(str(shard), 0) + weight
        node = regions.setdefault(region, {})
        node[rack] = node.get(rack, 0) + weight
    # One column a level: each is computed once, and only the chosen node's draws.
    df = df.withColumn("_region", _choose(key, "region",
                                          {r: sum(n.values()) for r, n in regions.items()}))
    rack = shard = None
    for region, children in regions.items():
        hit, pick = F.col("_region") == region, _choose(key, f"rack {region}", children)
        rack = rack.when(hit, pick) if rack is not None else F.when(hit, pick)
    df = df.withColumn("_rack", rack)
    for (region, name), children in racks.items():
        hit = (F.col("_region") == region) & (F.col("_rack") == name)
        pick = _choose(key, f"shard {region} {name}", children)
        shard = shard.when(hit, pick) if shard is not None else F.when(hit, pick)
    return df.withColumn(out, shard.cast("int")).drop("_region", "_rack")


#: Slots are counted within this many hash buckets of a shard, side by side.
BUCKETS = 1024
#: Bytes that a row takes besides its text.
ROW_BYTES = 16


def shard_documents(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id",
                    text_col: str = "text", base: int = 40, buckets: int = BUCKETS) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard), one row per input row.

    The id and the number of shards decide (law `key`); `grown_shard` is the shard
    with one more. size: UTF-8 bytes of the text plus 16; text_crc32: of those
    bytes; null and empty texts are alike. Slots count each shard's rows from 0 by
    hash bucket, id, size and checksum. Null ids count as one id; repeated rows get
    a slot each. Other columns, whatever their names, are not read.

    The texts are not shuffled. Equal (id, size, checksum) rows are counted first,
    so no repeated row makes a hot bucket; a running sum over the bucket counts,
    `buckets` numbers for each shard, gives every bucket its first slot.
    """
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    keys = ["id", "size", "text_crc32"]
    rows = (docs.select(F.col(id_col).alias("id"),
                        (F.octet_length(text) + ROW_BYTES).cast("bigint").alias("size"),
                        F.crc32(text).alias("text_crc32"))
            .groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")))
    rows = assign_shard(rows, F.col("id"), topology(n_shards, base), "shard")
    rows = assign_shard(rows, F.col("id"), topology(n_shards + 1, base), "grown_shard")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))

    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    first = (rows.groupBy("shard", "bucket").agg(F.sum("copies").alias("n"))
             .select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")))
    inside = Window.partitionBy("shard", "bucket").orderBy(*keys).rowsBetween(
        Window.unboundedPreceding, -1)
    return (rows.withColumn("ahead", F.coalesce(F.sum("copies").over(inside), F.lit(0)))
            .join(first, ["shard", "bucket"])
            .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)))
            .select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"),
                    "shard", (F.col("first") + F.col("ahead") + F.col("copy")).alias("slot"),
                    "grown_shard"))
