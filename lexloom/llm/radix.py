"""Ranks of rows by a distributed LSD radix sort.

Rows lie in blocks of consecutive positions. A pass looks at one digit of the
composite key, least significant first. Every block counts its rows by digit; the
counts give, for each pair of digit and block, the position where its first row goes:
behind all rows of lesser digits and behind the rows of the same digit in earlier
blocks. A stable counting sort in each block then gives every row its destination,
and the rows move to the block that holds it. After the last pass positions are ranks.

No task holds more than a block, whatever the keys: equal keys have positions of
their own. A pass is written to shared storage, so that lost executors repeat one
pass only.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import shuffle_partitions, stage

#: Bits of a digit at most, and rows of a block at most.
DIGIT, BLOCK = 16, 1 << 20


def digits(varying: int, most: int = DIGIT) -> Iterator[tuple[int, int]]:
    """(shift, width) of digits that cover the bits in which keys differ, from the
    least significant one."""
    low = (varying & -varying).bit_length() - 1 if varying else 0
    bits = varying.bit_length() - low
    if bits:
        passes = -(-bits // most)
        width = -(-bits // passes)
        for shift in range(low, low + bits, width):
            if varying >> shift & (1 << width) - 1:
                yield shift, width


def _place(size: int):
    """Counting sort of one block: rows with their destinations."""
    def run(rows: pa.Table, starts: pa.Table) -> pa.Table:
        digit, pos = rows["_digit"].to_numpy(), rows["_pos"].to_numpy()
        arrived = np.argsort(pos, kind="stable")
        # On 16-bit numbers this is a stable sort by counting.
        order = arrived[np.argsort(digit[arrived].astype(np.uint16), kind="stable")]
        found, first, counts = np.unique(digit[order], return_index=True, return_counts=True)
        known = starts["_value"].to_numpy()
        by = np.argsort(known)
        start = starts["_start"].to_numpy()[by[np.searchsorted(known, found, sorter=by)]]
        to = np.empty(len(pos), np.int64)
        to[order] = np.repeat(start - first, counts) + np.arange(len(pos))
        out = rows.drop_columns(["_digit", "_block", "_pos"])
        return (out.append_column("_block", pa.array(to // size, pa.int64()))
                .append_column("_pos", pa.array(to, pa.int64())))
    return run


def sort_pass(rows: DataFrame, digit: Column, size: int, name: str) -> DataFrame:
    """One pass over rows with `_block` and `_pos`, written to shared storage."""
    rows = rows.withColumn("_digit", digit.cast("int"))
    counts = rows.groupBy("_block", "_digit").agg(F.count(F.lit(1)).alias("_n"))
    # One row for each digit value: at most 2 ** DIGIT in this window.
    lesser = (counts.groupBy("_digit").agg(F.sum("_n").alias("_n"))
              .select("_digit", (F.sum("_n").over(Window.orderBy("_digit")) - F.col("_n")).alias("_lesser")))
    earlier = F.sum("_n").over(Window.partitionBy("_digit").orderBy("_block")) - F.col("_n")
    starts = (counts.withColumn("_earlier", earlier).join(lesser, "_digit")
              .select(F.col("_block").alias("_from"), F.col("_digit").alias("_value"),
                      (F.col("_lesser") + F.col("_earlier")).alias("_start")))
    fields = rows.drop("_digit", "_block", "_pos").schema
    moved = (rows.groupBy("_block").cogroup(starts.groupBy("_from"))
             .applyInArrow(_place(size), fields.add("_block", "long").add("_pos", "long")))
    return stage(moved, name)


def radix_ranks(rows: DataFrame, keys: list[Column], rank: str = "rank", block: int = BLOCK) -> DataFrame:
    """The rows, which must be a stored table, with their place from 1 on by the given
    keys, the most significant first. Keys are longs compared as unsigned numbers;
    digits that all rows share take no pass. Rows with equal keys keep their order in
    the table."""
    facts = rows.agg(F.count(F.lit(1)).alias("n"), *[
        F.bit_or(k).bitwiseXOR(F.bit_and(k)).alias(f"k{i}") for i, k in enumerate(keys)]).first()
    n = facts["n"]
    blocks = max(2 * shuffle_partitions(rows.sparkSession), -(-n // block))
    size = max(1, -(-n // blocks))
    row = F.monotonically_increasing_id()
    rows = stage(rows.withColumn("_pos", row)
                 .withColumn("_block", F.shiftright("_pos", min(block, size).bit_length())), "radix-0")
    passes = [(k, shift, width) for i, k in reversed(list(enumerate(keys)))
              for shift, width in digits((facts[f"k{i}"] or 0) & (1 << 64) - 1)]
    # With no pass at all every row is alike; one over a constant numbers them.
    for i, (k, shift, width) in enumerate(passes or [(F.lit(0).cast("long"), 0, 1)], 1):
        digit = F.shiftrightunsigned(k, shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        rows = sort_pass(rows, digit, size, f"radix-{i}")
    return rows.withColumn(rank, F.col("_pos") + 1).drop("_block", "_pos")
