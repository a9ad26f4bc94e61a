"""Documents drawn by their likeness to a target distribution.

Words of all documents and of the target texts are counted in hashed buckets; the
bucket's gain is the logarithm of its share in the target against its share in the
documents. A document's weight is the mean gain of its features, looked up in an
array. Weights with Gumbel noise from the document's id are the scores, and the
documents of the highest scores are a sample without replacement in proportion to the
weights. The ranks come from a distributed radix sort (`radix`).

Texts are read once: the buckets of their features are stored, 2 bytes each, and both
the counts and the weights are taken from them. Only the bucket counts, whose number
is a parameter, meet in one place.
"""
from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import stage
from .radix import radix_ranks

BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Features whose buckets a task remembers at most, and the longest it remembers.
CACHE, CACHE_LENGTH = 1_000_000, 64

# Bytes outside words (all ASCII but digits and letters) become blanks, A-Z become a-z.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32
               for b in range(256))


class _Buckets(dict):
    """Buckets by feature, computed when first asked for."""

    def __init__(self, n: int):
        self.n = n

    def __missing__(self, feature: bytes) -> int:
        bucket = zlib.crc32(feature) % self.n
        if len(feature) <= CACHE_LENGTH:
            if len(self) >= CACHE:
                self.clear()
            self[feature] = bucket
        return bucket


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").translate(_PLAIN).split()


def features_of(words: list[bytes], longest: int) -> list[bytes]:
    """All runs of 1 to `longest` consecutive words."""
    found = words
    for n in range(2, longest + 1):
        found = found + [b" ".join(words[i:i + n]) for i in range(len(words) - n + 1)]
    return found


def _hash_features(n: int, longest: int, ids: bool):
    kind = np.uint16 if n <= 1 << 16 else np.uint32

    def run(batches):
        bucket = _Buckets(n).__getitem__
        for batch in batches:
            words, data = [], []
            for text in batch["text"]:
                found = words_of(text.as_py())
                words.append(len(found))
                found = features_of(found, longest)
                data.append(np.fromiter(map(bucket, found), kind, len(found)).tobytes())
            yield pa.RecordBatch.from_arrays(
                [*([batch["id"]] if ids else []), pa.array(words, pa.int64()), pa.array(data, pa.binary())],
                [*["id"] * ids, "n_words", "buckets"])
    return run


def _count(n: int):
    kind = np.uint16 if n <= 1 << 16 else np.uint32

    def run(batches):
        counts = np.zeros(n, np.int64)
        for batch in batches:
            for data in batch["buckets"]:
                counts += np.bincount(np.frombuffer(data.as_buffer(), kind), minlength=n)
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(counts[found], pa.int64())],
                                         ["bucket", "n"])
    return run


def _counts(hashed: DataFrame, n: int) -> list[int]:
    """Features in each bucket; as many rows reach the driver as there are buckets."""
    rows = (hashed.select("buckets").mapInArrow(_count(n), "bucket int, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")).collect())
    counts = [0] * n
    for bucket, found in rows:
        counts[bucket] = found
    return counts


def gains_of(source: list[int], target: list[int]) -> list[int]:
    """floor(1000 ln(share in the target / share in the source)) of each bucket, one
    feature more in every bucket."""
    n, s_all, t_all = len(source), sum(source), sum(target)
    return [math.floor(1000 * math.log((t + 1) * float(s_all + n) / ((s + 1) * float(t_all + n))))
            for s, t in zip(source, target)]


def noise(doc_id, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _score(gains: list[int], seed: int):
    gains = np.array(gains, np.int64)
    kind = np.uint16 if len(gains) <= 1 << 16 else np.uint32

    def run(batches):
        for batch in batches:
            lengths, weights = [], []
            for data in batch["buckets"]:
                found = np.frombuffer(data.as_buffer(), kind)
                lengths.append(len(found))
                weights.append(int(gains[found].sum()) // len(found) if len(found) else 0)
            scores = [w + noise(i, seed) for w, i in zip(weights, batch["id"].to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["n_words"], *[pa.array(x, pa.int64()) for x in (lengths, weights, scores)]],
                ["id", "n_words", "n_features", "weight", "score"])
    return run


def importance_sample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS,
                      longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED,
                      id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """(id, n_features, weight, score, rank), one row for each row of `docs`.

    Words are runs of digits, letters a-z after lower-casing A-Z, and characters beyond
    ASCII; features are the runs of 1 to `longest` words. Of the N documents with at
    least `least_words` words, floor(percent N / 100) are drawn; `rank` is their place
    by score, ties to the smaller id, and null for all others. Ids are integers; a null
    id counts as less than all others and as an empty string in the noise. Rows that
    agree in id and score are ranked in the order of the table. A null text has no
    words; documents without features have weight 0. No documents: no rows; no target:
    every gain goes by the documents alone. Other columns, whatever their names, are
    not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    hashed = stage(rows.mapInArrow(_hash_features(buckets, longest, True),
                                   "id long, n_words long, buckets binary"), "features")
    goal = target.select(F.col(target_text).alias("text")).mapInArrow(
        _hash_features(buckets, longest, False), "n_words long, buckets binary")
    gains = gains_of(_counts(hashed, buckets), _counts(goal, buckets))
    fields = "id long, n_words long, n_features long, weight long, score long"
    scored = stage(hashed.mapInArrow(_score(gains, seed), fields), "scored")
    long_enough = F.col("n_words") >= least_words
    able = scored.where(long_enough)
    facts = able.agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("most")).first()
    drawn = percent * facts["n"] // 100
    keys = [F.lit(facts["most"] or 0) - F.col("score"), F.col("id").isNotNull().cast("long"),
            F.coalesce("id", F.lit(0)).bitwiseXOR(F.lit(-1 << 63))]
    ranked = radix_ranks(able, keys)
    columns = [F.col("id").alias(id_col), "n_features", "weight", "score"]
    return ranked.select(*columns, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank")).unionByName(
        scored.where(~long_enough).select(*columns, F.lit(None).cast("long").alias("rank")))
