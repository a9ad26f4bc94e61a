"""Exact top-k by distributed histogram selection over integer inner products.

All candidates are scored against all queries, block against block. The first
pass counts each query's scores in BINS bins over the whole possible range; the
bin that holds its k-th highest score becomes the next range, until a bin is one
score wide. That score is the query's threshold. A last pass keeps what is above
it and, among equals, the smallest ids that are still wanted.

Histograms are sums, so partial aggregation meets them before any shuffle, and a
score shared by a third of all vectors is one number in a bin. No task holds more
than a block of queries and a block of candidates.

Vectors whose products could leave 64 bits are wide: they lie in rows of their own and
are multiplied in whole numbers of any size. Where there are any, histograms count codes
of the scores instead: their number of bits and the highest 51 of these, in the order of
the scores. Scores of the threshold's code are put in exact order at the end.
"""
from __future__ import annotations

from fractions import Fraction
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .common import stage

#: Vectors in a candidate block, candidate blocks whose queries form one query
#: block, candidate blocks that meet a query block under one join key.
BLOCK, QUERY_BLOCKS, MEET = 1024, 16, 16
BINS = 128
BLOCK_SCHEMA = "block long, dim int, wide boolean, ids binary, matrix binary, norm double"
#: Square norm from which a vector is wide, and a bound of all codes.
WIDE, CODES = 2.0 ** 61, 2200 << 50
LOW, HIGH = -2 ** 63, 2 ** 63 - 1


def _usable(embeddings: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    x = F.transform(F.col(vec_col), lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    norm = F.aggregate(x, F.lit(0.0), lambda a, v: a + (F.abs(v * scale) + 1) * (F.abs(v * scale) + 1))
    return (embeddings.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull())
            .where(finite).withColumn(vec_col, x)
            .select(F.col(id_col).cast("long").alias("id"), F.size(vec_col).alias("dim"),
                    F.when(norm < WIDE, F.transform(x, lambda v: F.floor(v * scale))).alias("vec"),
                    F.when(norm >= WIDE, x).alias("raw")).distinct())


def _whole(x: float, scale: float) -> int:
    """floor(scale * x), also where the product is no double."""
    y = x * scale
    return math.floor(y) if math.isfinite(y) else math.floor(Fraction(x) * Fraction(scale))


def _pack(scale: float):
    """One block's vectors of one dimension: the narrow ones as a matrix, wide ones as
    text; the largest of an id's."""
    def run(key, group):
        block, dim = key[0].as_py(), key[1].as_py()
        far = group.filter(pc.is_null(group["vec"]))
        ids, matrix = _dense(dim, group.filter(pc.is_valid(group["vec"])))
        wide: dict[int, list[int]] = {}
        for i, raw in zip(far["id"].to_pylist(), far["raw"].to_pylist()):
            vec = [_whole(x, scale) for x in raw]
            wide[i] = max(wide.get(i, vec), vec)
        stays = np.ones(len(ids), bool)
        for at in np.flatnonzero(np.isin(ids, list(wide))).tolist():
            if matrix[at].tolist() > wide[int(ids[at])]:
                del wide[int(ids[at])]
            else:
                stays[at] = False
        ids, matrix = ids[stays], matrix[stays]
        norm = float(np.max(np.sum(matrix.astype(float) ** 2, axis=1), initial=0))
        rows = [(block, dim, False, ids.astype(np.int64).tobytes(), matrix.tobytes(), norm)]
        if wide:
            order = sorted(wide)
            text = " ".join(str(x) for i in order for x in wide[i])
            rows.append((block, dim, True, np.array(order, np.int64).tobytes(), text.encode(), None))
        types = (pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.float64())
        return pa.table({c.split()[0]: pa.array(v, t) for c, v, t in
                         zip(BLOCK_SCHEMA.split(", "), zip(*rows), types)})
    return run


def _matrix(blob: bytes, n: int, dim: int, wide: bool) -> np.ndarray:
    if not wide:
        return np.frombuffer(blob, np.int64).reshape(n, dim)
    out = np.empty(n * dim, object)
    out[:] = [int(x) for x in blob.split()]
    return out.reshape(n, dim)


def _dense(dim: int, group: pa.Table):
    ids = group["id"].to_numpy()
    flat = pa.concat_arrays([c.flatten() for c in group["vec"].chunks]) if dim else pa.array([], "int64")
    matrix = flat.to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(ids), dim)
    order = np.lexsort([*matrix.T[::-1], ids])
    ids, matrix = ids[order], matrix[order]
    last = np.append(ids[1:] != ids[:-1], True) if len(ids) else np.zeros(0, bool)
    return ids[last], matrix[last]


def _query_block(every: int):
    def gather(key, group):
        ids, rows = [], []
        dim, wide = key[1].as_py(), key[2].as_py()
        for g in sorted(group.to_pylist(), key=lambda g: g["block"]):
            i = np.frombuffer(g["ids"], np.int64)
            ids.append(i[i % every == 0])
            rows.append(_matrix(g["matrix"], len(i), dim, wide)[i % every == 0])
        rows = np.concatenate(rows)
        return pa.table({"qb": [key[0].as_py()], "dim": pa.array([dim], "int32"), "wide": [wide],
                         "qids": [np.concatenate(ids).tobytes()],
                         "qmatrix": [" ".join(map(str, rows.ravel())).encode() if wide else rows.tobytes()]})
    return gather


def _scores(row: dict, exact: bool):
    """(query ids, ids, scores); a query's own id scores far below any range."""
    q, c = np.frombuffer(row["qids"], np.int64), np.frombuffer(row["ids"], np.int64)
    a = _matrix(row["qmatrix"], len(q), row["dim"], row["wide"])
    b = _matrix(row["matrix"], len(c), row["dim"], row["c_wide"])
    if row["wide"] or row["c_wide"]:
        s = a.astype(object) @ b.T.astype(object)
    else:
        s = a @ b.T if exact else np.rint(a.astype(float) @ b.T.astype(float)).astype(np.int64)
    own = q[:, None] == c[None, :]
    return q, c, s, own


def codes(s: np.ndarray) -> np.ndarray:
    """Of each score a number below CODES, never in another order than the scores."""
    if s.dtype == object:
        def one(v):
            m, bits = abs(v), abs(v).bit_length()
            top = m >> (bits - 51) if bits > 51 else m << (51 - bits)
            return (1 if v > 0 else -1) * ((bits << 50) + top - (1 << 50)) if m else 0
        return np.array([one(int(v)) for v in s.ravel()], np.int64).reshape(s.shape)
    m = np.abs(s)
    bits = np.frexp(m.astype(float))[1].astype(np.int64)
    bits -= (m >> np.maximum(bits - 1, 0)) == 0                # rounded up to a power of two
    bits = np.maximum(bits, 1)
    top = np.where(bits > 51, m >> np.maximum(bits - 51, 0), m << np.maximum(51 - bits, 0))
    return np.sign(s) * ((bits << 50) + top - (1 << 50))


def _tail(v: int) -> bytes | None:
    """Order of scores at the ends of 64 bits and beyond."""
    if LOW < v < HIGH:
        return None
    m = abs(v)
    b = m.bit_length().to_bytes(2, "big") + m.to_bytes(-(-m.bit_length() // 8), "big")
    return b if v > 0 else bytes(255 - x for x in b)


def _count(span: int, width: int, exact: bool, coded: bool):
    """Histogram of each query's scores from its `lo` up to `lo` + span, in BINS
    bins of a width; what lies above was counted before."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                q, _, s, own = _scores(row, exact)
                if not len(q):
                    continue
                s = codes(s) if coded else s
                over = s - np.frombuffer(row["lo"], np.int64)[:, None]
                ok = (over >= 0) & (over < span) & ~own
                bins = over // width
                at = (np.arange(len(q))[:, None] * BINS + bins)[ok]
                h = np.bincount(at, minlength=len(q) * BINS).reshape(len(q), BINS)
                yield pa.RecordBatch.from_pydict({
                    "qb": pa.array([row["qb"]] * len(q), "int64"),
                    "dim": pa.array([row["dim"]] * len(q), "int32"),
                    "wide": pa.array([row["wide"]] * len(q), pa.bool_()),
                    "pos": pa.array(np.arange(len(q)), "int32"),
                    "h": pa.FixedSizeListArray.from_arrays(pa.array(h.ravel()), BINS).cast(
                        pa.list_(pa.int64()))})
    return run


def _narrow(width: int):
    """From the summed histograms of a query block: each query's next `lo` and how
    many of the scores in that bin are wanted. With fewer scores than k, the
    lowest bin."""
    def run(key, group):
        rows = sorted(group.to_pylist(), key=lambda r: r["pos"])
        h = np.array([r["h"] for r in rows], np.int64)
        lo = np.frombuffer(rows[0]["lo"], np.int64)
        left = np.frombuffer(rows[0]["left"], np.int64)
        down = h[:, ::-1].cumsum(axis=1)                     # from the highest bin
        reached = down >= left[:, None]
        at = np.where(reached.any(axis=1), reached.argmax(axis=1), BINS - 1)
        above = np.where(at > 0, down[np.arange(len(at)), np.maximum(at - 1, 0)], 0)
        return pa.table({"qb": [key[0].as_py()], "dim": pa.array([key[1].as_py()], "int32"),
                         "wide": [key[2].as_py()],
                         "lo": [(lo + (BINS - 1 - at) * width).tobytes()],
                         "left": [(left - above).tobytes()]})
    return run


def _keep(exact: bool, coded: bool):
    """All scores above the threshold; of those equal to it, or of its code, this block's
    highest and smallest ids, as many as are wanted."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                q, c, s, own = _scores(row, exact)
                lo = np.frombuffer(row["lo"], np.int64)[:, None]
                left = np.frombuffer(row["left"], np.int64)[:, None]
                order = np.argsort(c, kind="stable")
                s, own, c = s[:, order], own[:, order], c[order]
                code = codes(s) if coded else s
                tie = (code == lo) & ~own
                if coded:
                    for n in np.flatnonzero(tie.sum(axis=1) > left[:, 0]).tolist():
                        at = sorted(np.flatnonzero(tie[n]).tolist(), key=lambda j: (-int(s[n, j]), j))
                        tie[n, at[int(left[n, 0]):]] = False
                else:
                    tie &= tie.cumsum(axis=1) <= left
                i, j = np.nonzero(((code > lo) & ~own) | tie)
                score = [int(v) for v in s[i, j]] if coded else s[i, j]
                yield pa.RecordBatch.from_pydict({
                    "query_id": pa.array(q[i], "int64"), "vec_id": pa.array(c[j], "int64"),
                    "score": pa.array([min(max(v, LOW), HIGH) for v in score] if coded else score, "int64"),
                    "tail": pa.array([_tail(v) for v in score] if coded else [None] * len(i), pa.binary())})
    return run


def top_k(embeddings: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0,
          id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of
    each query, all if there are fewer; equal scores in order of the smaller id.

    Components become floor(scale * x). Queries are the rows whose id is divisible
    by `every`; candidates are all other rows. Null ids and vectors that are null
    or hold a null or non-finite component take no part; repeated rows count once,
    of an id with several vectors the largest counts, and only vectors of the same
    length meet (empty ones score 0). Any finite component counts in full; a score beyond
    64 bits is ranked exactly and returned as the end of their range. Other columns, whatever their names, are not read. No rows: no rows.
    """
    spark = embeddings.sparkSession
    vectors = _usable(embeddings, id_col, vec_col, scale)
    n_blocks = max(1, -(-embeddings.count() // BLOCK))
    blocks = stage(vectors.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks)))
                   .groupBy("block", "dim").applyInArrow(_pack(scale), BLOCK_SCHEMA), "blocks")
    bound, coded = blocks.agg(F.max("norm"), F.max("wide")).first()
    if bound is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    bound = int(bound) + 1          # no inner product is larger than the largest square norm
    exact = bound >= 2 ** 52        # beyond that, floating point would round
    bound = CODES if coded else bound

    n_qb, n_meet = -(-n_blocks // QUERY_BLOCKS), -(-n_blocks // MEET)
    queries = stage(blocks.withColumn("qb", F.expr(f"block div {QUERY_BLOCKS}"))
                    .groupBy("qb", "dim", "wide").applyInArrow(
                        _query_block(every), "qb long, dim int, wide boolean, qids binary, qmatrix binary")
                    .where("length(qids) > 0"), "queries")
    n = F.expr("length(qids) div 8").cast("int")
    state = queries.select("qb", "dim", "wide", *[
        F.unhex(F.repeat(F.lit(np.int64(v).tobytes().hex()), n)).alias(c)
        for c, v in (("lo", -bound), ("left", k))])
    candidates = (blocks.select("dim", "ids", "matrix", F.col("wide").alias("c_wide"),
                                F.expr(f"block div {MEET}").alias("meet"))
                  .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_qb - 1)).cast("array<long>"))))

    def met(state: DataFrame) -> DataFrame:
        asked = queries.join(state, ["qb", "dim", "wide"]).withColumn(
            "meet", F.explode(F.sequence(F.lit(0), F.lit(n_meet - 1)).cast("array<long>")))
        return candidates.join(asked, ["qb", "meet", "dim"])

    width = 2 * bound + 1
    while width > 1:
        span, width = width, -(-width // BINS)
        counted = (met(state).mapInArrow(_count(span, width, exact, coded),
                                         "qb long, dim int, wide boolean, pos int, h array<long>")
                   .groupBy("qb", "dim", "wide", "pos")
                   .agg(F.array(*[F.sum(F.col("h")[i]) for i in range(BINS)]).alias("h")))
        state = stage(counted.join(state, ["qb", "dim", "wide"]).groupBy("qb", "dim", "wide").applyInArrow(
            _narrow(width), "qb long, dim int, wide boolean, lo binary, left binary"), "state")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("tail"), "vec_id")
    return (met(state).mapInArrow(_keep(exact, coded), "query_id long, vec_id long, score long, tail binary")
            .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
