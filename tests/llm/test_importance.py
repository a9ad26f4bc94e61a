"""Importance resampling and the radix sort against plain Python."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexloom.llm import importance_sample as I
from lexloom.llm.common import stage
from lexloom.llm.radix import digits, radix_ranks

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(docs, target, longest=1, n=10_000, least=20, percent=10):
    def features(text):
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(words), [zlib.crc32(" ".join(words[i:i + k]).encode()) % n
                            for k in range(1, longest + 1) for i in range(len(words) - k + 1)]
    found = [features(t) for _, t in docs]
    s, t = Counter(b for _, f in found for b in f), Counter(b for x in target for b in features(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + n) / ((s[b] + 1) * (t_all + n)))) for b in range(n)]
    rows = []
    for (i, _), (words, f) in zip(docs, found):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((words, i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + .5) / 2 ** 32)))))
    able = sorted((r for r in rows if r[0] >= least), key=lambda r: (-r[4], r[1] is not None, r[1] or 0))
    rank = {r[1]: k for k, r in enumerate(able[:percent * len(able) // 100], 1)}
    return {(i, m, w, x, rank.get(i) if words >= least else None) for words, i, m, w, x in rows}


def tables(spark, docs, target):
    clash = [F.lit(1).alias(c) for c in ("id", "rank", "score", "_pos", "_block", "bucket", "n")]
    return (spark.createDataFrame(docs, "doc_id long, text string").select("*", *clash),
            spark.createDataFrame([(t,) for t in target], "text string").select("*", *clash))


def texts(rng, n):
    vocabulary = ["Der", "straße", "x1", "été", "日本", "THE", "of", "a-b"] + [f"w{i}" for i in range(60)]
    return [rng.choice([" ", "\n", "."]).join(rng.choices(vocabulary, k=rng.choice([0, 3, 19, 20, 21, 80])))
            for _ in range(n)]


@pytest.mark.parametrize("longest", [1, 2])
def test_sample(spark, longest):
    rng = random.Random(1)
    docs = list(enumerate(texts(rng, 400), -7)) + [(900, None), (901, ""), (None, "word " * 30), (1 << 60, "w1 " * 25)]
    target = texts(rng, 12) + [None, ""]
    got = I.importance_sample(*tables(spark, docs, target), longest=longest, percent=30)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert {tuple(r) for r in got.collect()} == brute(docs, target, longest, percent=30)


def test_repeated_rows_and_ids(spark):
    docs = [(5, "a b " * 20)] * 40 + [(i, "a b " * 20) for i in range(6, 20)]
    got = I.importance_sample(*tables(spark, docs, []), percent=100).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 55))
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["rank"])]
    assert len(set(order[order.index(5):order.index(5) + 40])) == 1         # equal rows lie together
    ties = [(-r["score"], r["doc_id"]) for r in sorted(got, key=lambda r: r["rank"])]
    assert ties == sorted(ties)


def test_empty_tables(spark):
    docs, target = tables(spark, [(1, "a " * 30)], ["a"])
    assert I.importance_sample(docs.limit(0), target).count() == 0
    row = I.importance_sample(docs, target.limit(0), percent=100).first()
    assert row["rank"] == 1 and row["n_features"] == 30
    assert I.importance_sample(*tables(spark, [(1, "few words"), (2, None)], ["a"])).where("rank is null").count() == 2


def test_digits():
    for varying in (0, 1, 0b1000, 0xFFFF, 0x1FFFF, 1 << 63, (1 << 64) - 1, 0xFF0000FF):
        found = list(digits(varying))
        assert all(width <= 16 for _, width in found) and found == sorted(found)
        covered = sum((1 << width) - 1 << shift for shift, width in found)
        assert covered & varying == varying
        assert len({s for s, _ in found}) == len(found)


@pytest.mark.parametrize("block", [1, 7, 1 << 20])
def test_radix_ranks(spark, block):
    rng = random.Random(3)
    rows = [(rng.choice([0, 1, 5, 1 << 40]), rng.randrange(1 << 18), i) for i in range(700)]
    rows += [(3, 3, i) for i in range(700, 1000)]                           # a third of the rows alike
    df = stage(spark.createDataFrame(rows, "a long, b long, i long").repartition(3), "rows")
    got = radix_ranks(df, [F.col("a"), F.col("b")], block=block).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 1001))
    assert [(r["a"], r["b"]) for r in sorted(got, key=lambda r: r["rank"])] == sorted((a, b) for a, b, _ in rows)


def test_radix_is_stable(spark):
    df = stage(spark.range(500).select((F.col("id") % 2).alias("a"), "id").coalesce(1), "rows")
    got = [(r["a"], r["id"]) for r in sorted(radix_ranks(df, [F.col("a")]).collect(), key=lambda r: r["rank"])]
    assert got == sorted(got)


def test_unsigned_keys(spark):
    df = stage(spark.createDataFrame([(x,) for x in (-1, 5, 0, -(1 << 63))], "a long"), "rows")
    got = [r["a"] for r in sorted(radix_ranks(df, [F.col("a")]).collect(), key=lambda r: r["rank"])]
    assert got == [0, 5, -(1 << 63), -1]
