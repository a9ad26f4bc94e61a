"""Jaccard join, components, decontamination and passages against plain Python."""
import random
import time
import re
import string
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from lexloom.llm import components as C, decontaminate as D, jaccard_join as J, substring_dedup as S
from lexloom.llm.shingles import shingle_hashes, shingle_set, word_hashes

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
VOCABULARY = [f"w{i}" for i in range(400)] + ["Été", "straße", "x y"]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def sets_of(text):
    w = words_of(text)
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    return [find(x) for x in range(n)]


def brute_rows(rows):
    """(id, size of the set, component) of each row, in order."""
    sets = [sets_of(t) for _, t in rows]
    holders, links = defaultdict(list), []
    for a, s in enumerate(sets):
        shared = Counter(b for x in s for b in holders[x])
        links += [(a, b) for b, k in shared.items() if 100 * k >= 80 * (len(s) + len(sets[b]) - k)]
        for x in s:
            holders[x].append(a)
    found = roots(len(rows), links)
    least = {}
    for (i, _), r in zip(rows, found):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return [(i, len(s), least.get(r)) for (i, _), s, r in zip(rows, sets, found)]


def brute_components(rows):
    return sorted(brute_rows(rows), key=repr)


def corpus(seed, n=120):
    """Texts with exact and near copies, chains of edits, and shared passages."""
    rng = random.Random(seed)
    text = lambda k: rng.choices(VOCABULARY, k=k)
    passage = text(70)
    out = []
    for _ in range(n):
        base = text(rng.randrange(3, 160))
        if rng.random() < 0.4:
            base[len(base) // 2:len(base) // 2] = passage
        out.append(base)
        for _ in range(rng.choice([0, 0, 1, 4, 12])):
            base = list(base)
            for _ in range(rng.choice([0, 1, 1, 2])):
                base[rng.randrange(len(base))] = rng.choice(VOCABULARY)
            out.append(base)
    rng.shuffle(out)
    return [rng.choice([" ", "\t", "\n "]).join(w) for w in out]


def awkward(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").select(
        "*", *[F.lit("x").alias(c) for c in ("id", "class", "token", "kind", "bucket", "n", "root", "key", "u")])


def test_word_and_shingle_hashes():
    for text in ("", " ", "a", "A  b\tC\r\nd", "É é x y   z", "a b " * 30, "\ud800 lone"):
        h, first, end, data = word_hashes(text)
        words = words_of(text)
        assert [data[a:b].decode("utf-8", "surrogatepass") for a, b in zip(first, end)] == words
        assert len(set(h.tolist())) == len(set(words))
        assert len(shingle_set(text)) == len(sets_of(text))
    long = " ".join(f"w{i % 5000}" for i in range(400_000))               # several stretches
    h = word_hashes(long)[0]
    assert len(h) == 400_000 and (h[:5000] == h[5000:10000]).all() and len(np.unique(h)) == 5000


@pytest.mark.parametrize("task_edges", [0, 10**6])
def test_components(spark, monkeypatch, task_edges):
    monkeypatch.setattr(C, "TASK_EDGES", task_edges)
    rng = random.Random(4)
    edges = ([(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 300)]
             + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(350)] + [(5, 5)])
    got = {r.node: r.root for r in C.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    nodes = sorted({x for e in edges if e[0] != e[1] for x in e})
    place = {x: i for i, x in enumerate(nodes)}
    found = roots(len(nodes), [(place[a], place[b]) for a, b in edges if a != b])
    least = {}
    for x, r in zip(nodes, found):
        least.setdefault(r, x)
    assert got == {x: least[r] for x, r in zip(nodes, found)}
    assert C.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_jaccard(spark, monkeypatch):
    monkeypatch.setattr(J, "BUCKET", 1000)                                # many buckets
    monkeypatch.setattr(J, "MEMBERS", 4)                                  # and blocks
    texts = corpus(1)
    rows = list(enumerate(texts)) + [(5000, None), (5001, ""), (5002, " \t"), (None, texts[0]), (None, "alone it is"),
                                     (3, texts[3]), (3, texts[3]), (7, texts[9]), (5003, "one two"), (5004, "ONE two")]
    got = sorted((tuple(r) for r in J.jaccard_components(awkward(spark, rows)).collect()), key=repr)
    assert got == brute_components(rows)
    kept = J.one_of_each(awkward(spark, rows))
    assert len(kept.columns) == 11
    got = sorted(((r.doc_id, r.text) for r in kept.collect() if r.doc_id is not None),
                 key=lambda r: (r[0], r[1] or ""))
    assert got == sorted({row for row, (i, _, c) in zip(rows, brute_rows(rows)) if i is not None and i == c},
                         key=lambda r: (r[0], r[1] or ""))
    assert [r.text for r in kept.collect() if r.doc_id is None] == ["alone it is"]
    assert J.jaccard_components(awkward(spark, [])).count() == 0
    assert J.jaccard_components(awkward(spark, [(1, None)])).collect()[0] == (1, 0, 1)


def test_one_of_each_of_repeated_ids(spark):
    """Each row of a repeated id goes by its own text, and one row stays of each component."""
    new = lambda c: " ".join(f"{c}{k}" for k in range(60))
    a, b, c = new("a"), new("b"), new("c")
    rows = [(3, a), (7, a + " x"), (7, b), (9, b + " y"), (11, c), (11, c + " z"), (11, c), (12, c + " w"),
            (13, ""), (13, b), (13, ""), (14, a)]
    kept = sorted((r.doc_id, r.text) for r in J.one_of_each(awkward(spark, rows)).collect())
    assert [(i, t) for i, t in kept if i != 11] == [(3, a), (7, b), (13, "")]
    assert [t in (c, c + " z") for i, t in kept if i == 11] == [True]


def test_frequent_tokens_of_blocks(spark, monkeypatch):
    """The scan's and the buckets' own steps, with tokens that travel as counts."""
    import pyarrow as pa

    monkeypatch.setattr(J, "BLOCK", 2000)
    monkeypatch.setattr(J, "FREQUENT", 3)
    texts = corpus(2, 60)
    n, batch = 3, lambda t: pa.RecordBatch.from_pydict({"id": pa.array(range(len(t)), pa.int64()), "text": t})
    rows = [r for half in (texts[::2], texts[1::2]) for b in J._scan(n, 5)(iter([batch(half)])) for r in b.to_pylist()]
    assert {r["kind"] for r in rows} == {0, 2, 4, 5}
    group = lambda rows, b: pa.Table.from_batches([J._rows(pa.int64(), [r for r in rows if r["bucket"] == b])])
    out = [r for b in range(n) for r in J._frequencies(n)(None, group(rows, b)).to_pylist()]
    found = {}
    for b in range(n):
        for r in J._prefixes(80)(None, group([r for r in out if r["kind"] != 0], b)).to_pylist():
            assert r["class"] not in found
            found[r["class"]] = set(r["tokens"])
    sets = {J.class_key(shingle_set(t)): set(shingle_set(t).view(np.int64).tolist()) for t in texts}
    count = Counter(x for s in sets.values() for x in s)
    for k, s in sets.items():
        shared = {x for x in s if count[x] > 1}
        if k in found:
            assert found[k] == shared
        else:                                    # its unique tokens fill the prefix
            assert len(s) - len(shared) >= len(s) - -(-80 * len(s) // 100) + 1


def test_leaks(spark):
    rng = random.Random(6)
    items = [(i, " ".join(rng.choices(VOCABULARY, k=rng.choice([3, 5, 20, 60])))) for i in range(20)]
    items += [(90, None), (91, ""), (None, "w1 w2 w3 w4 w5 w6"), (5, items[5][1]), (92, "... !!")]
    rows = []
    for k in range(80):
        w = rng.choice(items[:20])[1].upper().split()
        if k % 4 == 1:
            w[rng.randrange(len(w))] = "edited"
        if k % 4 == 2:
            w = w[rng.randrange(3):]
        rows.append((k, " ".join(rng.choices(VOCABULARY, k=rng.randrange(30)) + w
                                 + rng.choices(VOCABULARY, k=rng.randrange(30))).replace(" W1", ", W1")))
    rows += [(200, None), (201, ""), (None, rows[0][1]), (3, rows[3][1]), (202, "w1")]
    bare = lambda t: words_of(re.sub(r"[!-/:-@\[-`{-~]", " ", (t or "").lower()))
    parts = lambda w: Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4)))
    want = set()
    for d, t in rows:
        w = bare(t)
        for i, text in items:
            v = bare(text)
            if i is None or not v or not w:
                continue
            n = min(len(v), len(w))
            for s in range(len(w) - n + 1):
                both = sum((parts(w[s:s + n]) & parts(v)).values())
                if 100 * both >= 80 * sum((parts(w[s:s + n]) | parts(v)).values()):
                    want.add((d, i))
                    break
    docs = awkward(spark, rows).withColumn("item_id", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = D.find_leaks(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(want) > 40
    kept = D.drop_leaks(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(repr(r.doc_id) for r in kept.collect()) == sorted(
        repr(d) for d, _ in rows if d not in {x for x, _ in want})
    assert D.find_leaks(docs, bench.limit(0)).count() == 0
    assert D.drop_leaks(docs.limit(0), bench).count() == 0


def test_leaks_in_slices(spark, monkeypatch):
    items = [(i, " ".join(f"v{i}x{k}" for k in range(12))) for i in range(6)]
    docs = awkward(spark, [(i, "a b " + t + " c") for i, t in items] + [(50, "clean text of few words")])
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(D, "SLICE_CHARS", 200)
    assert sorted((r.doc_id, r.item_id) for r in D.find_leaks(docs, bench).collect()) == [(i, i) for i in range(6)]
    assert [r.doc_id for r in D.drop_leaks(docs, bench).collect()] == [50]


def test_multi_index_finds_all_within_the_radius():
    rng = np.random.default_rng(1)
    index = D.Index([(i, " ".join(f"q{rng.integers(10**6)}" for _ in range(20))) for i in range(50)])
    _, prints, _ = index.index[20]
    for _ in range(500):
        p = prints[rng.integers(50)].copy()
        for bit in rng.choice(64, rng.integers(0, 30), replace=False):
            p[bit // 8] ^= 1 << (bit % 8)
        near = set(np.flatnonzero(np.bitwise_count(prints ^ p).sum(axis=1) <= D.RADIUS).tolist())
        assert set(index.within(20, p)) == near


def exact_windows(rows, n=51):
    """Documents and places of n-word windows that another text or row holds."""
    held = defaultdict(set)
    for row, (_, t) in enumerate(rows):
        for h in set(shingle_hashes(word_hashes(t or "")[0], n).tolist()) if len(words_of(t)) >= n else ():
            held[h].add(row)
    return [(row, p) for row, (_, t) in enumerate(rows) if len(words_of(t)) >= n
            for p, h in enumerate(shingle_hashes(word_hashes(t)[0], n).tolist()) if len(held[h]) > 1]


def test_passages(spark, monkeypatch):
    rng = random.Random(8)
    new = lambda k: [f"n{rng.randrange(10**6)}" for _ in range(k)]
    passages = [new(60), new(90), new(200)]
    rows = []
    for k in range(150):
        body = new(rng.randrange(40, 120))
        if k % 3 == 0:
            p = list(rng.choice(passages))
            if k % 2:                                                    # fuzzy: an edit every 15 words
                for i in range(7, len(p), 15):
                    p[i:i + 1] = new(rng.choice([0, 1, 2]))
            body[20:20] = p
        rows.append((k, " ".join(body)))
    rows += [(500, rows[1][1]), (501, rows[0][1]), (600, None), (601, ""), (602, "short text"), (None, rows[2][1]),
             (4, rows[4][1])]
    got = S.repeated_passages(awkward(spark, rows)).collect()
    spans = defaultdict(list)
    for r in got:
        assert r.n_words == r.end_word - r.first_word >= 50
        spans[r.doc_id].append((r.first_word, r.end_word))
    for row, p in exact_windows(rows):
        assert any(a <= p and p + 51 <= b for a, b in spans[rows[row][0]]), (rows[row][0], p)
    holders = {k for k in range(150) if k % 3 == 0} | {1, 2, 4, 500, 501, None}
    assert set(spans) == holders                     # fuzzy ones too, and no clean document
    other = {r.doc_id: r.other_id for r in got}
    assert other[500] == 1 and other[1] == 500 and other[4] == 4 and other[None] == 2
    assert S.repeated_passages(awkward(spark, [])).count() == 0
    assert S.repeated_passages(awkward(spark, [(1, None), (2, "a b")])).count() == 0


def test_recall_of_edited_passages(spark):
    """Passages of which a share of words, drawn at random, is replaced in the second text."""
    rng = random.Random(33)
    new = lambda k: [f"r{rng.randrange(10**7)}" for _ in range(k)]
    cells = {(60, 80): 0.4, (60, 85): 0.7, (60, 90): 0.95, (100, 80): 0.85, (100, 85): 0.95, (100, 90): 1.0,
             (200, 80): 0.95, (200, 85): 1.0, (200, 90): 1.0}
    rows, cell_of = [], {}
    for cell in cells:
        for _ in range(40):
            p = new(cell[0])
            q = list(p)
            for i in rng.sample(range(cell[0]), cell[0] * (100 - cell[1]) // 100):
                q[i] = new(1)[0]
            cell_of[len(rows)] = cell
            rows += [(len(rows) + d, " ".join(new(80) + x + new(80))) for d, x in enumerate((p, q))]
    found = {r.doc_id: r.other_id for r in S.repeated_passages(awkward(spark, rows)).collect()}
    assert all(other == (doc ^ 1) for doc, other in found.items())
    recall = {c: sum(found.get(k) == k + 1 for k, of in cell_of.items() if of == c) / 40 for c in cells}
    print(recall)
    assert all(recall[c] >= least for c, least in cells.items()), recall


def test_passages_of_frequent_lines(spark):
    """Two texts share lines in a row that many others hold one by one."""
    rng = random.Random(21)
    new = lambda k: [f"m{rng.randrange(10**6)}" for _ in range(k)]
    lines = [new(26 + k % 3) for k in range(8)]
    parts = [[a] for a in range(8) for _ in range(40)] + [
        [a, b] for a in range(8) for b in range(8) if a < b for _ in range(2)] + [
        [a, a - 1, a - 2] for a in range(2, 8) for _ in range(2)]
    rows = [(k, " ".join(new(30) + [w for a in p for w in lines[a]] + new(30))) for k, p in enumerate(parts)]
    spans = defaultdict(list)
    for r in S.repeated_passages(awkward(spark, rows)).collect():
        spans[r.doc_id].append((r.first_word, r.end_word))
    windows = exact_windows(rows)
    missed = {rows[row][0] for row, p in windows
              if not any(a <= p and p + 51 <= b for a, b in spans[rows[row][0]])}
    assert len({row for row, _ in windows}) == 68 and not missed, (len(missed), sorted(missed))


def test_chains_follow_the_best_way():
    rng = random.Random(3)
    for _ in range(60):
        blocks = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(9)})
        blocks = [(x, y, S.K + rng.randrange(8)) for x, y in blocks]
        last = [(x + m - S.K, y + m - S.K) for x, y, m in blocks]
        score = []
        for i, (x, y, m) in enumerate(blocks):
            gains = [score[j] - S.GAP_COST * (x - last[j][0] - S.K + y - last[j][1] - S.K)
                     for j in range(len(blocks)) if last[j][0] < x and last[j][1] < y and j < i]
            score.append(m + max([0, *gains]))
        found = S.chains(blocks)
        assert sorted(b for c in found for b in c) == blocks
        best = found[0]
        value = best[0][2]
        for (a, b, m), (x, y, k) in zip(best, best[1:]):
            assert a + m - S.K < x and b + m - S.K < y
            value += k - S.GAP_COST * (x - (a + m) + y - (b + m))
        assert abs(value - max(score)) < 1e-9


def test_passages_of_the_smallest_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    spans = defaultdict(list)
    for r in S.repeated_passages(spark.read.parquet(f"{SF}/documents.parquet")).collect():
        spans[r.doc_id].append((r.first_word, r.end_word))
    missed = {rows[row][0] for row, p in exact_windows(rows)
              if not any(a <= p and p + 51 <= b for a, b in spans[rows[row][0]])}
    assert not missed


def test_window_starts_by_matrix(monkeypatch):
    rng = random.Random(12)
    for windows in (1, 3, 4096):
        monkeypatch.setattr(D, "WINDOWS", windows)
        for _ in range(200):
            n = rng.randint(1, 60)
            size, hits = rng.randint(1, n), sorted(rng.sample(range(n), rng.randint(1, n)))
            want = sorted({s for h in hits for s in range(h - size + 1, h + 1) if 0 <= s <= n - size})
            parts = list(D.window_starts(np.array(hits), size, n))
            assert [x for p in parts for x in p.tolist()] == want and all(0 < len(p) <= windows for p in parts)


def test_leaks_of_repeated_long_items():
    rng = random.Random(13)
    item = " ".join(f"w{rng.randrange(5000)}" for _ in range(1000))
    begin = time.time()
    assert D.Index([(7, item)]).matches(" ".join([item] * 100)) == [(7, 0, 1000, 1.0)]
    assert time.time() - begin < 20
