"""Repeated passages across documents, exact or fuzzy, by collinear chaining.

1. Seeds. Of all runs of K words each text keeps the ones with the smallest hash of
   any W neighbouring runs; texts that share K + W - 1 words in a row share a seed.
2. Stars. The places of a seed are not paired all with all: each is matched with the
   places in the text with the smallest and with the largest key. This happens first
   inside each block of texts, and only those two places travel on, so a passage that a
   third of all texts hold costs each of them two matches and each block two places.
   Parts of a passage can be held more widely than the passage, as where it is made of
   frequent lines, and then its seeds have leaders without it. Hence the runs of seeds
   over SPAN words are keys besides the seeds, with leaders of their own: two texts
   that share MIN_WORDS words in a row share such a run, and its leaders all hold it.
3. Chains. The matches of a pair of texts are merged along diagonals, then chained: a
   match may follow any that ends before it in both texts, at a cost for the gaps. With
   costs linear in the gaps the best predecessor is a prefix maximum, which a Fenwick
   tree over the positions in the second text gives in logarithmic time.
4. Alignment. Each chain is extended at both ends and filled between its matches, word
   against word. Parts of MIN_WORDS words or more of which MIN_SAME hundredths are
   equal are passages.

Equal texts are one text throughout; their copies come back by a join at the end.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import stage, stage_split
from .shingles import mix, shingle_hashes, word_hashes

K, W = 6, 6
MIN_WORDS, MIN_SAME = 50, 80
#: Cost of a word of gap in either text, in matched words.
GAP_COST = 0.25
#: Matches of a diagonal so close are one, as in a run of equal words; a gap with more
#: unequal words than FAR parts a chain; unequal gaps up to so many cells are aligned in full, longer ones from
#: both ends.
NEAR, FAR, CELLS = W, 20, 10_000
#: At its ends a chain goes on after so many missing or new words, if so many equal
#: ones follow.
SHIFT, RESUME = 2, 4
SHIFTS = sorted(((i, j) for i in range(SHIFT + 1) for j in range(SHIFT + 1) if i + j), key=sum)
#: Words that a chain may grow by at each end beyond its matches: runs that are not
#: seeds themselves, with room for edits.
REACH = 400
#: Chains narrower than SURE words hold few seeds: equal words elsewhere in a passage, or
#: chance. The alignment decides; so that it costs little, such a chain may grow by
#: WEAK_REACH words at each end. One seed alone makes no chain.
SURE, WEAK_REACH = MIN_WORDS - 2 * (K + W), 75
#: Bit of a place that starts a repeated run, and a word number beyond any text.
RUN, END = 1 << 31, 1 << 28
#: Places that a run of seeds covers: in MIN_WORDS equal words, whatever stands around
#: them, there is one with the same seeds. LONG marks its place.
SPAN, LONG = MIN_WORDS - K - 2 * (W - 1), 1 << 30
STEP = 0x9E3779B97F4A7C15
BLOCK, BUCKET_CHARS = 500_000, 12_000_000

ROWS = ("kind int, bucket long, ids array<{id}>, texts binary, others binary, counts binary, "
        "hashes binary, places binary, other_places binary")


def text_key(text: str, n_words: int) -> bytes:
    """12 bytes of the text's MD5 and its number of words."""
    return hashlib.md5(text.encode("utf-8", "surrogatepass")).digest()[:12] + n_words.to_bytes(4, "big")


def seeds(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the kept runs of K words. Of the same run kept again and
    again, as where one word repeats, only the first stays; RUN marks such places, since
    a single match of them can stand for a long passage."""
    if len(words) < K:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = shingle_hashes(words, K)
    if len(h) <= W:
        at = np.array([int(np.argmin(h))])
    else:
        windows = np.lib.stride_tricks.sliding_window_view(h, W)
        at = np.unique(windows.argmin(axis=1) + np.arange(len(windows)))
    again = np.append(False, (h[at][1:] == h[at][:-1]) & (np.diff(at) <= W))
    marked = at | np.where(np.append(again[1:], False), RUN, 0)
    return h[at][~again], marked[~again]


def seed_runs(h: np.ndarray, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and marked places of the runs of seeds over SPAN places, from each seed."""
    at = marked & ~RUN
    end = np.searchsorted(at, at + SPAN, "right")
    begin = np.arange(len(at))
    power, inverse = (np.multiply.accumulate(np.append(np.uint64(1), np.full(len(at), x, np.uint64)))
                      for x in (STEP, pow(STEP, -1, 1 << 64)))
    sums = np.append(np.uint64(0), np.cumsum(h * power[:-1]))
    runs = mix((sums[end] - sums[begin]) * inverse[:-1] + (end - begin).astype(np.uint64), 7)
    wide = end - begin > 1
    return runs[wide], at[wide] | LONG


def stars(h: np.ndarray, owner: np.ndarray, place: np.ndarray):
    """(member, leader) matches and the leaders that travel on, as positions. Owners
    are numbered by their keys. A leader stands for its first place."""
    order = np.lexsort((place, owner, h))
    if not len(order):
        return order, order, order
    h, owner = h[order], owner[order]
    n = len(h)
    new_h = np.append(True, h[1:] != h[:-1])
    new_owner = new_h | np.append(True, owner[1:] != owner[:-1])
    group = np.cumsum(new_h) - 1
    low = np.flatnonzero(new_h)
    runs = np.flatnonzero(new_owner)
    high = np.zeros(len(low), np.int64)
    high[group[runs]] = runs                           # the last text's first place
    first, last = low[group], high[group]
    each = np.arange(n)
    to_first, to_last = owner != owner[first], (owner != owner[last]) & (first != last)
    to_last &= owner[last] != owner[first]
    member = np.concatenate((order[each[to_first]], order[each[to_last]]))
    leader = np.concatenate((order[first[to_first]], order[last[to_last]]))
    return member, leader, order[np.unique(np.concatenate((low, high)))]


def _record(kind_id, rows: list[dict]) -> pa.RecordBatch:
    fields = [("kind", pa.int32()), ("bucket", pa.int64()), ("ids", pa.list_(kind_id)),
              *[(c, pa.binary()) for c in ("texts", "others", "counts", "hashes", "places",
                                           "other_places")]]
    return pa.RecordBatch.from_pydict(
        {c: pa.array([r.get(c) for r in rows], t) for c, t in fields})


def _cut(target: np.ndarray, n: int):
    order = np.argsort(target, kind="stable")
    cuts = np.searchsorted(target[order], np.arange(n + 1))
    return [(b, order[cuts[b]:cuts[b + 1]]) for b in range(n) if cuts[b] < cuts[b + 1]]


def _match_rows(keys, owner, place, member, leader, n: int) -> list[dict]:
    """kind 1: matches by pair of texts, dealt to the buckets of the pairs."""
    x, y = owner[member], owner[leader]
    head = np.frombuffer(keys.tobytes(), "<u8").reshape(-1, 2)[:, 0]
    target = ((head[x] * np.uint64(0x9E3779B97F4A7C15) ^ head[y]) % np.uint64(n)).astype(np.int64)
    out = []
    for b, at in _cut(target, n):
        at = at[np.lexsort((place[leader[at]], place[member[at]], y[at], x[at]))]
        new = np.append(True, (x[at][1:] != x[at][:-1]) | (y[at][1:] != y[at][:-1]))
        starts = np.flatnonzero(new)
        out.append({"kind": 1, "bucket": b, "texts": keys[x[at][starts]].tobytes(),
                    "others": keys[y[at][starts]].tobytes(),
                    "counts": np.diff(np.append(starts, len(at))).astype("<u4").tobytes(),
                    "places": place[member[at]].astype("<u4").tobytes(),
                    "other_places": place[leader[at]].astype("<u4").tobytes()})
    return out


def _scan(n: int):
    def run(batches):
        seen: set[bytes] = set()
        block: list[tuple] = []
        size, number, kind_id = 0, 0, pa.int64()

        def flush():
            nonlocal block, size
            if not block:
                return
            block.sort(key=lambda b: b[0])
            keys = np.frombuffer(b"".join(b[0] for b in block), "V16")
            owner = np.repeat(np.arange(len(block)), [len(b[1]) for b in block])
            h, place = np.concatenate([b[1] for b in block]), np.concatenate([b[2] for b in block])
            block, size = [], 0
            member, leader, travel = stars(h, owner, place)
            rows = _match_rows(keys, owner, place, member, leader, n)
            travel = np.sort(travel)
            for b, at in _cut((h[travel] % np.uint64(n)).astype(np.int64), n):
                at = travel[at]
                texts, counts = np.unique(owner[at], return_counts=True)
                rows.append({"kind": 4, "bucket": b, "texts": keys[texts].tobytes(),
                             "counts": counts.astype("<u4").tobytes(), "hashes": h[at].tobytes(),
                             "places": place[at].astype("<u4").tobytes()})
            for i in range(0, len(rows), 32):
                yield _record(kind_id, rows[i:i + 32])

        for batch in batches:
            ids, kind_id = batch["id"], batch["id"].type
            of_batch = []
            for text in batch["text"].to_pylist():
                words = word_hashes(text or "")[0]
                key = text_key(text or "", len(words))
                of_batch.append(key)
                if len(words) >= MIN_WORDS * MIN_SAME // 100 and key not in seen:
                    seen.add(key)
                    h, at = seeds(words)
                    runs, run_at = seed_runs(h, at)
                    block.append((key, np.append(h, runs), np.append(at, run_at)))
                    size += len(h)
                    if size >= BLOCK:
                        yield from flush()
            yield _record(kind_id, [{"kind": 0, "bucket": number % n, "ids": ids.to_pylist(),
                                     "texts": b"".join(of_batch)}])
            number += 1
        yield from flush()
    return run


def _meet(n: int):
    def run(key, group):
        """One bucket of seeds: the leaders of all blocks meet; the rest passes through."""
        kind_id = group.schema.field("ids").type.value_type
        rows = group.to_pylist()
        out = [r for r in rows if r["kind"] != 4]
        rows = [r for r in rows if r["kind"] == 4]
        if rows:
            keys = np.frombuffer(b"".join(r["texts"] for r in rows), "V16")
            counts = np.frombuffer(b"".join(r["counts"] for r in rows), "<u4")
            h = np.frombuffer(b"".join(r["hashes"] for r in rows), "<u8")
            place = np.frombuffer(b"".join(r["places"] for r in rows), "<u4").astype(np.int64)
            keys, back = np.unique(keys, return_inverse=True)
            owner = np.repeat(back, counts)
            ordered = np.sort(h)
            twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
            if len(twice):
                at = np.minimum(np.searchsorted(twice, h), len(twice) - 1)
                keep = twice[at] == h
                owner, h, place = owner[keep], h[keep], place[keep]
                member, leader, _ = stars(h, owner, place)
                out += _match_rows(keys, owner, place, member, leader, n)
        return pa.Table.from_batches([_record(kind_id, out[i:i + 64]) for i in range(0, len(out), 64)]
                                     or [_record(kind_id, [])])
    return run


class Fenwick:
    """Prefix maxima of (value, who)."""

    def __init__(self, n: int):
        self.best = [(-1e18, -1)] * (n + 1)

    def put(self, i: int, item: tuple) -> None:
        i += 1
        while i < len(self.best):
            if item > self.best[i]:
                self.best[i] = item
            i += i & -i

    def most(self, i: int) -> tuple:
        """Over places below i."""
        got = (-1e18, -1)
        while i > 0:
            got = max(got, self.best[i])
            i -= i & -i
        return got


def diagonals(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int, int]]:
    """Seed matches merged along diagonals: (x, y, words)."""
    order = np.lexsort((x, y - x))
    x, y = x[order], y[order]
    new = np.append(True, (np.diff(y - x) != 0) | (np.diff(x) > NEAR))
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(x)) - 1
    return sorted(zip(x[starts].tolist(), y[starts].tolist(), (x[ends] - x[starts] + K).tolist()))


def chains(blocks: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Best chains of (x, y, words), each block in one of them. A block may follow
    one whose last K words begin before it in both texts."""
    if len(blocks) == 1:
        return [blocks]
    n = len(blocks)
    last = [(x + m - K, y + m - K) for x, y, m in blocks]
    ranks = sorted({y for _, y in last})
    rank = {y: i for i, y in enumerate(ranks)}
    tree = Fenwick(len(ranks))
    by_end = sorted(range(n), key=lambda i: last[i][0])
    score, before, done = [0.0] * n, [-1] * n, 0
    for i in range(n):                                    # in order of x
        x, y, m = blocks[i]
        while done < n and last[by_end[done]][0] < x:
            j = by_end[done]
            tree.put(rank[last[j][1]], (score[j] + GAP_COST * (last[j][0] + last[j][1] + 2 * K), j))
            done += 1
        low, high = 0, len(ranks)
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if ranks[mid] < y else (low, mid)
        value, j = tree.most(low)
        gain = value - GAP_COST * (x + y)
        score[i], before[i] = (m + gain, j) if j >= 0 and gain > 0 else (m, -1)
    used, out = [False] * n, []
    for i in sorted(range(n), key=lambda i: (-score[i], i)):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(blocks[i])
            i = before[i]
        if chain:
            out.append(chain[::-1])
    return out


CHAINS = "x binary, y binary, x_low int, x_high int, y_low int, y_high int, blocks binary"


def _chain(key, group):
    """One bucket of pairs: chains of two seeds or more, or of one that stands for a run."""
    rows = group.to_pylist()
    join = lambda c, t: np.frombuffer(b"".join(r[c] for r in rows), t)
    a, b = join("texts", "V16"), join("others", "V16")
    counts = join("counts", "<u4")
    xs, ys = join("places", "<u4").astype(np.int64), join("other_places", "<u4").astype(np.int64)
    _, ia = np.unique(a, return_inverse=True)
    _, ib = np.unique(b, return_inverse=True)
    pair = np.repeat(ia * (int(ib.max(initial=0)) + 1) + ib, counts)
    which = np.repeat(np.arange(len(a)), counts)
    order = np.lexsort((ys, xs, pair))
    pair, which, xs, ys = pair[order], which[order], xs[order], ys[order]
    starts = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.empty(0, int)
    ends = np.append(starts[1:], len(pair))
    out: dict[str, list] = {c.split()[0]: [] for c in CHAINS.split(", ")}
    for s, e in zip(starts.tolist(), ends.tolist()):
        x, y = xs[s:e], ys[s:e]
        runs = {int(v) for v in x[(x & y & RUN) > 0] & ~RUN}
        wide = x[(x & y & LONG) > 0] & ~LONG
        x, y = x & ~(RUN | LONG), y & ~(RUN | LONG)
        if x.max() == x.min() and not runs and not len(wide):
            continue
        by_place = np.lexsort((y, x))
        x, y = x[by_place], y[by_place]
        new = np.append(True, (np.diff(x) != 0) | (np.diff(y) != 0))
        for chain in chains(diagonals(x[new], y[new])):
            (x0, y0, _), (x1, y1, m) = chain[0], chain[-1]
            run = bool(runs) and any(x in runs for x, _, _ in chain)
            long = run or ((wide >= x0) & (wide < x1 + m)).any()
            span = min(x1 + m - x0, y1 + m - y0)
            if span <= K and not long:
                continue
            reach = REACH if long or span >= SURE else WEAK_REACH
            for c, v in (("x", a[which[s]].tobytes()), ("y", b[which[s]].tobytes()),
                         ("x_low", 0 if run else max(0, x0 - reach)), ("x_high", END if run else x1 + m + reach),
                         ("y_low", 0 if run else max(0, y0 - reach)), ("y_high", END if run else y1 + m + reach),
                         ("blocks", np.array(chain, "<i4").tobytes())):
                out[c].append(v)
    kinds = [pa.binary(), pa.binary(), *[pa.int32()] * 4, pa.binary()]
    return pa.table({c: pa.array(v, t) for (c, v), t in zip(out.items(), kinds)})


def _grow(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """(words, equal words) of the best common beginning without gaps: equal words
    count 1, others -2, and it ends where the sum has fallen 8 below its best."""
    n = min(len(a), len(b))
    if not n:
        return 0, 0
    same = a[:n] == b[:n]
    total = np.cumsum(np.where(same, 1, -2))
    fallen = np.flatnonzero(np.maximum.accumulate(np.maximum(total, 0)) - total >= 8)
    total = total[:fallen[0]] if len(fallen) else total
    if not len(total) or total.max() <= 0:
        return 0, 0
    to = int(total.argmax()) + 1
    return to, int(same[:to].sum())


def _extend(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """(words of a, words of b, equal words) of a common beginning in which up to SHIFT
    words may be missing or new on either side, wherever RESUME equal words follow."""
    la, same = _grow(a, b)
    lb = la
    while True:
        for i, j in SHIFTS:
            x, y = a[la + i:la + i + RESUME], b[lb + j:lb + j + RESUME]
            if len(x) == len(y) == RESUME and (x == y).all():
                more, equal = _grow(a[la + i:], b[lb + j:])
                la, lb, same = la + i + more, lb + j + more, same + equal
                break
        else:
            return la, lb, same


def _between(a: np.ndarray, b: np.ndarray) -> int:
    """Equal words of the best alignment of two gaps."""
    if len(a) == len(b):
        straight = int((a == b).sum())
        if 2 * straight >= len(a) or len(a) * len(b) > CELLS:
            return straight
    if len(a) * len(b) > CELLS:
        n = min(len(a), len(b))
        same = a[:n] == b[:n]
        head = n if same.all() else int(same.argmin())
        same = a[::-1][:n - head] == b[::-1][:n - head]
        return head + (n - head if same.all() else int(same.argmin()))
    row = np.zeros(len(b) + 1, int)
    for w in a:
        step = row.copy()
        step[1:] = np.maximum(step[1:], row[:-1] + (b == w))
        row = np.maximum.accumulate(step)
    return int(row[-1])


def align(a: np.ndarray, b: np.ndarray, blocks: list[tuple[int, int, int]]) -> list[tuple]:
    """(a from, a to, b from, b to, equal words) of the passages along a chain."""
    parts: list[list] = []
    for x, y, m in blocks:
        if parts:
            part = parts[-1]
            over = max(0, part[1] - x, part[3] - y)       # matches may overlap by some words
            x, y, m = x + over, y + over, m - over
            if m <= 0:
                continue
            gap_a, gap_b = a[part[1]:x], b[part[3]:y]
            equal = _between(gap_a, gap_b)
            if max(len(gap_a), len(gap_b)) - equal <= FAR:
                part[4] += equal + int((a[x:x + m] == b[y:y + m]).sum())
                part[1], part[3] = x + m, y + m
                continue
        parts.append([x, x + m, y, y + m, int((a[x:x + m] == b[y:y + m]).sum())])
    out = []
    for i, (x0, x1, y0, y1, equal) in enumerate(parts):
        floor_a, floor_b = (parts[i - 1][1], parts[i - 1][3]) if i else (0, 0)
        top_a, top_b = (parts[i + 1][0], parts[i + 1][2]) if i + 1 < len(parts) else (len(a), len(b))
        left_a, left_b, same_left = _extend(a[floor_a:x0][::-1], b[floor_b:y0][::-1])
        right_a, right_b, same_right = _extend(a[x1:top_a], b[y1:top_b])
        x0, y0, x1, y1 = x0 - left_a, y0 - left_b, x1 + right_a, y1 + right_b
        equal += same_left + same_right
        if (min(x1 - x0, y1 - y0) >= MIN_WORDS
                and 100 * equal >= MIN_SAME * max(x1 - x0, y1 - y0)):
            out.append((x0, x1, y0, y1, equal))
    return out


ALIGNED = "x binary, y binary, x_from int, x_to int, y_from int, y_to int, equal int"


def _align(batches):
    for batch in batches:
        out: dict[str, list] = {c.split()[0]: [] for c in ALIGNED.split(", ")}
        for r in batch.to_pylist():
            a, b = np.frombuffer(r["x_words"], "<u4"), np.frombuffer(r["y_words"], "<u4")
            dx, dy = r["x_low"], r["y_low"]
            blocks = np.frombuffer(r["blocks"], "<i4").reshape(-1, 3) - np.array([dx, dy, 0])
            for x0, x1, y0, y1, equal in align(a, b, blocks.tolist()):
                for c, v in zip(out, (r["x"], r["y"], x0 + dx, x1 + dx, y0 + dy, y1 + dy, equal)):
                    out[c].append(v)
        kinds = [pa.binary(), pa.binary(), *[pa.int32()] * 5]
        yield pa.RecordBatch.from_pydict({c: pa.array(v, t) for (c, v), t in zip(out.items(), kinds)})


def _words(batches):
    for batch in batches:
        seen, texts, words = set(), [], []
        for text in batch["text"].to_pylist():
            h = word_hashes(text)[0]
            key = text_key(text, len(h))
            if key not in seen:
                seen.add(key)
                texts.append(key)
                words.append((h & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes())
        yield pa.RecordBatch.from_pydict({"text_key": pa.array(texts, pa.binary()),
                                          "words": pa.array(words, pa.binary())})


def aligned_passages(rows: DataFrame, chained: DataFrame) -> DataFrame:
    """The chains' passages. Only texts with chains are read again. The joins are merge
    joins at every size: a broadcast where the tables happen to be small would say
    nothing of larger ones."""
    wanted = stage(chained.select(F.col("x").alias("k")).unionByName(chained.select(F.col("y").alias("k")))
                   .distinct().select(F.substring("k", 1, 12).alias("head")).distinct(), "wanted")
    head = F.substring(F.unhex(F.md5(F.encode("text", "UTF-8"))), 1, 12)
    words = stage(rows.where("text is not null").select("text", head.alias("head"))
                  .join(wanted.hint("merge"), "head", "left_semi").select("text")
                  .mapInArrow(_words, "text_key binary, words binary")
                  .groupBy("text_key").agg(F.min("words").alias("words")), "words")
    part = lambda c, low, high: F.substring(
        F.col(c), F.col(low) * 4 + 1, (F.col(high) - F.col(low)) * 4)
    with_x = (chained.join(words.withColumnRenamed("text_key", "x").hint("merge"), "x")
              .withColumn("x_words", part("words", "x_low", "x_high")).drop("words"))
    with_y = (with_x.join(words.withColumnRenamed("text_key", "y").hint("merge"), "y")
              .withColumn("y_words", part("words", "y_low", "y_high")).drop("words"))
    return with_y.mapInArrow(_align, ALIGNED)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, first_word, end_word, n_words, other_id): the passages of each document that
    another document repeats, overlapping ones merged; other_id is the smallest id known
    to hold one of them.

    Words are as in the shingle operators. A passage has MIN_WORDS words or more in both
    texts, MIN_SAME hundredths of them equal in order. A document row whose whole text
    occurs again is one passage if it is long enough. Null, empty and short texts have
    none. Repeated rows count as documents of their own and are all returned; null ids
    are never an other_id while there is another. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = ROWS.format(id=kind)
    chars = rows.agg(F.sum(F.length("text").cast("bigint"))).first()[0] or 0
    n = max(1, -(-chars // BUCKET_CHARS))
    tagged = stage_split(rows.mapInArrow(_scan(n), schema).groupBy("bucket")
                         .applyInArrow(_meet(n), schema), "matches", "kind")
    chained = stage(tagged.where("kind = 1").groupBy("bucket").applyInArrow(_chain, CHAINS), "chains")
    aligned = stage(aligned_passages(rows, chained), "aligned")

    at = F.col("pos") * 16 + 1
    own = tagged.where("kind = 0").select("texts", F.posexplode("ids").alias("pos", "id")).select(
        F.col("id").cast(kind).alias("id"), F.substring("texts", at, F.lit(16)).alias("key"))
    # The two smallest ids of a text, and how often it occurs.
    by_id = own.groupBy("key", "id").agg(F.count(F.lit(1)).alias("n"))
    texts = stage(by_id.groupBy("key").agg(
        F.sum("n").alias("copies"), F.min("id").alias("id1"), F.max("id").alias("id_last")), "texts")
    size = F.conv(F.hex(F.substring("key", 13, 4)), 16, 10).cast("int")
    whole = (texts.where("copies > 1").where(size >= MIN_WORDS)
             .select("key", F.lit(0).alias("low"), size.alias("high"),
                     F.lit(None).cast(kind).alias("other")))
    sides = [aligned.select(F.col(a).alias("key"), F.col(f"{a}_from").alias("low"),
                            F.col(f"{a}_to").alias("high"), F.col(b).alias("partner"))
             for a, b in (("x", "y"), ("y", "x"))]
    spans = (sides[0].unionByName(sides[1])
             .join(texts.select(F.col("key").alias("partner"), F.col("id1").alias("other")), "partner")
             .select("key", "low", "high", "other").unionByName(whole)
             .groupBy("key", "low", "high").agg(F.min("other").alias("other")))
    # Overlapping spans of a text become one.
    in_order = Window.partitionBy("key").orderBy("low", "high")
    reach = F.max("high").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    merged = (spans.withColumn("new", F.when(F.col("low") < reach, 0).otherwise(1))
              .withColumn("group", F.sum("new").over(in_order))
              .groupBy("key", "group").agg(F.min("low").alias("low"), F.max("high").alias("high"),
                                           F.min("other").alias("other")))
    merged = stage(merged.join(texts, "key"), "merged")
    # Another copy of the same text: the smallest id, or for that one the largest.
    copy = F.when(F.col("copies") > 1, F.when(F.col("id") == F.col("id1"), F.col("id_last"))
                  .otherwise(F.col("id1")))
    return (own.join(merged, "key")
            .select(F.col("id").alias(id_col), F.col("low").alias("first_word"),
                    F.col("high").alias("end_word"), (F.col("high") - F.col("low")).alias("n_words"),
                    F.least("other", copy).alias("other_id")))
