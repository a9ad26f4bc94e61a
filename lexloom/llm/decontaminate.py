"""Benchmark decontamination by SimHash over item-sized windows.

A window has as many words as the benchmark item it is held against. Its fingerprint
is the sign, bit by bit, of the sum over its five-word shingles' hashes. Fingerprints
are looked up in a multi-index: they are cut into BLOCKS blocks, and two that differ in
RADIUS bits at most differ in RADIUS // BLOCKS bits at most in some block, so an index
of every item's blocks with all their neighbours within that distance finds all of
them. Candidates are then held against the item by exact weighted similarity: the sum
of the smaller counts of all shingles over the sum of the larger ones.

A window without any shingle of the benchmark has similarity 0 with every item, so
only windows that hold one get a fingerprint: most of a corpus costs one look-up a word.
The documents are not shuffled. The benchmark goes to all tasks in slices whose size
is checked; a benchmark larger than one slice takes one pass for each.
"""
from __future__ import annotations

from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import stage
from .shingles import BARE, WIDTH, mix, shingle_hashes, word_hashes

#: Least similarity in hundredths; blocks and radius of the multi-index. Windows of
#: that similarity differ from the item in about 10 of 64 bits, give or take 3.
SIMILAR, BLOCKS, RADIUS = 80, 8, 21
#: Characters of benchmark text in one slice, which is collected and broadcast.
SLICE_CHARS = 8_000_000
#: Windows of a text that are fingerprinted at once.
WINDOWS = 4096


def words_of(text: str | None) -> np.ndarray:
    """Hashes of the words in lower case without ASCII punctuation."""
    return word_hashes((text or "").lower(), BARE)[0]


def _bits(h: np.ndarray) -> np.ndarray:
    """Each hash as 64 numbers, 1 or -1."""
    return np.unpackbits(mix(h, 9).view(np.uint8).reshape(len(h), 8), axis=1).astype(np.int32) * 2 - 1


def fingerprints(shingles: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """8 bytes for each window of `size` shingles."""
    sums = np.concatenate((np.zeros((1, 64), np.int32), np.cumsum(_bits(shingles), axis=0)))
    return np.packbits(sums[starts + size] - sums[starts] > 0, axis=1)


def similarity(a: Counter, b: Counter) -> tuple[int, int]:
    """(sum of smaller counts, sum of larger counts) of two shingle multisets."""
    both = sum(min(n, b[x]) for x, n in a.items() if x in b)
    return both, sum(a.values()) + sum(b.values()) - both


def window_starts(hits: np.ndarray, size: int, n: int):
    """The places at which a window of `size` among n shingles holds one of the hits,
    which come in order: in order, WINDOWS at most at a time."""
    low, high = np.maximum(hits - size + 1, 0), np.minimum(hits, n - size)
    first = np.flatnonzero(np.concatenate(([True], low[1:] > np.maximum.accumulate(high)[:-1] + 1)))
    ends = np.append(first[1:], len(hits)) - 1
    waiting, count = [], 0
    for a, b in zip(low[first].tolist(), high[ends].tolist()):
        while a <= b:
            take = min(b - a + 1, WINDOWS - count)
            # Far from the others a window is looked at by itself.
            if waiting and a - waiting[0][0] > 2 * WINDOWS:
                yield np.concatenate(waiting)
                waiting, count, take = [], 0, min(b - a + 1, WINDOWS)
            waiting.append(np.arange(a, a + take))
            count, a = count + take, a + take
            if count == WINDOWS:
                yield np.concatenate(waiting)
                waiting, count = [], 0
    if waiting:
        yield np.concatenate(waiting)


class Index:
    """A slice of the benchmark: shingles, and fingerprints by number of shingles."""

    def __init__(self, items: list[tuple], width: int = WIDTH):
        self.width = width
        self.items = []                             # id, words, shingle counts
        holders: dict[int, set[int]] = defaultdict(set)
        by_size = defaultdict(list)
        for item_id, text in items:
            words = words_of(text)
            if not len(words):
                continue
            shingles = shingle_hashes(words, width)
            i = len(self.items)
            self.items.append((item_id, len(words), Counter(shingles.tolist())))
            for x in set(shingles.tolist()):
                holders[x].add(len(words))
            print_ = fingerprints(shingles, np.array([0]), len(shingles))[0]
            by_size[len(words)].append((i, print_))
        self.known = np.array(sorted(holders), np.uint64)
        self.sizes = [sorted(holders[x]) for x in self.known.tolist()]
        self.short = sorted({n for _, n, _ in self.items if n < width})
        near = [0, *[1 << a for a in range(8)], *[1 << a | 1 << b for a, b in combinations(range(8), 2)]]
        near = np.array(near[:1 + 8 * (RADIUS // BLOCKS >= 1) + 28 * (RADIUS // BLOCKS >= 2)], np.uint8)
        self.index = {}
        for size, held in by_size.items():
            prints = np.array([p for _, p in held])
            cells: list[list[np.ndarray]] = []
            for b in range(BLOCKS):
                of = defaultdict(list)
                for j, value in enumerate(prints[:, b]):
                    for v in (value ^ near).tolist():
                        of[v].append(j)
                cells.append([np.array(of.get(v, []), int) for v in range(256)])
            self.index[size] = ([i for i, _ in held], prints, cells)

    def within(self, size: int, window: np.ndarray) -> list[int]:
        """Items of that many words whose fingerprint is within the radius."""
        numbers, prints, cells = self.index[size]
        near = np.unique(np.concatenate([cells[b][int(window[b])] for b in range(BLOCKS)]))
        if not len(near):
            return []
        apart = np.bitwise_count(prints[near] ^ window).sum(axis=1)
        return [numbers[j] for j in near[apart <= RADIUS]]

    def matches(self, text: str | None, similar: int = SIMILAR) -> list[tuple]:
        """(item id, first word, words, similarity) of the best window of each item."""
        if not self.items:
            return []
        words = words_of(text)
        if not len(words):
            return []
        best: dict[int, tuple] = {}
        for width in sorted({min(self.width, len(words)), *[n for n in self.short if n <= len(words)]}):
            shingles = shingle_hashes(words, width)
            at = np.minimum(np.searchsorted(self.known, shingles), len(self.known) - 1)
            hits = np.flatnonzero(self.known[at] == shingles)
            if not len(hits):
                continue
            by_size = defaultdict(list)
            for h in hits.tolist():
                for n in self.sizes[at[h]]:
                    by_size[n].append(h)
            for n, held in by_size.items():
                if min(n, self.width) != width and len(words) >= self.width:
                    continue
                size = max(1, min(n, len(words)) - width + 1)
                for starts in window_starts(np.array(held), size, len(shingles)):
                    low = int(starts[0])
                    prints = fingerprints(shingles[low:int(starts[-1]) + size], starts - low, size)
                    for start, window in zip(starts.tolist(), prints):
                        # A later window beats no earlier one of full likeness.
                        near = [i for i in self.within(n, window) if i not in best or best[i][0] < 1]
                        if not near:
                            continue
                        own = Counter(shingles[start:start + size].tolist())
                        for i in near:
                            both, either = similarity(own, self.items[i][2])
                            if 100 * both >= similar * either:
                                got = (both / either, -start, min(n, len(words)))
                                best[i] = max(best.get(i, got), got)
        return sorted((self.items[i][0], -s, n, x) for i, (x, s, n) in best.items())


def _slices(benchmark: DataFrame, id_col: str, text_col: str):
    """(items, whether there are more slices than one) of each slice of the benchmark of at
    most SLICE_CHARS characters (or one item), collected when it is asked for."""
    items = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(
        "id is not null and length(text) > 0").distinct()
    chars = items.agg(F.sum(F.length("text").cast("bigint"))).first()[0] or 0
    n = max(1, -(-chars // (SLICE_CHARS // 2)))
    part = F.pmod(F.xxhash64("id", "text"), F.lit(n))
    for i in range(n):
        yield [(r[0], r[1]) for r in items.where(part == i).orderBy("id", "text").collect()], n > 1


def _find(spread, similar: int):
    def run(batches):
        index = Index(spread.value)
        for batch in batches:
            where, found = [], []
            for i, text in enumerate(batch["text"].to_pylist()):
                got = index.matches(text, similar)
                where += [i] * len(got)
                found += got
            yield pa.RecordBatch.from_arrays(
                [batch["id"].take(pa.array(where, pa.int64())),
                 pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()),
                 pa.array([f[2] for f in found], pa.int64()), pa.array([f[3] for f in found], pa.float64())],
                ["id", "item_id", "first_word", "n_words", "similarity"])
    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", similar: int = SIMILAR) -> DataFrame:
    """(id, item_id, first_word, n_words, similarity): for each document row and each
    benchmark item that one of its windows is similar to, the best window, the first
    of equal ones. A document shorter than an item is one window.

    Null, empty and wordless texts match nothing; items with null ids or without words
    are left out; an item id with several texts is as many items. Item ids are integers.
    Repeated rows are kept. Other columns, whatever their names, are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = None
    for items, more in _slices(benchmark, item_col, "text"):
        spread = docs.sparkSession.sparkContext.broadcast(items)
        got = rows.mapInArrow(_find(spread, similar), f"id {kind}, item_id long, first_word long, "
                                                      "n_words long, similarity double")
        if more:                            # one slice in memory at a time
            got = stage(got, "leaks")
            spread.unpersist()
        out = got if out is None else out.unionByName(got)
    return out.withColumnRenamed("id", id_col)


def _drop(spread, text_col: str, similar: int):
    def run(batches):
        index = Index(spread.value)
        for batch in batches:
            clean = [not index.matches(t, similar) for t in batch[text_col].to_pylist()]
            yield batch.filter(pa.array(clean, pa.bool_()))
    return run


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
               similar: int = SIMILAR) -> DataFrame:
    """The documents, all columns, that hold no benchmark item."""
    for items, more in _slices(benchmark, item_col, "text"):
        spread = docs.sparkSession.sparkContext.broadcast(items)
        docs = docs.mapInArrow(_drop(spread, text_col, similar), docs.schema)
        if more:
            docs = stage(docs, "clean")
            spread.unpersist()
    return docs
