"""Byte-level BPE encoding and decoding of whole texts.

A text is split by the pattern of the rank files, and each match is encoded by itself.
Two tiers resolve a match. Most are tokens already: a minimal perfect hash of the
vocabulary (compress, hash and displace) gives the one slot where a token can be, and
one comparison says whether it is there. Misses are merged bottom up: the pairs of
neighbours that are tokens wait in a heap by (rank, position) over a doubly linked
list of byte ranges, which takes n log n steps for n bytes.

Every text is one row in one task and nothing is shuffled. Texts are cut into
stretches at places where the pattern always ends a match, so that memory follows a
stretch, or the longest single match, and not the text.
"""
from __future__ import annotations

import base64
import functools
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, functions as F

from .packing import tokenizer_path

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Characters of a text that are split at once.
STRETCH = 1 << 18
#: Matches whose ids a task remembers at most, and the longest one it remembers.
CACHE, CACHE_LENGTH = 1_000_000, 256

_NONE = 1 << 62
_HALF = (1 << 64) - 1


class PerfectHash:
    """A minimal perfect hash from byte strings to their numbers in a list.

    Keys fall into buckets; from the largest bucket on, each takes the first
    displacement (a multiple of a second hash and a shift) that puts all its keys into
    free slots; buckets of one key take the slots that are left. A lookup computes one
    hash, one displacement and one slot of exactly as many slots as there are keys.
    """

    def __init__(self, keys: list[bytes], per_bucket: int = 2):
        if len(set(keys)) != len(keys):
            raise ValueError("keys repeat")
        self.size = len(keys)
        self.n_buckets = max(1, -(-len(keys) // per_bucket))
        for self.seed in range(100):       # few keys may need another hash
            if self._place(keys):
                return
        raise ValueError("keys have equal hashes")

    def _place(self, keys: list[bytes]) -> bool:
        self.keys: list[bytes | None] = [None] * self.size
        self.numbers = [-1] * self.size
        self.displaced = [(0, 0)] * self.n_buckets
        buckets: list[list[int]] = [[] for _ in range(self.n_buckets)]
        parts = []
        for i, key in enumerate(keys):
            h = xxhash.xxh3_128_intdigest(key, self.seed)
            parts.append((h >> 64, h & _HALF))
            buckets[(h & _HALF) % self.n_buckets].append(i)
        order = sorted((b for b in range(self.n_buckets) if buckets[b]), key=lambda b: -len(buckets[b]))
        singles = [b for b in order if len(buckets[b]) == 1]
        for b in order[:len(order) - len(singles)]:
            for d in range(min(self.size * self.size, 1 << 20)):
                times, add = divmod(d, self.size)
                slots = [(parts[i][0] + times * parts[i][1] + add) % self.size for i in buckets[b]]
                if len(set(slots)) == len(slots) and all(self.numbers[s] < 0 for s in slots):
                    break
            else:
                return False
            self._put(b, (times, add), slots, buckets[b], keys)
        free = [s for s in range(self.size) if self.numbers[s] < 0]
        for b, slot in zip(singles, free):
            add = (slot - parts[buckets[b][0]][0]) % self.size
            self._put(b, (0, add), [slot], buckets[b], keys)
        return True

    def _put(self, bucket: int, displacement: tuple[int, int], slots, numbers, keys) -> None:
        self.displaced[bucket] = displacement
        for slot, i in zip(slots, numbers):
            self.keys[slot], self.numbers[slot] = keys[i], i

    def find(self, key: bytes) -> int:
        """The number of a key, -1 for other strings."""
        if not self.size:
            return -1
        h = xxhash.xxh3_128_intdigest(key, self.seed)
        second = h & _HALF
        times, add = self.displaced[second % self.n_buckets]
        slot = ((h >> 64) + times * second + add) % self.size
        return self.numbers[slot] if self.keys[slot] == key else -1


def read_ranks(name: str = RANKS) -> list[tuple[bytes, int]]:
    """(token, rank) of a rank file: base64 of the token and its rank a line."""
    with open(tokenizer_path(name), "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    return [(base64.b64decode(token), int(rank)) for token, rank in pairs]


class ByteBpe:
    """Encoder and decoder for one rank file. Ids are the ranks, as little-endian
    unsigned 32-bit bytes."""

    def __init__(self, name: str = RANKS, pattern: str | None = None):
        if pattern is None:
            import public_tokenizers

            pattern = public_tokenizers.PATTERN
        ranks = read_ranks(name)
        self.table = PerfectHash([token for token, _ in ranks])
        self.ranks = [rank for _, rank in ranks]
        self.rank_of = dict(ranks)         # of the ranges that merging meets
        self.tokens = {rank: token for token, rank in ranks}
        missing = [b for b in range(256) if bytes([b]) not in self.rank_of]
        if missing:
            raise ValueError(f"bytes without a token: {missing}")
        self.pattern = regex.compile(pattern)
        self.known: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a byte string: of all neighbouring ranges that join to a token, the
        one of the least rank joins first, the leftmost of equal ones."""
        n, rank_of = len(piece), self.rank_of
        if n == 1:
            return [rank_of[piece]]
        after, before = list(range(1, n + 2)), list(range(-1, n))    # starts of neighbours
        joint = [rank_of.get(piece[i:i + 2], _NONE) for i in range(n - 1)]
        joint += [_NONE, _NONE]            # rank of the range from here joined to the next
        heap = [rank << 32 | i for i, rank in enumerate(joint) if rank != _NONE]
        heapq.heapify(heap)
        push, pop = heapq.heappush, heapq.heappop
        while heap:
            top = pop(heap)
            i = top & 0xFFFFFFFF
            if joint[i] != top >> 32:      # one of its sides has changed since
                continue
            mid = after[i]
            end = after[i] = after[mid]
            joint[mid] = _NONE
            before[end] = i
            joint[i] = _NONE
            if end < n:
                rank = rank_of.get(piece[i:after[end]])
                if rank is not None:
                    joint[i] = rank
                    push(heap, rank << 32 | i)
            left = before[i]
            if left >= 0:
                rank = rank_of.get(piece[left:end])
                joint[left] = _NONE if rank is None else rank
                if rank is not None:
                    push(heap, rank << 32 | left)
        ids, i = [], 0
        while i < n:
            ids.append(rank_of[piece[i:after[i]]])
            i = after[i]
        return ids

    def piece_ids(self, match: str) -> bytes:
        """Ids of one match of the pattern."""
        piece = match.encode("utf-8")
        i = self.table.find(piece)
        ids = [self.ranks[i]] if i >= 0 else self.merge(piece)
        return np.array(ids, dtype="<u4").tobytes()

    def _ids(self, matches: list[str]) -> bytes:
        known = self.known
        if len(known) > CACHE:
            known.clear()
        long = {}
        for match in set(matches).difference(known):
            (known if len(match) <= CACHE_LENGTH else long)[match] = self.piece_ids(match)
        if long:
            return b"".join([long[m] if m in long else known[m] for m in matches])
        return b"".join([known[m] for m in matches])

    def stretches(self, text: str):
        """(start, end) of parts of about STRETCH characters. Each ends before white
        space that follows something else: no match reaches over such a place, and
        the part before it is matched alike without what follows."""
        at = 0
        while at < len(text):
            end = at + STRETCH
            if end >= len(text):
                end = len(text)
            else:
                found = _CUT.search(text, end)
                end = found.start() + 1 if found else len(text)
            yield at, end
            at = end

    def encode(self, text: str):
        """Ids of a text, a stretch at a time."""
        for at, end in self.stretches(text):
            yield self._ids(self.pattern.findall(text, at, end))

    def decode(self, ids: bytes) -> bytes:
        """Bytes of ids; they need not be whole characters."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@functools.cache
def _bpe(name: str, pattern: str | None) -> ByteBpe:
    """One table in each Python worker; later tasks of the worker find it there."""
    return ByteBpe(name, pattern)


_CUT = regex.compile(r"\S\s")


def _digests(name: str, pattern: str | None):
    def run(batches):
        bpe = _bpe(name, pattern)
        for batch in batches:
            counts, ids_sha, decoded_sha = [], [], []
            for text in batch["text"]:
                n, encoded, decoded = 0, hashlib.sha256(), hashlib.sha256()
                for ids in bpe.encode(text.as_py() or ""):
                    n += len(ids) // 4
                    encoded.update(ids)
                    decoded.update(bpe.decode(ids))
                counts.append(n)
                ids_sha.append(encoded.hexdigest())
                decoded_sha.append(decoded.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()),
                 pa.array(decoded_sha, pa.string())],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return run


def _encode(name: str, pattern: str | None):
    def run(batches):
        bpe = _bpe(name, pattern)
        for batch in batches:
            ids = [b"".join(bpe.encode(text.as_py() or "")) for text in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(ids, pa.binary())], ["id", "ids"])
    return run


def _decode(name: str, pattern: str | None):
    def run(batches):
        bpe = _bpe(name, pattern)
        for batch in batches:
            data = [bpe.decode(ids.as_py() or b"") for ids in batch["ids"]]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(data, pa.binary())], ["id", "data"])
    return run


def _apply(df: DataFrame, fn, id_col: str, col: str, as_: str, fields: str) -> DataFrame:
    rows = df.select(F.col(id_col).alias("id"), F.col(col).alias(as_))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(fn, f"id {kind}, {fields}").withColumnRenamed("id", id_col)


def encode_texts(docs: DataFrame, ranks: str = RANKS, pattern: str | None = None, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(id, ids binary): the ids of every whole text as little-endian unsigned 32-bit
    integers. A null or empty text has no ids. One row for each row, repeated rows and
    null ids included; other columns, whatever their names, are not read."""
    return _apply(docs, _encode(ranks, pattern), id_col, text_col, "text", "ids binary")


def decode_ids(encoded: DataFrame, ranks: str = RANKS, pattern: str | None = None, id_col: str = "doc_id",
               ids_col: str = "ids") -> DataFrame:
    """(id, data binary): the bytes that ids stand for, null or empty ids none. An id
    that the rank file lacks raises KeyError."""
    return _apply(encoded, _decode(ranks, pattern), id_col, ids_col, "ids", "data binary")


def round_trip(docs: DataFrame, ranks: str = RANKS, pattern: str | None = None, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): every whole text encoded and its ids
    decoded again, as digests. A null or empty text has no ids and the digests of no
    bytes. One row for each row, repeated rows and null ids included; other columns,
    whatever their names, are not read. No rows: no rows."""
    return _apply(docs, _digests(ranks, pattern), id_col, text_col, "text",
                  "n_tokens long, ids_sha256 string, decoded_sha256 string")
