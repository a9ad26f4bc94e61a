"""Best-fit packing of tokenised documents into fixed-length sequences.

Tokenising is one pass over the texts. The tokeniser splits a text into words
before it looks at anything else, so the ids of a word are the same wherever it
stands: each task keeps the ids of the words it has seen and asks the tokeniser
for new ones only. Texts with characters whose normalisation depends on their
neighbours go to the tokeniser whole.

Pieces are dealt by hash into buckets of about BUCKET_PIECES, whose number follows
the number of pieces, and each bucket is packed online: a piece goes into the open
bin that it fills best, found in a bit set keyed by free space. At most `open_bins`
bins are open; beyond that the fullest closes first.
"""
from __future__ import annotations

import os
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import stage

TOKENIZER = "word_bpe_49k.json"
SEQUENCE, OPEN_BINS, BUCKET_PIECES = 2048, 1024, 65536
#: Words whose ids a task remembers at most; then it starts again.
CACHE = 1_000_000
#: Longest stretch of a text that is split into words at once.
STRETCH = 1 << 20

# Characters whose lower case, composition and class do not depend on neighbours:
# tab to carriage return, ASCII and Latin letters up to U+017F without U+0130.
PLAIN = re.compile("[\t-\r\x20-\x7e\xa1-įı-ſ]*")
_L = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ſ"
_N = "0-9\xb2\xb3\xb9\xbc-\xbe"
# Fixed by the tokeniser file: contractions, letters, single digits, other signs.
WORD = re.compile(f"[{_L}]+|'(?:[stmd]|re|ve|ll)|[{_N}]|[^\t-\r\x20{_L}{_N}]+")


def tokenizer_path(name: str) -> str:
    """A file of the public tokenisers by name; other paths as they are."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class WordIds:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, name: str = TOKENIZER):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path(name))
        self.known: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)    # ids that end a word
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [b"".join(i.to_bytes(4, "little") for i in e.ids)
                for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _each(self, words: list[str]) -> list[bytes]:
        """Ids of single words, encoded in one call and cut at the word ends."""
        ids = np.array(self.tokenizer.encode_batch_fast(
            [" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words) or cuts[-1] != len(ids):
            return self._whole(words)
        data, cuts = ids.tobytes(), [0, *(4 * cuts).tolist()]
        return [data[a:b] for a, b in zip(cuts, cuts[1:])]

    def _words(self, words: list[str]) -> bytes:
        known = self.known
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            pass
        if len(known) > CACHE:
            known.clear()
        new = [w for w in dict.fromkeys(words) if w not in known]
        known.update(zip(new, self._each(new)))
        return b"".join([known[w] for w in words])

    def encode(self, text: str) -> bytes:
        if not PLAIN.fullmatch(text) or "<|" in text:
            return self._whole([text])[0]
        out, at = [], 0
        while at < len(text):
            end = at + STRETCH
            if end < len(text):             # cut before white space, where words end
                while end < len(text) and text[end] not in " \t\n\r\v\f":
                    end += 1
            out.append(self._words(WORD.findall(text[at:end].lower())))
            at = end
        return b"".join(out)


def _tokenise(name: str, length: int, keep_ids: bool):
    def run(batches):
        words, row = WordIds(name), 0
        for batch in batches:
            ids = batch["id"]
            out: dict[str, list] = defaultdict(list)
            taken = []
            for i, text in enumerate(batch["text"].to_pylist()):
                data = words.encode(text or "") + b"\0\0\0\0"
                for piece, at in enumerate(range(0, len(data), 4 * length)):
                    part = data[at:at + 4 * length]
                    taken.append(i)
                    out["piece"].append(piece)
                    out["start"].append(at // 4)
                    out["length"].append(len(part) // 4)
                    out["ids_crc32"].append(zlib.crc32(part))
                    out["salt"].append(row)
                    if keep_ids:
                        out["ids"].append(part)
                row += 1
            if taken:
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(taken)), pa.array(out["piece"], pa.int32()),
                     *[pa.array(out[c], pa.int64()) for c in ("start", "length", "ids_crc32", "salt")],
                     *([pa.array(out["ids"], pa.binary())] if keep_ids else [])],
                    ["id", "piece", "start", "length", "ids_crc32", "salt", *["ids"] * keep_ids])
    return run


def best_fit(lengths: list[int], size: int, open_bins: int) -> tuple[list[int], list[int]]:
    """(bin, offset) of each length in order of arrival."""
    bits, n_open, n_bins = 0, 0, 0
    free: list[list[int]] = [[] for _ in range(size + 1)]
    bins, offsets = [], []
    for n in lengths:
        fits = bits >> n
        if fits:
            space = n + (fits & -fits).bit_length() - 1
            number = free[space].pop()
            n_open -= 1
            if not free[space]:
                bits ^= 1 << space
        else:
            space, number = size, n_bins
            n_bins += 1
        bins.append(number)
        offsets.append(size - space)
        if space > n:
            if n_open == open_bins:                      # the fullest closes
                least = (bits & -bits).bit_length() - 1
                free[least].pop()
                n_open -= 1
                if not free[least]:
                    bits ^= 1 << least
            free[space - n].append(number)
            bits |= 1 << (space - n)
            n_open += 1
    return bins, offsets


def _pack(size: int, open_bins: int):
    def run(key, group):
        # Pieces arrive in the order of their hash, which has nothing to do with lengths.
        group = group.sort_by([(c, "ascending") for c in ("arrival", "id", "piece", "ids_crc32", "salt")])
        bins, offsets = best_fit(group["length"].to_pylist(), size, open_bins)
        base = key[0].as_py() << 32
        return (group.drop_columns(["bucket", "arrival", "salt"])
                .append_column("sequence_id", pa.array([base + b for b in bins], pa.int64()))
                .append_column("offset", pa.array(offsets, pa.int64())))
    return run


def pack_documents(docs: DataFrame, size: int = SEQUENCE, tokenizer: str = TOKENIZER,
                   open_bins: int = OPEN_BINS, keep_ids: bool = False, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset), one row for each
    piece, with its ids as little-endian 32-bit bytes when `keep_ids` is set.

    A document is the ids of its text and a closing 0; a null or empty text is the
    0 alone. Documents longer than `size` are cut into pieces of that size, the last
    one shorter. Every piece is in one sequence; the pieces of a sequence follow each
    other from offset 0 without gaps. Repeated rows and null ids are packed like any
    other. Other columns, whatever their names, are not read. No rows: no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    ids = ", ids binary" if keep_ids else ""
    fields = f"id {kind}, piece int, start long, length long, ids_crc32 long"
    pieces = stage(rows.mapInArrow(_tokenise(tokenizer, size, keep_ids),
                                   f"{fields}, salt long{ids}"), "pieces")
    buckets = max(1, -(-pieces.count() // BUCKET_PIECES))
    arrival = F.xxhash64("id", "piece", "ids_crc32", "salt")
    return (pieces.withColumn("arrival", arrival).withColumn("bucket", F.pmod("arrival", F.lit(buckets)))
            .groupBy("bucket")
            .applyInArrow(_pack(size, open_bins), f"{fields}{ids}, sequence_id long, offset long")
            .withColumnRenamed("id", id_col))
