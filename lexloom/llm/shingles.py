"""Word and shingle hashes of whole texts, over arrays.

Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased. These separators and letters
are single bytes in UTF-8, so words are cut and hashed on the bytes: a word's hash
is a polynomial over its bytes modulo 2^64, taken from running sums, then mixed.
"""
from __future__ import annotations

import string

import numpy as np

#: Words of a shingle.
WIDTH = 5
#: Bytes hashed at once; a longer text is cut at separators.
STRETCH = 1 << 20
LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
#: Lower case, and every other ASCII sign a separator: words without punctuation.
BARE = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in LOWER)
_IS_SEP = np.zeros(256, bool)
_IS_SEP[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15                   # odd, so it has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, STRETCH)
        x = np.full(size, base, np.uint64)
        x[0] = 1
        _powers[base] = have = np.multiply.accumulate(x)
    return have[:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _stretch(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end byte of each word."""
    b = np.frombuffer(data, np.uint8)
    word = np.concatenate(([False], ~_IS_SEP[b], [False]))
    edge = np.flatnonzero(word[1:] != word[:-1])
    first, end = edge[::2], edge[1::2]
    if not len(first):
        return np.empty(0, np.uint64), first, end
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(b)), out=sums[1:])
    h = (sums[end] - sums[first]) * _power(_INVERSE, len(b))[first]
    return mix(h + (end - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), first, end


def word_hashes(text: str, table: bytes = LOWER) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Hash, first byte and end byte of each word of a text, and the bytes, which
    `table` maps first."""
    data = text.encode("utf-8", "surrogatepass").translate(table)
    if len(data) <= STRETCH:
        return (*_stretch(data), data)
    parts, at = [], 0
    while at < len(data):
        end = min(len(data), at + STRETCH)
        while end < len(data) and not _IS_SEP[data[end]]:
            end += 1
        h, a, b = _stretch(data[at:end])
        parts.append((h, a + at, b + at))
        at = end
    return (*(np.concatenate(x) for x in zip(*parts)), data)


def shingle_hashes(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Hash of the shingle at each position; a shorter sequence is one shingle, no
    words none."""
    n = len(words)
    if n == 0:
        return words
    w = min(n, width)
    k = np.uint64(0xFF51AFD7ED558CCD)
    h = np.full(n - w + 1, w, np.uint64)
    for i in range(w):
        h = (h ^ words[i:n - w + 1 + i]) * k
        h ^= h >> np.uint64(29)
    return mix(h)


def shingle_set(text: str, width: int = WIDTH) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending."""
    return np.unique(shingle_hashes(word_hashes(text)[0], width))
