"""Unicode composition and accent removal.

Spark has no normalisation function. Most text needs none: a JVM regex picks
out the rows that could change, and only those carry their text to the Arrow
UDF; for all other rows the UDF sees NULL and no text crosses the boundary.
"""
from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, functions as F

# Code points that composition never changes, alone or next to one another:
# below the combining marks, the precomposed Latin block, and the punctuation
# and letterlike symbols up to the Ohm sign without the marks for symbols.
ALWAYS_COMPOSED = [(0x0000, 0x02FF), (0x1E00, 0x1EFF), (0x2002, 0x20CF), (0x2100, 0x2125)]
# Where accent removal is looked up character by character on the JVM.
FOLDABLE = [(0x0000, 0x036F), (0x1E00, 0x1EFF), (0x2010, 0x2027)]


def _ranges(ranges) -> str:
    return "".join(rf"\x{{{lo:X}}}-\x{{{hi:X}}}" for lo, hi in ranges)


def _outside(ranges, also: str = "") -> str:
    """Class of the characters outside the ranges, or in `also`. The first range
    starts at zero and holds most text, so the class tests against its end
    first. `also` must lie above ASCII, where that test then begins."""
    first = 0x80 if also else ranges[0][1] + 1
    extra = f"[{also}]" if also else ""
    return rf"[\x{{{first:X}}}-\x{{10FFFF}}&&[[^{_ranges(ranges)}]{extra}]]"


def _normalizer(form: str, drop_marks: bool):
    """Build the UDF in a closure so that it is shipped by value."""

    def apply(texts: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            out = unicodedata.normalize(form, t)
            if drop_marks:
                out = "".join(ch for ch in out if not unicodedata.combining(ch))
            return out
        return texts.map(one)

    return F.pandas_udf(apply, "string")


def nfc(c: Column) -> Column:
    """Canonical composition."""
    risky = F.when(c.rlike(_outside(ALWAYS_COMPOSED)), c)
    return F.coalesce(_normalizer("NFC", False)(risky), c)


@lru_cache(maxsize=1)
def _fold_table():
    """(characters, their one-letter bases, dropped marks, the rest) over FOLDABLE."""
    src, dst, dropped, other = [], [], [], []
    for lo, hi in FOLDABLE:
        for cp in range(lo, hi + 1):
            ch = chr(cp)
            bare = "".join(x for x in unicodedata.normalize("NFKD", ch)
                           if not unicodedata.combining(x))
            if bare == ch:
                continue
            if bare == "":
                dropped.append(ch)
            elif len(bare) == 1:
                src.append(ch)
                dst.append(bare)
            else:
                other.append(ch)
    return "".join(src), "".join(dst), "".join(dropped), "".join(other)


def decompose_and_drop_marks(c: Column) -> Column:
    """Compatibility decomposition without combining marks.

    Latin text goes through `translate`; text with characters outside the
    table, or with ones that expand to several letters, through the UDF."""
    src, dst, dropped, other = _fold_table()
    expanding = "".join(rf"\x{{{ord(ch):X}}}" for ch in other)
    hard = c.rlike(_outside(FOLDABLE, expanding))
    simple = F.when(c.rlike(r"[^\x00-\x7f]"), F.translate(c, src + dropped, dst)).otherwise(c)
    via_udf = _normalizer("NFKD", True)(F.when(hard, c))
    return F.coalesce(via_udf, simple)
