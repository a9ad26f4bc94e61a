"""Column functions for text clean-up.

Whitespace here means what Unicode calls whitespace plus the four ASCII
separators U+001C..U+001F; `(?U)` makes Java's classes Unicode-aware, `(?d)`
makes `\\n` the only line end and `(?u)` makes `(?i)` fold accented letters.
"""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed_values as fv
from .unicode_forms import decompose_and_drop_marks, nfc

SPACE = r"[\s\x1c-\x1f]"
NOT_SPACE = r"[^\s\x1c-\x1f]"
INLINE = r"[^\S\n]"          # whitespace that stays on the line


def strip(c: Column) -> Column:
    """Trim Unicode whitespace on both ends in one anchored match."""
    return F.regexp_extract(c, rf"(?sU)\A{SPACE}*+(.*{NOT_SPACE})?", 1)


def is_blank(c: Column) -> Column:
    return ~c.rlike(f"(?U){NOT_SPACE}")


def normalize_newlines(c: Column) -> Column:
    """CRLF and CR become LF (byte-wise replacement, no regex)."""
    crlf = F.replace(c, F.lit("\r\n"), F.lit("\n"))
    return F.replace(crlf, F.lit("\r"), F.lit("\n"))


def tidy_composed(c: Column) -> Column:
    """The part of `normalize_text` that follows Unicode composition."""
    # The control characters that go, and the run of newlines that shrinks.
    no_controls = F.regexp_replace(c, r"[\x00-\x08\x0b-\x1f\x7f-\x9f]+", "")
    # Only runs that change are matched; a single space is left alone.
    one_space = F.regexp_replace(no_controls, r"\t[ \t]*+| [ \t]++", " ")
    return strip(F.regexp_replace(one_space, r"\n{3,}", "\n\n"))


def normalize_text(c: Column) -> Column:
    """NFC, drop control characters except tab and newline, squeeze blanks and
    blank lines, trim. NULL gives the empty string."""
    return tidy_composed(nfc(F.coalesce(c, F.lit(""))))


def clean_block(c: Column) -> Column:
    """Remove bold markers and trim."""
    bold = F.contains(c, F.lit("**"))
    return strip(F.when(bold, F.replace(c, F.lit("**"), F.lit(""))).otherwise(c))


def strip_decision_markdown(c: Column) -> Column:
    """Remove every asterisk and leading heading marks, then trim."""
    starless = F.replace(c, F.lit("*"), F.lit(""))
    return strip(F.regexp_replace(starless, r"(?dmU)^#++\s*+", ""))


def strip_asterisks(c: Column) -> Column:
    return F.replace(c, F.lit("*"), F.lit(""))


def fold(c: Column) -> Column:
    """Accent-free lower case with single spaces; `đ` has no decomposition and
    stays."""
    bare = F.replace(decompose_and_drop_marks(c), F.lit("\n"), F.lit(" "))
    # Only runs that change are matched; a single space is left alone.
    other_space = r"[\x00-\x1f\x7f-\x{10FFFF}&&[\s\x1c-\x1f]]"
    return F.regexp_replace(F.lower(bare), rf"(?U){other_space}{SPACE}*+| {SPACE}++", " ")


def valid_name(c: Column) -> Column:
    """A file name that is not blank and has no reserved character."""
    return F.coalesce(~is_blank(c) & ~c.rlike(fv.FORBIDDEN_NAME_CHARS), F.lit(False))


def normalize_filename(c: Column) -> Column:
    """Base name without a known extension, lower case, trimmed."""
    base = F.substring_index(c, "/", -1)
    known = "|".join(e.lstrip(".") for e in fv.FILENAME_EXTENSIONS)
    return strip(F.lower(F.regexp_replace(base, rf"(?is)\.(?:{known})\z", "")))


def extension(c: Column) -> Column:
    """Lower-case extension of a path, dot included; empty when there is none.
    Leading dots of the base name do not start an extension."""
    base = F.substring_index(c, "/", -1)
    return F.lower(F.regexp_extract(base, r"(?s)\A\.*+[^.].*?(\.[^.]*)\z", 1))


def is_extract_request(c: Column) -> Column:
    """The question asks for the whole text rather than a preview."""
    low = F.lower(c)
    hit = F.lit(False)
    for word in fv.EXTRACT_INTENT_WORDS:
        hit = hit | F.contains(low, F.lit(word))
    return F.coalesce(hit, F.lit(False))


def answer_text(question: Column, text: Column) -> Column:
    """Full text for an extract request, otherwise the first characters."""
    preview = F.concat(F.substring(text, 1, fv.PREVIEW_CHARS), F.lit("..."))
    return F.concat(F.lit(fv.ANSWER_PREFIX), question, F.lit(fv.ANSWER_MIDDLE),
                    F.when(is_extract_request(question), text).otherwise(preview))


def needs_fallback(c: Column) -> Column:
    """Too little text: the document must take the fallback path."""
    return F.length(strip(F.coalesce(c, F.lit("")))) < fv.MIN_TEXT_CHARS


def line_breaks(c: Column) -> Column:
    """Number of `\\n` in a string. A split on one character takes a quarter of the time of a
    replacement, and needs the string once."""
    return F.array_size(F.split(c, "\n", -1)) - F.lit(1)


def drop_lines(c: Column, n: Column) -> Column:
    """The text without its first `n` lines; empty when there are fewer."""
    lines = F.slice(F.split(c, "\n", -1), n + F.lit(1), F.lit(2**30))
    return F.when(n <= 0, c).otherwise(F.array_join(lines, "\n"))


def last_lines(c: Column, n: int) -> Column:
    """The last `n` lines of a text (all of it when it has fewer)."""
    return F.substring_index(c, "\n", -n)


def first_line(c: Column) -> Column:
    return F.substring_index(c, "\n", 1)
