"""Document-level extraction as narrow regex projections."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed_values as fv
from .text import strip

# --- Fixed values: what a document number may look like ----------------------
_ORG = r"[A-ZĐƠƯ&]+"
NUMBER_LINE = r"(?dmiuU)^\s*+Số\s*:\s*([A-Z0-9ĐƠƯ/.\-–&]+)\s*$"
# (part that must occur in lower case, pattern), in order of preference. A
# number is only tried from its first digit, which keeps the search linear; what
# stands before it is looked for once a digit is there.
_N = r"(?iuU)\d(?<!\d\d)\d*+"
NUMBER_PATTERNS = [
    ("/qđ-", rf"{_N}/QĐ-{_ORG}"),
    ("/tt-", rf"{_N}/\d++/TT-{_ORG}"),
    ("/nđ-cp", rf"{_N}/\d++/NĐ-CP"),
    ("/nq-", rf"{_N}/NQ-{_ORG}"),
    ("qd-dhcntt", r"(?iuU)QD-DHCNTT&?TT"),
    ("", rf"{_N}[/\-]\d+[/\-]?\d*[/\-]?[A-ZĐƠƯ\-&]*"),
]
# --- Fixed values: dates ------------------------------------------------------
_DAY_MONTH_YEAR = r"ngày\s+(\d{1,2})\s+tháng\s+(\d{1,2})\s+năm\s+(\d{4})"
# The place before the comma is not reported, so one character stands for it.
DATE_AFTER_PLACE = rf"(?iuU),(?<=[^,],)\s*{_DAY_MONTH_YEAR}"
DATE_ANYWHERE = rf"(?iuU){_DAY_MONTH_YEAR}"
# --- Fixed values: titles -----------------------------------------------------
ARTICLE_ONE = r"(?iuU)Điều\s*1[.:]"
QUOTED = r'"([^"]+)"'
SCOPE_WORDS = "phạm vi điều chỉnh"
SUBJECT_WORDS = "đối tượng áp dụng"


def _found(c: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def doc_number(text: Column, lowered: Column) -> Column:
    """Document number by the first pattern that matches, else empty.

    A lazily evaluated cascade; a pattern is only tried when the lower-cased
    text contains its fixed part, which is a plain byte search."""
    head = F.substring(text, 1, fv.NUMBER_LINE_CHARS)
    tries = [_found(head, NUMBER_LINE, 1)]
    for part, pattern in NUMBER_PATTERNS:
        hit = _found(text, pattern, 0)
        tries.append(F.when(F.contains(lowered, F.lit(part)), hit) if part else hit)
    return F.coalesce(*tries, F.lit(""))


def _date_of(text: Column, pattern: str) -> Column:
    hit = F.regexp_extract(text, pattern, 0)
    ymd = F.regexp_replace(hit, r"(?sU)\A.*?(\d{1,2})\D+(\d{1,2})\D+(\d{4})\z", "$3-$2-$1")
    # Years 0000-0049 mean 2000-2049 and 0050-0099 mean 1950-1999.
    full = F.regexp_replace(F.regexp_replace(ymd, r"\A00([0-4]\d-)", "20$1"),
                            r"\A00([5-9]\d-)", "19$1")
    # A parser would raise an error for each impossible date.
    return full.try_cast("date")


def doc_date(text: Column) -> Column:
    """First 'place, ngày d tháng m năm y'; if absent or impossible, the first
    such date anywhere; if that is impossible too, NULL."""
    return F.coalesce(_date_of(text, DATE_AFTER_PLACE), _date_of(text, DATE_ANYWHERE))


def doc_date_text(text: Column) -> Column:
    return F.coalesce(F.date_format(doc_date(text), "yyyy-MM-dd"), F.lit(""))


def short_keyword(title: Column) -> Column:
    """First five words."""
    words = F.split(strip(title), r"(?U)[\s\x1c-\x1f]+")
    return F.array_join(F.slice(words, 1, fv.KEYWORD_WORDS), " ")


def title_keyword(title: Column) -> Column:
    """Keyword of a title; empty when the title speaks of a legal basis."""
    def made(t):
        usable = (F.length(t) > 0) & ~F.contains(t, F.lit(fv.SOURCE_BASIS))
        return F.when(usable, short_keyword(t)).otherwise(F.lit(""))

    # The array of one makes the title, which is used three times, be computed once.
    return F.get(F.transform(F.array(title), made), F.lit(0))


def starts_like_heading(line: Column) -> Column:
    hit = F.lit(False)
    for word in fv.TITLE_SKIP_PREFIXES:
        hit = hit | F.startswith(line, F.lit(word))
    return hit


def _first_lines(text: Column, n: int) -> Column:
    return F.split(F.substring_index(text, "\n", n), "\n")


def quoted_name(text: Column, n_lines: int) -> Column:
    """Quoted text of the first article-one line that has any; NULL if none."""
    quoted = F.when(F.contains(text, F.lit('"')), text)
    lines = F.filter(_first_lines(quoted, n_lines), lambda l: F.contains(l, F.lit('"')) & l.rlike(ARTICLE_ONE)
                     & l.rlike(QUOTED))
    return F.regexp_extract(F.get(lines, F.lit(0)), QUOTED, 1)


def _title_sized(line: Column) -> Column:
    return (F.length(line) > 10) & (F.length(line) < 200)


def plain_title(text: Column, n_lines: int, skip_headings: bool = True) -> Column:
    """First line of title length; NULL if none."""
    lines = F.transform(_first_lines(text, n_lines), strip)
    keep = (lambda l: _title_sized(l) & ~starts_like_heading(l)) if skip_headings else _title_sized
    return F.get(F.filter(lines, keep), F.lit(0))


def title_flags(title: Column) -> Column:
    """struct(scope_and_subject, scope_only, subject_only)."""
    low = F.lower(title)
    scope = F.contains(low, F.lit(SCOPE_WORDS))
    subject = F.contains(low, F.lit(SUBJECT_WORDS))
    return F.struct((scope & subject).alias("scope_and_subject"),
                    (scope & ~subject).alias("scope_only"),
                    (subject & ~scope).alias("subject_only"))


def should_split(title: Column) -> Column:
    """Articles whose title joins two subjects are cut into clauses, unless the
    title names the scope of the document."""
    return (F.contains(title, F.lit("và"))
            & ~F.contains(F.lower(title), F.lit(SCOPE_WORDS)))


def source_from_content(content: Column) -> Column:
    """Source label guessed from the words of a block; empty if none fits.

    A block that mentions 'điều' without a number gets no label, and so does
    one that mentions 'khoản' but not 'điều': no other rule is tried."""
    low = F.lower(content)

    def has(word):
        return F.contains(low, F.lit(word))

    def numbered(label, pattern):
        number = _found(low, pattern, 1)
        return F.coalesce(F.concat(F.lit(label + " "), number), F.lit(""))

    return (F.when(has("căn cứ"), fv.SOURCE_BASIS)
            .when(has("điều"), numbered(fv.SOURCE_ARTICLE, r"(?U)điều\s+(\d+)"))
            .when(has("quyết định") & has("ban hành"), fv.SOURCE_DECISION)
            .when(has("khoản"), "")
            .when(has("phụ lục"), numbered(fv.SOURCE_APPENDIX, r"(?U)phụ\s+lục\s+(\d+)"))
            .otherwise(""))


ARTICLE_HEADING = r"(?iuU)(?:\*\*)?Điều\s+\d+\.\s*(.+?)(?:\s*\*\*)?$"


def block_title(content: Column, source: Column) -> Column:
    """Human-readable title of one block from its source kind and first lines."""
    name = F.coalesce(F.when(source == fv.SOURCE_DECISION, quoted_name(content, 50)),
                      plain_title(content, 10), plain_title(content, 5, skip_headings=False),
                      F.lit(fv.DEFAULT_TITLE))
    keyword = title_keyword(name)
    link = F.when(keyword == "", "").otherwise(F.concat(F.lit(fv.KEYWORD_LINK), keyword))

    heads = F.filter(F.transform(_first_lines(content, 5), strip),
                     lambda l: l.rlike(ARTICLE_HEADING))
    heading = F.regexp_extract(F.get(heads, F.lit(0)), ARTICLE_HEADING, 1)
    heading = F.coalesce(strip(F.regexp_replace(strip(heading), r"[,;.]\z", "")), F.lit(""))
    number = F.coalesce(F.get(F.split(strip(source), r"(?U)\s+"), F.lit(1)), F.lit(""))
    plain = F.concat(source, link)
    label = F.concat(F.lit(fv.SOURCE_ARTICLE + " "), number)
    article = (F.when(F.contains(source, F.lit(",")) & F.contains(source, F.lit(fv.SOURCE_CLAUSE)),
                      plain)
               .when(heading != "", F.concat(label, F.lit(". "), heading, link))
               .when(number != "", F.concat(label, link))
               .otherwise(plain))
    return (F.when(source == fv.SOURCE_BASIS, F.concat(F.lit(fv.BASIS_TITLE), link))
            .when(source == fv.SOURCE_DECISION, F.concat(F.lit(fv.DECISION_BLOCK_TITLE), link))
            .when(F.startswith(source, F.lit(fv.SOURCE_ARTICLE)), article)
            .otherwise(plain))
