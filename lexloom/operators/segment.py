"""Segmentation of legal texts into basis, decision, article and clause blocks.

A document is one row and every cut depends on that row alone, so the whole
operator is a chain of projections: the text is cut by anchored JVM regexes
into zones, the article zone is split into an array, and the array is mapped,
filtered and exploded. No row leaves its task: there is no shuffle, no window
and no UDF, whatever the number of documents or lines.

Positions are kept as prefixes of the text, whose newlines give line numbers.
Articles are cut by writing a reserved noncharacter before each of them, lines that do
not count are taken out of all at once, and the text is split on that character: Spark
keeps the compiled pattern of a literal regex function, a split on one plain character
needs none, and no regex runs for each article inside an interpreted mapping.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import extract as X, fixed_values as fv, rules
from ..functions.text import (INLINE, clean_block, drop_lines, first_line, is_blank, last_lines,
                              line_breaks, normalize_newlines, strip, strip_asterisks,
                              strip_decision_markdown)

MARK = "\ufdd0"              # Unicode noncharacter, reserved for internal use
_S = INLINE
_FLAGS = "(?dmiuU)"

# --- Fixed values: lines and headings that steer the segmentation -------------
DECISION_COLON = rf"QUYẾT{_S}*ĐỊNH{_S}*:"
BASIS_WORDS = rf"(?:Căn{_S}*cứ|Theo{_S}+đề{_S}+nghị)"
DECISION_BOLD = r"(?:\*\*(?iu)QUYẾT\s*ĐỊNH\s*:)"
# What may not stand before it is looked for once its first letter is there.
DECISION_PLAIN = r"(?:[Qq](?<!##\s[Qq])(?<!\*\*[Qq])(?iu)UYẾT\s*ĐỊNH\s*:)"
RECIPIENTS = r"Nơi\s+nhận\s*:"
RECIPIENTS_LINE = rf"Nơi{_S}+nhận{_S}*:"
DECISION_START = r"^[ \t]*+#*+\s*+\*{0,2}+\s*+QUYẾT\s*ĐỊNH\*{0,2}\s*:?[^\n]*"
# The second word takes plain or breve a only, so the correctly accented word
# does not end a decision span. Pass another pattern to change that.
SPAN_RECIPIENTS = r"[ \t]*[*\-•]?\s*N[ơo]i\s+nh[aă]n\s*:?"
SPAN_RECIPIENTS_LINE = rf"{_S}*[*\-•]?{_S}*N[ơo]i{_S}+nh[aă]n{_S}*:"
SPAN_BOUNDARY = (r"(?:[ \t]*\*{0,2}\s*(?:Điều\s+\d|Chương\s+[IVXLC\d]|Phụ\s*lục\s+\d)"
                 r"|(?:KT\.\s*HIỆU TRƯỞNG|HIỆU TRƯỞNG|TM\.\s*|GIÁM ĐỐC|CHỦ TỊCH)\b)")
SCOPE = rf"Phạm{_S}+vi{_S}+điều{_S}+chỉnh"
ARTICLE_ONE_NEAR = rf"Điều{_S}+1"
SIGNATURE = rf"(?:\(Ký\b|Ký{_S}+[^\n]*đóng{_S}+dấu)"
STAR_RULE = rf"^{_S}*\*\*\*"
REGULATION_HEADING = rf"^{_S}*##{_S}+QUY{_S}+ĐỊNH"
GENERAL_RULES = rf"NHỮNG{_S}+QUY{_S}+ĐỊNH{_S}+CHUNG"
ARTICLE_OPEN = rf"{_S}*(?:\*\*)?(?:Điều|Dieu){_S}+\d"
ARTICLE_STOP = (rf"{_S}*(?:(?:\*\*)?(?:Điều{_S}+\d|Phụ{_S}+lục{_S}+\d)|Nơi{_S}+nhận)"
                rf"(?![^\n]*#{_S}*Chương)")
_CAPS = "A-ZÀÁẢÃẠÂẦẤẨẪẬĂẰẮẲẴẶÈÉẺẼẸÊỀẾỂỄỆÌÍỈĨỊÒÓỎÕỌÔỒỐỔỖỘƠỜỚỞỠỢÙÚỦŨỤƯỪỨỬỮỰỲÝỶỸỴĐ,.;:!?"
# Lines left out of an article: headings, chapter lines, rules, and all-capital
# lines of more than 20 characters. The opening line always stays. A line with
# a small letter in first or second place is no capital line: that test spares
# most lines the long class.
def _noise(ends: str) -> str:
    """The lines left out, in a text whose lines end at these characters."""
    rest, end = f"[^{ends}]*", rf"(?=[{ends}]|\z)"
    return (rf"{_S}*+(?:#{rest}|\*\*Chương{rest}|Chương{_S}+[IVXLC\d]{rest}"
            rf"|(?:_{{5,}}|=+|-+){_S}*{end}"
            rf"|(?-i:(?!\p{{Ll}}|[^\n]\p{{Ll}})[{_CAPS}][{_CAPS}\s&&[^\n]]{{19,}}[{_CAPS}]){_S}*{end})")


ARTICLE_NOISE = rf"\n{_noise(chr(92) + 'n')}"
# The same with chapter marks anywhere in a line, for articles with a `#`.
ARTICLE_NOISE_MARKS = rf"\n(?:{_noise(chr(92) + 'n')}|[^\n]*#{_S}*Chương[^\n]*)"
# Both for marked articles.
MARKED_NOISE = rf"\n{_noise(chr(92) + 'n' + MARK)}"
MARKED_NOISE_MARKS = rf"\n(?:{_noise(chr(92) + 'n' + MARK)}|[^\n{MARK}]*#{_S}*Chương[^\n{MARK}]*)"
ARTICLE_NUMBER = rf"(?iuU)\A{_S}*(?:\*\*)?(?:Điều|Dieu){_S}+(\d+)"
BOLD_HEADING = r"(?iuU)\A\*\*(?:Điều|Dieu)\s+\d+\s*[—\-.]?\s*(.*?)\*\*"
OPEN_HEADING = r"(?iuU)\A(?:\*\*)?(?:Điều|Dieu)\s+\d+\s*\.?\s*(.*)\z"
CLAUSE_START = r"(?dmU)^\s*+[0-9]+\.\s+.*$"
CLAUSE_NUMBER = r"(?U)\A\s*([0-9]+)\."
APPENDIX_OPEN = rf"{_S}*(?:\*\*)?Phụ{_S}+lục{_S}+\d"
CHAPTER_OPEN = rf"{_S}*(?:\*\*)?Chương{_S}+[IVXLC\d]"
_BOLD_BOUNDARY = rf"{_S}*\*\*(?:Phụ{_S}+lục{_S}+\d|Điều{_S}+\d|Chương{_S}+[IVXLC\d])"
APPENDIX_STOP = rf"(?:{_BOLD_BOUNDARY}|{_S}*Nơi{_S}+nhận)"
CHAPTER_STOP = rf"(?:{_BOLD_BOUNDARY}|[^\n]*\*{_S}*Nơi{_S}+nhận)"
DECISION_LINE = rf"^{_S}*QUYẾT{_S}*ĐỊNH"
BASIS_OR_ARTICLE = (rf"{_S}*(?:[*\-•]?{_S}*[*\-•]?{_S}*(?:Căn{_S}*cứ|Can{_S}*cu|Theo)\b"
                    rf"|Điều{_S}+\d)")
# Separators that end a line for the basis block only.
_ENDS = r"\n\x0b\x0c\x1c-\x1e\x85\u2028\u2029"


# ---------------------------------------------------------------------------
# Cutting
# ---------------------------------------------------------------------------

def _any_case(pattern: str) -> str:
    """The pattern in any case. A first letter (none of I, K and S, which have a third form)
    is looked for as a class of two and a newline as it is, which spares most places the
    case test."""
    first, rest = pattern[0], pattern[1:]
    if first.isalpha():
        return f"(?:[{first.upper()}{first.lower()}](?iu){rest})"
    if pattern.startswith(r"\n"):
        return rf"(?:\n(?iu){pattern[2:]})"
    return f"(?:(?iu){pattern})"


def from_first(text: Column, pattern: str) -> Column:
    """The text from the first match on; empty without a match. Only a first letter is made
    to stand for both cases, by `_any_case`."""
    if pattern[0].isalpha():
        pattern = _any_case(pattern)
    return F.regexp_extract(text, rf"(?sdmU){pattern}.*\z", 0)


def _with_low(df: DataFrame, text: str) -> DataFrame:
    """The table with `_low`, its text in lower case. A word is looked for in it byte by byte, which
    takes a tenth of the time of a search in any case and spares most texts that search. A word with
    i or s may not be left out so: dotless i and long s count as them and stay in lower case."""
    return df if "_low" in df.columns else df.withColumn("_low", F.lower(F.col(text)))


def _has(word: str) -> Column:
    return F.contains(F.col("_low"), F.lit(word))


def _from_word(text: Column, word: str) -> Column:
    """The text from the first place of a word in any case; empty without it. Places are the same
    in lower case unless a letter became two: then the text is given as it is."""
    at = F.locate(word, F.col("_low"))
    return F.when(F.length(text) != F.length("_low"), text).when(at > 0, F.substr(text, at)).otherwise("")


def before_first(text: Column, pattern: str) -> Column:
    """The text before the first match, in any case; all of it without a match."""
    return F.regexp_extract(text, rf"(?sdmU)\A(?:.*?(?={_any_case(pattern)})|.*)", 0)


def explode_rows(df: DataFrame, array: Column, *keep: str) -> DataFrame:
    """One row per array element: `keep`, `_pos` from 0 and `_e`.

    A plain explode makes the optimizer push `size(array) > 0` below every
    projection and so evaluate the whole cutting chain a second time; the outer
    form with a test on the position does not."""
    return (df.select(*keep, F.posexplode_outer(array).alias("_pos", "_e"))
            .where(F.col("_pos").isNotNull()))


def computed_once(df: DataFrame, *keep: str, **columns: Column) -> DataFrame:
    """`keep` and the named columns, shielded from filters: a later filter or
    join on one of them would otherwise be pushed below the cutting chain with
    a copy of the whole expression."""
    packed = F.struct(*[c.alias(name) for name, c in columns.items()])
    return (df.select(*keep, F.explode_outer(F.array(packed)).alias("_e"))
            .select(*keep, *[F.col(f"_e.{name}").alias(name) for name in columns]))


def keep_rows(df: DataFrame, value: Column, condition, *keep: str, name: str) -> DataFrame:
    """Rows whose computed `value` meets the condition, the value as `name`;
    like `explode_rows`, it computes the value once."""
    rows = explode_rows(df, F.filter(F.array(value), condition), *keep)
    return rows.select(*keep, F.col("_e").alias(name))


def prepare(df: DataFrame, text: str = "text", out: str = "_t") -> DataFrame:
    """Line ends unified and the reserved mark kept out of the text. A replacement compares
    at every byte, so texts without such characters are only looked through for them."""
    given = F.coalesce(F.col(text), F.lit(""))
    changed = F.contains(given, F.lit("\r")) | F.contains(given, F.lit(MARK))
    return df.withColumn(out, F.when(changed, F.replace(
        normalize_newlines(given), F.lit(MARK), F.lit("\ufffd"))).otherwise(given))


# ---------------------------------------------------------------------------
# Basis and decision
# ---------------------------------------------------------------------------

def with_basis(df: DataFrame, text: str = "_t", name: str = "_basis") -> DataFrame:
    """From the first basis line to before the first line with the decision
    colon (which counts from the top of the text); empty when there is none."""
    line = rf"(?<![^{_ENDS}])[^{_ENDS}]*?"
    head = F.col("_head")
    df = df.withColumn("_head", before_first(F.col(text), DECISION_COLON))
    before = F.when(F.octet_length(head) == F.octet_length(text), head).otherwise(
        F.regexp_extract(head, rf"(?s)\A(?:.*[{_ENDS}])?", 0))
    basis = F.regexp_extract(before, rf"(?s){_FLAGS}{line}{BASIS_WORDS}.*\z", 0)
    lines = F.regexp_replace(basis, f"[{_ENDS}]", "\n")
    trimmed = F.regexp_replace(lines, rf"(?dmU){_S}(?<!{_S}{_S}){_S}*+$", "")
    return df.withColumn(name, strip_asterisks(strip(trimmed))).drop("_head")


def with_decision(df: DataFrame, text: str = "_t", name: str = "_decision") -> DataFrame:
    """From the bold decision heading (else a plain one) to before the
    recipients or the end of the text, cleaned of Markdown."""

    def span(start):
        return F.regexp_extract(text, rf"(?sdmU){start}(?:.*?(?={_any_case(RECIPIENTS)})|.*)", 0)

    bold = F.col("_bold")
    return (df.withColumn("_bold", span(DECISION_BOLD))
            .withColumn(name, strip_decision_markdown(
                F.when(bold != "", bold).otherwise(span(DECISION_PLAIN)))).drop("_bold"))


def with_decision_span(df: DataFrame, text: str = "_t",
                       recipients: str = SPAN_RECIPIENTS) -> DataFrame:
    """Add `span_start` and `span_end` line numbers (NULL without a decision).

    One regex takes the text from the decision line to the end of the span: the first
    recipients line after the decision line, else the first signature, article, chapter
    or appendix line, else the end of the text. Line numbers are newline counts. Since the
    decision line's match ends inside a line, every later boundary must come after a
    newline."""
    start = rf"(?s){_FLAGS}(?>{DECISION_START})"
    other = rf"(?:.*?^(?={SPAN_BOUNDARY})|.*)"
    whole = F.regexp_extract(text, rf"{start}(?:.*?^(?={recipients})|{other})", 0)
    kept = df.columns
    if recipients == SPAN_RECIPIENTS:
        # Most texts have no such word and are not searched line by line for one.
        df = _with_low(df, text)
        whole = F.when(_has("nhan") | _has("nhăn"), whole).otherwise(F.regexp_extract(text, start + other, 0))
    found = F.col("_span") != ""
    return (df.withColumn("_span", whole)
            .withColumn("_before", F.when(found, before_first(F.col(text), DECISION_START)))
            .withColumn("span_start", line_breaks(F.col("_before")))
            .withColumn("span_end", F.col("span_start") + F.greatest(
                line_breaks(F.col("_span")) - F.lit(1), F.lit(0)))
            .select(*kept, "span_start", "span_end"))


# ---------------------------------------------------------------------------
# Where articles may start
# ---------------------------------------------------------------------------

def _with_scope_line(df: DataFrame, text: Column) -> DataFrame:
    """Add `_by_scope`: the line of the scope words, or of the earliest
    article-one line among the five lines before; NULL without scope words."""
    scope = F.col("_scope")
    before = F.substr(text, F.lit(1), F.length(text) - F.length(scope))
    return (df.withColumn("_scope", from_first(_from_word(text, "phạm"), SCOPE))
            .withColumn("_before", F.when(scope != "", before))
            .withColumn("_one", from_first(last_lines(F.col("_before"), 6), ARTICLE_ONE_NEAR))
            .withColumn("_by_scope", line_breaks(F.col("_before")) - line_breaks(F.col("_one")))
            .drop("_scope", "_before", "_one"))


def with_article_start(df: DataFrame, text: str = "_t") -> DataFrame:
    """Add `start_line`, the line from which articles are read: the scope line;
    else, after recipients and signature, the line after the regulation
    heading, two after the star rule or three after the signature; else the
    line after a general-rules or regulation heading; else the first line.

    Lines are counted from the end of the text. Each step is NULL once an earlier rule
    has decided, so later scans cost nothing for that row."""
    t = F.col(text)
    signed, star, heading = F.col("_signed"), F.col("_star"), F.col("_heading")

    def line(tail):
        return line_breaks(t) - line_breaks(tail)

    # What follows the recipients' line; what follows a signature begins in the middle of its
    # line, a rule or heading with a newline.
    kept = df.columns
    df = _with_scope_line(_with_low(df, text), t)
    df = (df.withColumn("_signed", from_first(F.regexp_extract(
              F.when(F.col("_by_scope").isNull() & _has("ký"), t),
              rf"(?sdU)[Nn](?iu){RECIPIENTS_LINE[1:]}[^\n]*(.*)\z", 1), rf"(?=[(Kk\x{{212a}}])(?iu){SIGNATURE}"))
          .withColumn("_star", from_first(F.when(F.contains(signed, F.lit("***")), signed), rf"\n(?iu){STAR_RULE[1:]}"))
          .withColumn("_heading", from_first(F.when(F.contains(star, F.lit("##")), star),
                                             rf"\n(?iu){REGULATION_HEADING[1:]}"))
          .withColumn("_by_sign", F.when(heading != "", line(heading) + F.lit(2))
                      .when(star != "", line(star) + F.lit(3)).when(signed != "", line(signed) + F.lit(3))))
    still_open = F.when(F.col("_by_scope").isNull() & F.col("_by_sign").isNull(), t)
    df = (df.withColumn("_general", from_first(_from_word(still_open, "những"), GENERAL_RULES))
          .withColumn("_reg", from_first(F.when(F.contains(t, F.lit("##")), still_open),
                                         rf"(?iu){REGULATION_HEADING}")))

    def next_line(tail):
        return F.when(tail != "", line(tail) + F.lit(1))

    return (df.withColumn("start_line", F.coalesce(
        F.col("_by_scope"), F.col("_by_sign"), next_line(F.col("_general")),
        next_line(F.col("_reg")), F.lit(0))).select(*kept, "start_line"))


# ---------------------------------------------------------------------------
# Articles and clauses
# ---------------------------------------------------------------------------

def _marked(zone: Column, start: str, stop: str) -> Column:
    """The zone with a mark before each of its pieces: before the first start line from the
    top or from a stop line on. What comes before it goes, and a stop line's newline too."""
    return F.regexp_replace(zone, rf"(?s){_FLAGS}(?:\A|\n(?={stop})).*?(?:^(?={start})|\z)", MARK)


def _split_marked(marked: Column) -> Column:
    return F.array_remove(F.split(marked, MARK), "")


def _pieces(zone: Column, start: str, stop: str) -> Column:
    """Cut a zone before every stop line; in each part keep what follows the
    first start line. Parts without one are dropped."""
    return _split_marked(_marked(zone, start, stop))


def _heading(line: Column) -> Column:
    """Title part of an article's first line."""
    return strip(F.when(line.rlike(BOLD_HEADING), F.regexp_extract(line, BOLD_HEADING, 1))
                 .otherwise(F.regexp_extract(line, OPEN_HEADING, 1)))


def _raw_articles(zone: Column) -> Column:
    return _pieces(zone, ARTICLE_OPEN, ARTICLE_STOP)


def _article_content(a: Column) -> Column:
    return (F.when(F.contains(a, F.lit("#")), F.regexp_replace(a, _FLAGS + ARTICLE_NOISE_MARKS, ""))
            .otherwise(F.regexp_replace(a, _FLAGS + ARTICLE_NOISE, "")))


def with_articles(df: DataFrame, zone: str = "_zone", name: str = "_articles") -> DataFrame:
    """Add the array of the contents of the articles of a zone. A first line follows a mark and
    no newline, so it is never taken for one that does not count."""
    marked = F.col("_marked")
    clean = F.when(F.contains(marked, F.lit("#")), F.regexp_replace(
        marked, _FLAGS + MARKED_NOISE_MARKS, "")).otherwise(F.regexp_replace(marked, _FLAGS + MARKED_NOISE, ""))
    return (df.withColumn("_marked", _marked(F.col(zone), ARTICLE_OPEN, ARTICLE_STOP))
            .withColumn(name, _split_marked(clean)).drop("_marked"))


def _section(kind, num, title, khoan, content) -> Column:
    return F.struct(F.lit(kind).alias("section_type"), num.alias("article_num"),
                    title.alias("article_title"), khoan.alias("khoan_num"),
                    content.alias("content"))


def _sections_of(arts: Column) -> Column:
    """Sections of an array of articles: the numbered clauses of each long
    article that should be split, else the article itself. Text before the
    first clause is left out."""

    def cut(a):
        eligible = X.should_split(a["article_title"]) & (
            F.length(a["content"]) >= fv.CLAUSE_SPLIT_MIN_CHARS)
        marked = F.regexp_replace(a["content"], CLAUSE_START, MARK + "$0")
        return F.struct(a["article_num"].alias("num"), a["article_title"].alias("title"),
                        a["content"].alias("content"),
                        F.when(eligible, F.split(marked, MARK)).alias("parts"))

    def emit(p):
        clauses = F.transform(F.slice(p["parts"], F.lit(2), F.size(p["parts"])), strip)
        whole = F.array(_section("article", p["num"], p["title"], F.lit(""), p["content"]))
        return F.when(F.size(p["parts"]) > 1, F.transform(clauses, lambda c: _section(
            "khoan", p["num"], p["title"], F.regexp_extract(c, CLAUSE_NUMBER, 1), c))
        ).otherwise(whole)

    return F.flatten(F.transform(F.transform(arts, cut), emit))


def _part(kind, head, content) -> Column:
    return F.struct(F.lit(kind).alias("section_type"), head.alias("head"), content.alias("content"))


def _parts_of(arts: Column) -> Column:
    """What `_sections_of` gives for contents of articles, each part with the first line of its
    article. A title is looked at only where the article is long and its line has the word."""

    def clauses(a, whole):
        cut = F.split(F.regexp_replace(a, CLAUSE_START, MARK + "$0"), MARK)
        parts = F.get(F.transform(F.array(F.when(X.should_split(_heading(strip(first_line(a)))), cut)), lambda p: F.when(
            F.size(p) > 1, F.transform(F.slice(p, F.lit(2), F.size(p)), lambda c: _part(
                "khoan", first_line(a), strip(c))))), F.lit(0))
        return F.coalesce(parts, whole)

    def emit(a):
        whole = F.array(_part("article", first_line(a), a))
        long = (F.length(a) >= fv.CLAUSE_SPLIT_MIN_CHARS) & F.contains(first_line(a), F.lit("và"))
        return F.when(long, clauses(a, whole)).otherwise(whole)

    return F.flatten(F.transform(arts, emit))


def _article_num(part: Column) -> Column:
    """Number of the article of a part of `_parts_of`; empty for other parts."""
    return F.coalesce(F.regexp_extract(part["head"], ARTICLE_NUMBER, 1), F.lit(""))


def _khoan_num(part: Column) -> Column:
    return F.when(part["section_type"] == "khoan", F.regexp_extract(part["content"], CLAUSE_NUMBER, 1)).otherwise("")


def with_article_zone(df: DataFrame, text: str = "_t",
                      recipients: str = SPAN_RECIPIENTS) -> DataFrame:
    """Add `_zone`: the lines from the start line on and after the decision span."""
    kept = df.columns
    df = with_article_start(with_decision_span(_with_low(df, text), text, recipients), text)
    first = F.greatest(F.col("start_line"), F.coalesce(F.col("span_end") + F.lit(1), F.lit(0)))
    return (df.withColumn("_first", first)
            .withColumn("_zone", drop_lines(F.col(text), F.col("_first")))
            .select(*kept, "span_start", "span_end", "start_line", "_zone"))


def _if_any(c: Column) -> Column:
    """NULL for an empty string. `nullif` would hold its first argument twice: code so long
    that the JVM leaves it uncompiled."""
    return F.get(F.filter(F.array(c), lambda x: x != ""), F.lit(0))


def source_label(s: Column) -> Column:
    """Source label by section type, then by content, then Unknown."""
    kind = s["section_type"]
    article = F.concat(F.lit(fv.SOURCE_ARTICLE + " "), s["article_num"])
    by_type = (F.when(kind == "legal_basis", fv.SOURCE_BASIS)
               .when(kind == "quyet_dinh", fv.SOURCE_DECISION)
               .when(kind == "article", article)
               .when(kind == "khoan", F.concat(article, F.lit(f", {fv.SOURCE_CLAUSE} "),
                                               s["khoan_num"])))
    return F.coalesce(by_type, _if_any(X.source_from_content(s["content"])), F.lit(fv.SOURCE_UNKNOWN))


SECTION_FIELDS = ["section_type", "article_num", "khoan_num", "clause_num", "subsection_num",
                  "point_letter", "phu_luc_num", "named_source", "content"]
CLAUSE_OF_ARTICLE = r"(?sU)Khoản\s+(\d+)[^\n]*?Điều\s+(\d+)"


def label_sections(df: DataFrame, name: str = "source") -> DataFrame:
    """Add the source label to a table of sections of any type, also of types
    that other splitters make (subsections, points, chapters, appendices).
    Fields that the table lacks count as empty."""
    f = {c: F.coalesce(F.col(c), F.lit("")) if c in df.columns else F.lit("")
         for c in SECTION_FIELDS}
    kind = f["section_type"]
    article = F.concat(F.lit(fv.SOURCE_ARTICLE + " "), f["article_num"])

    def clause(number):
        return F.concat(article, F.lit(f", {fv.SOURCE_CLAUSE} "), number)

    def if_given(number):
        return F.when(number == "", article).otherwise(clause(number))

    named = F.regexp_replace(F.regexp_extract(f["named_source"], CLAUSE_OF_ARTICLE, 0),
                             rf"\A{CLAUSE_OF_ARTICLE}\z",
                             f"{fv.SOURCE_ARTICLE} $2, {fv.SOURCE_CLAUSE} $1")
    point_clause = F.when(f["clause_num"] == "", f["khoan_num"]).otherwise(f["clause_num"])
    by_type = (
        F.when(kind == "legal_basis", fv.SOURCE_BASIS)
        .when(kind == "quyet_dinh", fv.SOURCE_DECISION)
        .when(kind == "article", article)
        .when(kind == "khoan", clause(f["khoan_num"]))
        .when(kind == "subsection", clause(f["subsection_num"]))
        .when(kind == "khoan_number_clause",
              F.when(named != "", named).otherwise(clause(f["khoan_num"])))
        .when(kind == "point", F.concat(clause(point_clause), F.lit(f", {fv.SOURCE_POINT} "),
                                        f["point_letter"]))
        .when(kind.isin("nhu_sau_clause", "nhu_sau_article", "quy_trinh_clause",
                        "quy_trinh_article"), if_given(f["clause_num"]))
        .when(kind == "chuong", F.nullif(f["named_source"], F.lit("")))
        .when(kind == "phu_luc", F.concat(F.lit(fv.SOURCE_APPENDIX + " "), f["phu_luc_num"])))
    guess = X.source_from_content(f["content"])
    return df.withColumn(name, F.coalesce(by_type, _if_any(guess), F.lit(fv.SOURCE_UNKNOWN)))


def with_fields(df: DataFrame) -> DataFrame:
    """Add `doc_id`, `date` and `department` of a prepared text."""
    t = F.col("_t")
    return (df.withColumn("_low", F.lower(t))
            .withColumn("date", X.doc_date_text(t))
            .withColumn("department", rules.department(F.col("_low")))
            .withColumn("doc_id", X.doc_number(t, F.col("_low"))))


def _with_parts(df: DataFrame, text: str, recipients: str) -> DataFrame:
    """One row per document with `doc_id`, `date`, `department` and the array `_parts`
    of struct(section_type, head, content): basis, decision, then articles and clauses in
    text order. Only the first two can be blank; those that are do not count."""
    df = with_fields(prepare(df, text))
    df = with_articles(with_article_zone(with_decision(with_basis(df)), "_t", recipients))
    fronts = F.filter(F.array(_part("legal_basis", F.lit(""), F.col("_basis")),
                              _part("quyet_dinh", F.lit(""), F.col("_decision"))),
                      lambda s: ~is_blank(s["content"]))
    return (df.withColumn("_parts", F.concat(fronts, _parts_of(F.col("_articles"))))
            .drop("_t", "_low", "_basis", "_decision", "_zone", "_articles", "span_start", "span_end",
                  "start_line"))


def with_sections(df: DataFrame, text: str = "text",
                  recipients: str = SPAN_RECIPIENTS) -> DataFrame:
    """One row per document with `doc_id`, `date`, `department` and the array
    `sections`: basis, decision, then articles and clauses in text order."""
    def section(p):
        titled = F.when(p["head"] != "", _heading(strip(p["head"]))).otherwise("")
        return F.struct(p["section_type"].alias("section_type"), _article_num(p).alias("article_num"),
                        titled.alias("article_title"), _khoan_num(p).alias("khoan_num"),
                        p["content"].alias("content"))

    return _with_parts(df, text, recipients).withColumn("sections", F.transform("_parts", section)).drop("_parts")


def with_front_blocks(df: DataFrame, text: str = "text", recipients: str = SPAN_RECIPIENTS,
                      unless=None) -> DataFrame:
    """Add `decision` and `first`, the contents of the decision block and of the first
    block, NULL without one. Articles are cut only from texts that have neither basis
    nor decision: for all others the text is NULL from there on. `unless` maps the decision
    to `_unless`; where that is given, nobody asks for the first block and the text is
    NULL before the basis is looked for."""
    shown = lambda c: F.when(~is_blank(F.col(c)), clean_block(F.col(c)))
    df = with_decision(prepare(df, text)).withColumn("decision", shown("_decision"))
    if unless is not None:
        df = df.withColumn("_unless", unless(F.col("decision")))
        df = df.withColumn("_t", F.when(F.col("_unless").isNull(), F.col("_t")))
    df = with_basis(df)
    df = df.withColumn("_front", F.coalesce(shown("_basis"), F.col("decision")))
    df = df.withColumn("_t", F.when(F.col("_front").isNull(), F.col("_t")))
    df = with_articles(with_article_zone(df, "_t", recipients))
    body = F.get(_parts_of(F.slice("_articles", 1, 1)), F.lit(0))
    return df.withColumn("first", F.coalesce("_front", clean_block(body["content"]))).drop(
        "_t", "_basis", "_decision", "_front", "_zone", "_articles", "span_start", "span_end", "start_line")


def _part_label(p: Column) -> Column:
    """`source_label` of a part of `_parts_of`, whose type always gives one."""
    article = F.concat(F.lit(fv.SOURCE_ARTICLE + " "), _article_num(p))
    kind = p["section_type"]
    return (F.when(kind == "article", article).when(kind == "legal_basis", fv.SOURCE_BASIS)
            .when(kind == "quyet_dinh", fv.SOURCE_DECISION)
            .otherwise(F.concat(article, F.lit(f", {fv.SOURCE_CLAUSE} "), _khoan_num(p))))


def with_blocks(df: DataFrame, text: str = "text",
                recipients: str = SPAN_RECIPIENTS) -> DataFrame:
    """One row per document with `doc_id`, `date`, `department` and each part labelled: array
    `blocks` of struct(section_type, source, category, content)."""
    lowered = F.transform("_parts", lambda s: F.struct(s.alias("part"), F.lower(s["content"]).alias("low")))
    return _with_parts(df, text, recipients).withColumn("blocks", F.transform(lowered, lambda s: F.struct(
        s["part"]["section_type"].alias("section_type"), _part_label(s["part"]).alias("source"),
        rules.content_category(s["low"]).alias("category"),
        clean_block(s["part"]["content"]).alias("content")))).drop("_parts")


def split_documents(df: DataFrame, key: str = "doc_key", text: str = "text",
                    recipients: str = SPAN_RECIPIENTS) -> DataFrame:
    """One row per block, numbered from 1 within its document. Parts are
    labelled after the explode, where the expressions are compiled."""
    parts = _with_parts(df.select(key, text), text, recipients)
    rows = explode_rows(parts, F.col("_parts"), key, "doc_id", "department", "date")
    part = F.col("_e")
    rows = rows.withColumn("_low", F.lower(part["content"]))
    return rows.select(
        key, (F.col("_pos") + 1).alias("block_no"), part["section_type"].alias("section_type"),
        "doc_id", "department", F.lit(fv.TYPE_DATA).alias("type_data"),
        rules.content_category(F.col("_low")).alias("category"), "date",
        _part_label(part).alias("source"), clean_block(part["content"]).alias("content"))


# ---------------------------------------------------------------------------
# Single steps as tables
# ---------------------------------------------------------------------------

def document_metadata(df: DataFrame, key: str = "doc_key", text: str = "text") -> DataFrame:
    df = prepare(df.select(key, text), text).withColumn("_low", F.lower("_t"))
    return computed_once(df, key, doc_id=X.doc_number(F.col("_t"), F.col("_low")),
                         date=X.doc_date_text(F.col("_t")),
                         department=rules.department(F.col("_low")))


def _not_blank(c: Column) -> Column:
    return ~is_blank(c)


def legal_basis_blocks(df: DataFrame, key: str = "doc_key", text: str = "text") -> DataFrame:
    found = with_basis(prepare(df.select(key, text), text), name="content")
    return keep_rows(found, F.col("content"), _not_blank, key, name="content")


def decision_blocks(df: DataFrame, key: str = "doc_key", text: str = "text") -> DataFrame:
    found = with_decision(prepare(df.select(key, text), text), name="content")
    return keep_rows(found, F.col("content"), _not_blank, key, name="content")


def decision_span(df: DataFrame, key: str = "doc_key", text: str = "text",
                  recipients: str = SPAN_RECIPIENTS) -> DataFrame:
    """First and last line of the decision span; documents without one give no row."""
    spans = with_decision_span(prepare(df.select(key, text), text), "_t", recipients)
    kept = keep_rows(spans, F.struct("span_start", "span_end"),
                     lambda s: s["span_start"].isNotNull(), key, name="_s")
    return kept.select(key, "_s.span_start", "_s.span_end")


def article_start(df: DataFrame, key: str = "doc_key", text: str = "text") -> DataFrame:
    started = with_article_start(prepare(df.select(key, text), text))
    return computed_once(started, key, start_line=F.col("start_line"))


def split_articles(df: DataFrame, key: str = "doc_key", text: str = "text",
                   recipients: str = SPAN_RECIPIENTS) -> DataFrame:
    """One row per article, before any clause split. The fields are taken after the explode,
    where they are compiled and those that nobody reads are left out."""
    zones = with_article_zone(prepare(df.select(key, text), text), "_t", recipients)
    rows = explode_rows(zones, _raw_articles(F.col("_zone")), key)
    rows = rows.withColumn("_head", strip(first_line(F.col("_e"))))
    return rows.select(
        key, (F.col("_pos") + 1).alias("article_no"),
        F.regexp_extract("_head", ARTICLE_NUMBER, 1).alias("article_num"),
        _heading(F.col("_head")).alias("article_title"), _article_content(F.col("_e")).alias("content"))


def split_clauses(arts: DataFrame, key: str = "doc_key") -> DataFrame:
    """Clause rows of an article table; unsplit articles give one row."""
    pieces = _sections_of(F.array(F.struct("article_num", "article_title", "content")))
    return explode_rows(arts, pieces, key, "article_no").select(
        key, "article_no", (F.col("_pos") + 1).alias("part_no"),
        F.col("_e.section_type").alias("section_type"), F.col("_e.article_num").alias("article_num"),
        F.col("_e.khoan_num").alias("khoan_num"), strip(F.col("_e.content")).alias("content"))


_KINDS = {"phu_luc": (APPENDIX_OPEN, APPENDIX_STOP), "chuong": (CHAPTER_OPEN, CHAPTER_STOP)}


def split_sections(df: DataFrame, kind: str, key: str = "doc_key",
                   text: str = "text") -> DataFrame:
    """Appendix (`phu_luc`) or chapter (`chuong`) sections in text order."""
    start, stop = _KINDS[kind]
    rows = explode_rows(prepare(df.select(key, text), text),
                        _pieces(F.col("_t"), start, stop), key)
    return rows.select(key, (F.col("_pos") + 1).alias("section_no"), F.col("_e").alias("content"))


def decision_to_recipients(df: DataFrame, key: str = "doc_key", text: str = "text",
                           recipients: str = SPAN_RECIPIENTS_LINE) -> DataFrame:
    """From the decision line to before the recipients line or the end, articles
    included, with the line numbers of both ends. The match begins at the start of a line,
    so the lines before it are those that the text has more than the rest."""
    spans = prepare(df.select(key, text), text)
    rest = F.col("_rest")
    spans = spans.withColumn("_rest", F.regexp_extract("_t", rf"(?s){_FLAGS}(?>{DECISION_START}).*\z", 0))
    spans = (spans.withColumn("_body", before_first(F.when(rest != "", rest), rf"\n{recipients}"))
             .withColumn("span_start", F.when(rest != "", line_breaks(F.col("_t")) - line_breaks(rest))))
    out = F.struct("span_start",
                   (F.col("span_start") + line_breaks(F.col("_body"))).alias("end_line"),
                   F.regexp_extract("_body", r"(?sU)\A(.*[^\s\x1c-\x1f])?", 0).alias("content"))
    kept = keep_rows(spans, out, lambda s: s["span_start"].isNotNull(), key, name="_s")
    return kept.select(key, "_s.span_start", "_s.end_line", "_s.content")


def decision_to_first_article(df: DataFrame, key: str = "doc_key",
                              text: str = "text") -> DataFrame:
    """From the first line that starts with the decision words to before the
    next basis or article line."""
    tail = F.regexp_extract("_t", rf"(?s){_FLAGS}{DECISION_LINE}.*\z", 0)
    return keep_rows(prepare(df.select(key, text), text),
                     before_first(tail, rf"\n{BASIS_OR_ARTICLE}"), lambda c: c != "", key,
                     name="content")
