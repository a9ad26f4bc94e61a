"""Registered queries and their expected results as DuckDB SQL."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import extract as X, fixed_values as fv, rules as R, text as T
from ..operators import (amend as AM, assemble as A, classify as C, clustered as K, lookups as L, outline as OL,
                         render as M, segment as S, store as D)
from ..session import stage_folder
from ..sources import files as FS
from ..streaming import ingest, requests as RQ
from . import oracle as O
from .corpus import OUTLINE_TAIL, amending_corpus, legal_corpus, outline_corpus

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Register a query under its function name, with the SQL that gives the
    same rows."""
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_folder(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder of the cluster."""
    return f"{stage_folder(spark)}/{uuid.uuid4().hex}"


# ---------------------------------------------------------------------------
# Legal texts: document level
# ---------------------------------------------------------------------------

@query(f"WITH {O.TEXTS} SELECT doc_key, text FROM texts")
def corpus(spark, sf_dir):
    return legal_corpus(spark, sf_dir)


@query(f"WITH {O.DOC} SELECT k AS doc_key, doc_id, date, department FROM doc")
def document_metadata(spark, sf_dir):
    return S.document_metadata(legal_corpus(spark, sf_dir))


@query(f"WITH {O.DOC} SELECT k AS doc_key, basis AS content FROM doc")
def legal_basis(spark, sf_dir):
    return S.legal_basis_blocks(legal_corpus(spark, sf_dir))


@query(f"WITH {O.DOC} SELECT k AS doc_key, decision AS content FROM doc WHERE decision IS NOT NULL")
def decision_block(spark, sf_dir):
    return S.decision_blocks(legal_corpus(spark, sf_dir))


# A blank line before a decision line without heading marks belongs to the span.
@query(f"""WITH {O.DOC} SELECT k AS doc_key, CASE WHEN st = 'P' THEN qd ELSE qd - 1 END AS span_start,
  d1 - 1 AS span_end FROM doc""")
def decision_span(spark, sf_dir):
    return S.decision_span(legal_corpus(spark, sf_dir))


@query(f"""WITH {O.DOC} SELECT k AS doc_key, CASE
  WHEN scoped THEN CASE st WHEN 'F' THEN nn + 12 WHEN 'O' THEN nn + 11 ELSE d1 END
  ELSE CASE st WHEN 'F' THEN nn + 9 WHEN 'O' THEN nn + 8 ELSE 0 END END AS start_line FROM doc""")
def article_start(spark, sf_dir):
    return S.article_start(legal_corpus(spark, sf_dir))


# ---------------------------------------------------------------------------
# Legal texts: blocks
# ---------------------------------------------------------------------------

@query(f"""WITH {O.ARTS} SELECT k AS doc_key, CAST(row_number() OVER (PARTITION BY k ORDER BY seq) AS INT)
  AS article_no, num AS article_num, title AS article_title, content FROM art""")
def articles(spark, sf_dir):
    return S.split_articles(legal_corpus(spark, sf_dir))


@query(f"""WITH {O.SECTIONS} SELECT k AS doc_key, CAST(dense_rank() OVER (PARTITION BY k ORDER BY seq) AS INT)
  AS article_no, CAST(greatest(part, 1) AS INT) AS part_no, section_type,
  regexp_extract(source, '^Điều ([0-9]+)', 1) AS article_num,
  CASE WHEN part > 0 THEN CAST(part AS VARCHAR) ELSE '' END AS khoan_num,
  CASE WHEN section_type = 'khoan' THEN content ELSE
    (SELECT trim(art.content, {O.NL}) FROM art WHERE art.k = sec.k AND art.seq = sec.seq) END AS content
  FROM sec WHERE section_type IN ('article', 'khoan')""")
def clauses(spark, sf_dir):
    return S.split_clauses(S.split_articles(legal_corpus(spark, sf_dir)))


_BLOCK_COLUMNS = """k AS doc_key, block_no, section_type, doc_id, department, 'markdown' AS type_data,
  category, date, source, content"""


@query(f"WITH {O.SECTIONS} SELECT {_BLOCK_COLUMNS} FROM blk")
def split_documents(spark, sf_dir):
    return S.split_documents(legal_corpus(spark, sf_dir))


@query(f"""WITH {O.SECTIONS} SELECT category, source = 'Căn cứ' AS is_basis, count(*) AS n_blocks
  FROM blk GROUP BY ALL""")
def block_category(spark, sf_dir):
    blocks = S.split_documents(legal_corpus(spark, sf_dir))
    return (blocks.groupBy("category", (F.col("source") == fv.SOURCE_BASIS).alias("is_basis"))
            .agg(F.count(F.lit(1)).alias("n_blocks")))


@query(f"""WITH {O.SECTIONS} SELECT k AS doc_key, count(*) AS n_blocks,
  count(*) FILTER (section_type = 'legal_basis') AS n_legal_basis,
  count(*) FILTER (section_type = 'quyet_dinh') AS n_quyet_dinh,
  count(*) FILTER (section_type = 'article') AS n_article,
  count(*) FILTER (section_type = 'khoan') AS n_khoan FROM blk GROUP BY k""")
def block_stats(spark, sf_dir):
    return A.block_stats(S.split_documents(legal_corpus(spark, sf_dir)))


_BOLD_STOP = r"^\s*\*\*(Phụ\s+lục\s+\d|Điều\s+\d|Chương\s+[IVXLC\d])"


@query(O.sections_by_line(r"^\s*(\*\*)?Phụ\s+lục\s+\d", _BOLD_STOP + r"|^\s*Nơi\s+nhận"))
def appendix_sections(spark, sf_dir):
    return S.split_sections(legal_corpus(spark, sf_dir), "phu_luc")


@query(O.sections_by_line(r"^\s*(\*\*)?Chương\s+[IVXLC\d]", _BOLD_STOP + r"|\*\s*Nơi\s+nhận"))
def chapter_sections(spark, sf_dir):
    return S.split_sections(legal_corpus(spark, sf_dir), "chuong")


@query(f"""WITH {O.TEXTS}, ends AS (SELECT doc_key, max(line_no) AS last FROM lines GROUP BY 1),
  prev AS (SELECT *, lag(line) OVER (PARTITION BY doc_key ORDER BY line_no) AS before FROM lines),
  starts AS (SELECT doc_key, min(CASE WHEN before = '' AND line NOT LIKE '#%' THEN line_no - 1
      ELSE line_no END) AS f FROM prev
    WHERE regexp_matches(line, '^\\s*#*\\s*\\*{{0,2}}QUYẾT\\s*ĐỊNH') GROUP BY 1)
  SELECT doc_key, CAST(f AS INT) AS span_start, CAST(last AS INT) AS end_line,
    rtrim(string_agg(line, {O.NL} ORDER BY line_no), concat(' ', {O.NL})) AS content
  FROM lines JOIN starts USING (doc_key) JOIN ends USING (doc_key) WHERE line_no >= f GROUP BY 1, 2, 3""")
def decision_to_recipients(spark, sf_dir):
    return S.decision_to_recipients(legal_corpus(spark, sf_dir))


@query(f"""WITH {O.TEXTS}, f AS (SELECT *, min(CASE WHEN regexp_matches(line, '^\\s*QUYẾT\\s*ĐỊNH')
    THEN line_no END) OVER (PARTITION BY doc_key) AS a FROM lines),
  g AS (SELECT *, min(CASE WHEN line_no > a AND regexp_matches(line,
    '^\\s*[*•-]?\\s*[*•-]?\\s*(Căn\\s*cứ|Theo)|^\\s*Điều\\s+\\d') THEN line_no END)
    OVER (PARTITION BY doc_key) AS b FROM f)
  SELECT doc_key, string_agg(line, {O.NL} ORDER BY line_no) AS content FROM g
  WHERE line_no >= a AND (b IS NULL OR line_no < b) GROUP BY 1""")
def decision_to_first_article(spark, sf_dir):
    return S.decision_to_first_article(legal_corpus(spark, sf_dir))


# ---------------------------------------------------------------------------
# Legal texts: titles, keywords, rendering
# ---------------------------------------------------------------------------

@query(f"WITH {O.DOC} SELECT k AS doc_key, title FROM doc")
def document_title(spark, sf_dir):
    return M.document_titles(legal_corpus(spark, sf_dir))


@query(f"WITH {O.DOC} SELECT k AS doc_key, title, keyword FROM doc")
def keywords(spark, sf_dir):
    return M.enrich_keywords(M.document_titles(legal_corpus(spark, sf_dir)))


def _first_words(batches):
    """Answers some titles twice, some with nothing and some not at all."""
    for batch in batches:
        batch = batch[batch["title"].str.len() % 4 > 0]
        words = [" ".join(t.split()[:fv.KEYWORD_WORDS]) for t in batch["title"]]
        yield batch.assign(keyword=words)
        yield batch.assign(keyword=[w if len(w) % 2 else None for w in words])


@query(f"WITH {O.DOC} SELECT k AS doc_key, title, keyword FROM doc")
def keywords_by_generator(spark, sf_dir):
    """The same through the hook for an external generator."""
    titles = M.document_titles(legal_corpus(spark, sf_dir))
    return M.enrich_keywords(titles, _first_words).select("doc_key", "title", "keyword")


def _no_words(batches):
    raise ValueError("asked again")


@query(f"WITH {O.DOC} SELECT k AS doc_key, title, keyword FROM doc")
def keywords_from_memory(spark, sf_dir):
    """Keywords that an earlier run has left, with a generator that gives none any more."""
    titles, memo = M.document_titles(legal_corpus(spark, sf_dir)), work_folder(spark)
    M.enrich_keywords(titles, _first_words, memo=memo)
    return M.enrich_keywords(titles, _no_words, memo=memo).select("doc_key", "title", "keyword")


@query(f"WITH {O.SECTIONS} SELECT k AS doc_key, block_no, source, {O.BLOCK_TITLE} AS title FROM blk")
def block_title(spark, sf_dir):
    return M.block_titles(S.split_documents(legal_corpus(spark, sf_dir)))


@query(f"""WITH {O.SECTIONS} SELECT k AS doc_key, block_no, CASE section_type WHEN 'legal_basis' THEN 'Căn cứ'
  WHEN 'quyet_dinh' THEN 'Điều 1' WHEN 'khoan' THEN '' ELSE CASE WHEN n = 60 THEN '' ELSE source END
  END AS guess FROM blk""")
def source_guess(spark, sf_dir):
    blocks = S.split_documents(legal_corpus(spark, sf_dir))
    return blocks.select("doc_key", "block_no",
                         X.source_from_content(F.col("content")).alias("guess"))


@query(f"""WITH {O.ARTS}, o AS (SELECT k, title, CAST(row_number() OVER (PARTITION BY k ORDER BY seq) AS INT)
  AS article_no FROM art) SELECT k AS doc_key, article_no,
  title = 'Phạm vi điều chỉnh và đối tượng áp dụng' AS scope_and_subject,
  title = 'Phạm vi điều chỉnh' AS scope_only, false AS subject_only,
  title IN ('Nội dung và trách nhiệm', 'Điều kiện và thủ tục') AS split FROM o""")
def title_flags(spark, sf_dir):
    arts = S.split_articles(legal_corpus(spark, sf_dir))
    return arts.select("doc_key", "article_no", X.title_flags(F.col("article_title")).alias("_f"),
                       X.should_split(F.col("article_title")).alias("split")
                       ).select("doc_key", "article_no", "_f.*", "split")


@query(f"WITH {O.RENDERED} SELECT k AS doc_key, block_no, source, markdown FROM md")
def render_blocks(spark, sf_dir):
    return M.render_blocks(legal_corpus(spark, sf_dir))


@query(f"""WITH {O.RENDERED} SELECT k AS doc_key, string_agg(concat(CASE WHEN block_no = 1 THEN ''
    WHEN source LIKE 'Điều%' THEN concat(repeat({O.NL}, 3), '---', repeat({O.NL}, 2))
    ELSE concat(repeat({O.NL}, 2), '---', repeat({O.NL}, 2)) END, markdown), '' ORDER BY block_no)
  AS metadata FROM md GROUP BY k""")
def structure_documents(spark, sf_dir):
    return M.structure_documents(legal_corpus(spark, sf_dir))


@query(f"""WITH {O.SECTIONS} SELECT k AS doc_key, concat({O._HEADER},
  'QUYẾT ĐỊNH ban hành các quy định liên quan đến ', keyword, {O.NL}) AS markdown
  FROM blk WHERE section_type = 'quyet_dinh'""")
def decision_headings(spark, sf_dir):
    return M.decision_headings(legal_corpus(spark, sf_dir))


@query(f"""WITH {O.RENDERED} SELECT concat('order-', k) AS document_id, md5(string_agg(concat(
    CASE WHEN block_no = 1 THEN '' WHEN source LIKE 'Điều%' THEN concat(repeat({O.NL}, 3), '---', repeat({O.NL}, 2))
    ELSE concat(repeat({O.NL}, 2), '---', repeat({O.NL}, 2)) END, markdown), '' ORDER BY block_no)) AS metadata_md5,
    '2024-06-01' AS updated FROM md GROUP BY k
  UNION ALL SELECT concat('blank-', doc_id), md5('keep'), '2024-01-01' FROM labels""")
def write_back(spark, sf_dir):
    """Structured Markdown written back to all documents of the table; blank ones
    keep what they have."""
    return _written(L.rebuild_metadata(_to_structure(spark, sf_dir), "2024-06-01"))


def _to_structure(spark, sf_dir):
    """The legal texts as stored documents, and blank ones with old metadata."""
    at = F.lit("2024-01-01").cast("timestamp")
    legal = legal_corpus(spark, sf_dir).select(F.concat(F.lit("order-"), "doc_key").alias("document_id"), "text")
    blank = table(spark, sf_dir, "labels").select(
        F.concat(F.lit("blank-"), "doc_id").alias("document_id"), F.lit(" \n").alias("text"),
        F.lit("keep").alias("metadata"))
    rows = legal.unionByName(blank, allowMissingColumns=True)
    return D.align_schema(rows.withColumn("created_at", at).withColumn("updated_at", at))


def _written(docs):
    return docs.select("document_id", F.md5("metadata").alias("metadata_md5"),
                       F.date_format("updated_at", "yyyy-MM-dd").alias("updated"))


def _to_generate(spark, sf_dir):
    """Requests: every third legal text twice, blank documents, unknown ids, no ids."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    third = orders.where("k % 3 = 0").select(F.concat(F.lit("order-"), "k").alias("document_id"))
    lost = orders.where("k % 100 = 1").select(F.concat(F.lit("lost-"), "k").alias("document_id"))
    blank = table(spark, sf_dir, "labels").select(F.concat(F.lit("blank-"), "doc_id").alias("document_id"))
    none = lost.select(F.lit("").alias("document_id"))
    return third.unionByName(third).unionByName(lost).unionByName(blank).unionByName(none)


@query(f"""WITH {O.RENDERED}, made AS (SELECT k, md5(string_agg(concat(
    CASE WHEN block_no = 1 THEN '' WHEN source LIKE 'Điều%' THEN concat(repeat({O.NL}, 3), '---', repeat({O.NL}, 2))
    ELSE concat(repeat({O.NL}, 2), '---', repeat({O.NL}, 2)) END, markdown), '' ORDER BY block_no)) AS m
  FROM md GROUP BY k)
  SELECT concat('order-', k) AS document_id, CASE WHEN k % 3 = 0 THEN m END AS metadata_md5,
    CASE WHEN k % 3 = 0 THEN '2024-06-01' ELSE '2024-01-01' END AS updated FROM made
  UNION ALL SELECT concat('blank-', doc_id), md5('keep'), '2024-01-01' FROM labels""")
def generate_metadata(spark, sf_dir):
    """Request, document, structure and update in one."""
    return _written(L.generate_metadata(_to_generate(spark, sf_dir), _to_structure(spark, sf_dir),
                                        "2024-06-01")[0])


@query("""SELECT concat('order-', o_orderkey) AS document_id, 'ok' AS status
    FROM orders, (SELECT unnest([1, 2])) WHERE o_orderkey % 3 = 0
  UNION ALL SELECT concat('lost-', o_orderkey), 'not_found' FROM orders WHERE o_orderkey % 100 = 1
  UNION ALL SELECT '', 'missing_id' FROM orders WHERE o_orderkey % 100 = 1
  UNION ALL SELECT concat('blank-', doc_id), 'empty' FROM labels""")
def generate_metadata_outcome(spark, sf_dir):
    return L.generate_metadata(_to_generate(spark, sf_dir), _to_structure(spark, sf_dir), "2024-06-01")[1]


_KIND = """case l_linenumber when 1 then 'subsection' when 2 then 'point' when 3 then 'nhu_sau_clause'
  when 4 then 'khoan_number_clause' when 5 then 'chuong' when 6 then 'phu_luc' else 'other' end"""


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_linenumber
  WHEN 1 THEN concat('Điều ', l_partkey, ', Khoản ', l_suppkey)
  WHEN 2 THEN concat('Điều ', l_partkey, ', Khoản ', l_suppkey, ', Điểm ', lower(l_returnflag))
  WHEN 3 THEN CASE l_linestatus WHEN 'F' THEN concat('Điều ', l_partkey, ', Khoản ', l_suppkey)
    ELSE concat('Điều ', l_partkey) END
  WHEN 4 THEN concat('Điều ', l_partkey, ', Khoản ', l_suppkey)
  WHEN 5 THEN concat('Chương ', l_suppkey) WHEN 6 THEN concat('Phụ lục ', l_suppkey)
  ELSE CASE l_linestatus WHEN 'F' THEN concat('Phụ lục ', l_partkey) ELSE 'Unknown' END END AS source FROM lineitem""")
def source_labels(spark, sf_dir):
    """Labels of sections of the types that the splitter itself never makes."""
    num = lambda c: F.col(c).cast("string")
    has_clause = (F.col("l_linenumber") != 3) | (F.col("l_linestatus") == "F")
    sections = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.expr(_KIND).alias("section_type"), num("l_partkey").alias("article_num"),
        F.when(has_clause, num("l_suppkey")).alias("clause_num"),
        num("l_suppkey").alias("subsection_num"), F.lower("l_returnflag").alias("point_letter"),
        num("l_suppkey").alias("phu_luc_num"),
        F.when(F.col("l_linenumber") == 4, F.concat(F.lit("Khoản "), "l_suppkey", F.lit(" của Điều "),
                                                    "l_partkey"))
        .otherwise(F.concat(F.lit("Chương "), "l_suppkey")).alias("named_source"),
        F.when(F.col("l_linestatus") == "F", F.concat(F.lit("xem phụ lục "), "l_partkey"))
        .otherwise("văn bản").alias("content"))
    return S.label_sections(sections).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                             "source")


@query(f"""WITH {O.SECTIONS} SELECT k AS doc_key, block_no, CAST(to_json({{'metadata': {{'doc_id': doc_id,
  'department': department, 'type_data': 'markdown', 'category': category, 'date': date,
  'source': source}}, 'content': content}}) AS VARCHAR) AS json FROM blk""")
def blocks_json(spark, sf_dir):
    return M.blocks_to_json(S.split_documents(legal_corpus(spark, sf_dir)))


# ---------------------------------------------------------------------------
# Text functions on the document tables
# ---------------------------------------------------------------------------

_NORMAL = (r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize({0}),"
           r" '[\x00-\x08\x0b-\x1f\x7f-\x{{9f}}]', '', 'g'), '[ \t]+', ' ', 'g'), '\n{{3,}}',"
           r" chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')")


@query(f"SELECT doc_id, {_NORMAL.format('text')} AS text FROM documents")
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", T.normalize_text(F.col("text")).alias("text"))


@query(f"SELECT page_id, {_NORMAL.format('html')} AS text FROM pages")
def normalize_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", T.normalize_text(F.col("html")).alias("text"))


@query("""SELECT doc_id, replace(text, chr(10), chr(10)) AS text FROM documents""")
def newlines(spark, sf_dir):
    """CRLF and CR forms of the texts come back with LF alone."""
    kind = F.when(F.length("lang") + F.length("source") > 6, "\r").otherwise("\r\n")
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_newlines(
        F.replace("text", F.lit("\n"), kind)).alias("text"))


@query(r"""SELECT page_id, regexp_replace(replace(html, '**', ''), '^\s+|\s+$', '', 'g') AS block,
  regexp_replace(regexp_replace(replace(html, '*', ''), '(?m)^#+\s*', '', 'g'), '^\s+|\s+$', '', 'g')
  AS decision, replace(html, '*', '') AS basis FROM pages""")
def clean_markdown(spark, sf_dir):
    html = F.col("html")
    return table(spark, sf_dir, "pages").select(
        "page_id", T.clean_block(html).alias("block"),
        T.strip_decision_markdown(html).alias("decision"), T.strip_asterisks(html).alias("basis"))


@query(r"""SELECT doc_id, regexp_replace(lower(strip_accents(text)), '\s+', ' ', 'g') AS folded
  FROM documents""")
def fold_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.fold(F.col("text")).alias("folded"))


@query(r"""SELECT page_id, NOT regexp_matches(url, '[/\\:*?"<>|]') AND trim(url) <> '' AS url_ok,
  NOT regexp_matches(regexp_extract(url, '[^/]*$'), '[/\\:*?"<>|]')
    AND trim(regexp_extract(url, '[^/]*$')) <> '' AS name_ok FROM pages""")
def valid_name(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", T.valid_name(F.col("url")).alias("url_ok"),
        T.valid_name(F.substring_index("url", "/", -1)).alias("name_ok"))


@query("""SELECT conv_id, turn, contains(lower(text), 'trích xuất') OR contains(lower(text), 'extract')
  OR contains(lower(text), 'markdown') OR contains(lower(text), 'md') AS is_extract FROM conversations""")
def intent(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", T.is_extract_request(F.col("text")).alias("is_extract"))


@query(r"""SELECT conv_id, turn, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) < 50 AS fallback
  FROM conversations""")
def needs_fallback(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", T.needs_fallback(F.col("text")).alias("fallback"))


# ---------------------------------------------------------------------------
# Classification
# ---------------------------------------------------------------------------

# Rules for the languages of the document table, in matching order.
DEMO_RULES = [
    ("contact", ["@", "phone", "http"]),
    ("licence", ["license", "copyright", "apache"]),
    ("german", ["der ", "und ", "ß"]),
    ("french", ["que ", "les ", "ç"]),
    ("spanish", ["ción", "ñ", "los "]),
    ("english", ["the ", "and "]),
]
_DEMO = O.first_label("lower(text)", DEMO_RULES, "other")


@query(f"SELECT doc_id, {_DEMO} AS label FROM documents")
def classify_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return C.classify_documents(docs, rules=DEMO_RULES, default="other").select("doc_id", "label")


def _demo_rules(spark):
    return spark.createDataFrame(R.rule_rows("demo", DEMO_RULES), R.RULE_SCHEMA)


@query(f"SELECT doc_id, {_DEMO} AS label FROM documents")
def classify_rule_join(spark, sf_dir):
    return C.classify_join(table(spark, sf_dir, "documents"), _demo_rules(spark), "other", "doc_id")


@query(f"SELECT doc_id, {_DEMO} AS label FROM documents")
def classify_rule_grams(spark, sf_dir):
    """The same with the rules in several slices."""
    return C.classify_join(table(spark, sf_dir, "documents"), _demo_rules(spark), "other", "doc_id",
                           max_chars=60)


@query("""WITH rules AS (SELECT doc_id AS priority, source AS label, lower(substr(text, 1, 9)) AS keyword
    FROM documents WHERE doc_id % 2 = 0 AND length(text) >= 9),
  keyed AS (SELECT row_number() OVER () AS r, CASE WHEN lang = 'de' THEN NULL ELSE doc_id % 50 END AS k,
    lower(text) AS low FROM documents),
  best AS (SELECT r, arg_min(label, priority) AS label FROM keyed JOIN rules ON contains(low, keyword) GROUP BY r)
  SELECT k, coalesce(label, 'none') AS label FROM keyed LEFT JOIN best USING (r)""")
def classify_rule_many(spark, sf_dir):
    """As many rules as half of the documents, keys that repeat or are NULL."""
    docs = table(spark, sf_dir, "documents")
    rules = docs.where("doc_id % 2 = 0 and length(text) >= 9").select(
        F.col("doc_id").alias("priority"), F.col("source").alias("label"),
        F.substring("text", 1, 9).alias("keyword"))
    keyed = docs.select(F.when(F.col("lang") != "de", F.col("doc_id") % 50).alias("k"), "text")
    return C.classify_join(keyed, rules, "none", "k")


@query(f"""WITH l AS (SELECT {_DEMO} AS label FROM documents),
  labels_listed AS (SELECT unnest([{", ".join(f"'{x}'" for x, _ in DEMO_RULES)}, 'other']) AS label)
  SELECT label, count(l.label) AS n_documents FROM labels_listed LEFT JOIN l USING (label) GROUP BY label""")
def label_counts(spark, sf_dir):
    labelled = classify_documents(spark, sf_dir)
    return C.label_counts(labelled, [x for x, _ in DEMO_RULES] + ["other"])


@query(f"""WITH old AS (SELECT doc_id, {_DEMO} AS label FROM documents),
  changed AS (SELECT doc_id, CASE WHEN quality = 1 THEN CASE toxic WHEN 1 THEN 'toxic' ELSE 'other' END END AS label
    FROM labels),
  now AS (SELECT doc_id, label FROM old WHERE doc_id NOT IN (SELECT doc_id FROM changed)
    UNION ALL SELECT * FROM changed),
  seen AS (SELECT label FROM old UNION SELECT label FROM changed WHERE label IS NOT NULL)
  SELECT seen.label, count(now.label) AS n_documents FROM seen LEFT JOIN now USING (label) GROUP BY seen.label""")
def maintained_counts(spark, sf_dir):
    """Label counts kept up to date: labelled documents of good quality get another label,
    the others are deleted."""
    base = classify_documents(spark, sf_dir)
    counts = base.groupBy("label").agg(F.count(F.lit(1)).alias("n_documents"))
    changed = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, F.when(
        F.col("toxic") == 1, "toxic").otherwise("other")).alias("label"))
    return C.maintain_counts(counts, C.label_deltas(base, changed, "doc_id"))


_NAMES = """concat('/in/', o_custkey, '/', case o_orderpriority when '1-URGENT' then 'Thông báo TUYỂN SINH '
  when '2-HIGH' then 'Mức Học phí ' when '3-MEDIUM' then 'Kế hoạch thực tập ' when '4-NOT SPECIFIED'
  then 'Ghi chú ' else 'Hội thao học bổng ' end, o_orderkey, case o_orderstatus when 'F' then '.PDF'
  when 'O' then '.docx' else '.zip' end)"""


@query(f"""SELECT o_orderkey AS id, regexp_replace(regexp_extract(lower({_NAMES}), '[^/]*$'),
    '\\.(pdf|docx)$', '') AS name, CASE o_orderpriority WHEN '1-URGENT' THEN 'admissions'
    WHEN '2-HIGH' THEN 'finance_and_tuition' WHEN '3-MEDIUM' THEN 'internship'
    WHEN '5-LOW' THEN 'student_affairs' ELSE 'training_and_regulations' END AS category FROM orders""")
def classify_filename(spark, sf_dir):
    names = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"),
                                                  F.expr(_NAMES).alias("path"))
    return names.select("id", T.normalize_filename(F.col("path")).alias("name"),
                        R.filename_category(F.col("path")).alias("category"))


# ---------------------------------------------------------------------------
# Assembly: conversation turns as ordered pieces
# ---------------------------------------------------------------------------

def _turns(spark, sf_dir):
    """Turns as pages; a turn of the user that asks nothing long stays empty."""
    text = F.when((F.col("role") == "user") & (F.length("text") < 60), "").otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_key"), (F.col("turn") + 1).cast("int").alias("page_no"),
        text.alias("text"))


_TURNS = """turns AS (SELECT conv_id AS doc_key, CAST(turn + 1 AS INT) AS page_no,
  CASE WHEN role = 'user' AND length(text) < 60 THEN '' ELSE text END AS text FROM conversations)"""
_ASSEMBLED = _NORMAL.format(
    "coalesce(string_agg(CASE WHEN text <> '' THEN concat('## Trang ', page_no, chr(10), chr(10), "
    + _NORMAL.format("text") + ", chr(10), chr(10)) END, chr(10) ORDER BY page_no), '')")


@query(f"WITH {_TURNS} SELECT doc_key, {_ASSEMBLED} AS text FROM turns GROUP BY doc_key")
def assemble_pages(spark, sf_dir):
    return A.assemble_pages(_turns(spark, sf_dir))


@query(f"""WITH {_TURNS} SELECT doc_key, count(*) AS n_pages, count(*) FILTER (text = '') AS n_missing,
  coalesce(string_agg(page_no, ',' ORDER BY page_no) FILTER (text = ''), '') AS missing_pages
  FROM turns GROUP BY doc_key""")
def missing_pages(spark, sf_dir):
    found = A.missing_pages(_turns(spark, sf_dir))
    return found.withColumn("missing_pages", F.array_join("missing_pages", ","))


@query(f"""WITH {_TURNS} SELECT doc_key, min(page_no) FILTER (trim(text) <> '') AS rank,
  arg_min(text, page_no) FILTER (trim(text) <> '') AS text,
  CASE WHEN count(*) FILTER (trim(text) <> '') = 0 THEN 'failed' ELSE 'ok' END AS status
  FROM turns GROUP BY doc_key""")
def pick_candidate(spark, sf_dir):
    """Turns of a conversation as the outputs of engines tried in order."""
    return A.pick_candidate(_turns(spark, sf_dir), "doc_key", rank="page_no")


@query("""WITH c AS (SELECT conv_id AS doc_key,
    string_agg(text, chr(10) ORDER BY turn NULLS FIRST, text) FILTER (role IS DISTINCT FROM 'assistant') AS text,
    string_agg(text, chr(10) ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant') AS rec
    FROM conversations GROUP BY conv_id)
  SELECT doc_key, CASE WHEN length(trim(text)) >= 50 THEN text WHEN trim(coalesce(rec, '')) <> '' THEN rec
    ELSE '' END AS text, CASE WHEN length(trim(text)) >= 50 THEN 'native'
    WHEN trim(coalesce(rec, '')) <> '' THEN 'recognised' ELSE 'failed' END AS status FROM c""")
def choose_text(spark, sf_dir):
    """Turns of the assistant as recognised text, all others as native text; every
    conversation has a row, also without one or the other."""
    turns = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "doc_key")
    joined = lambda rows: A.ordered_text(rows, "doc_key", "turn", F.col("text"), "\n", order=["text"])
    other = F.when(~F.col("role").eqNullSafe("assistant"), F.col("text")).alias("text")
    return A.choose_text(joined(turns.select("doc_key", "turn", other)), joined(turns.where("role = 'assistant'")))


@query(f"""WITH {_TURNS} SELECT doc_key,
  coalesce(string_agg(CASE WHEN trim(text) <> '' THEN text END, chr(10) || chr(10) ORDER BY page_no), '') AS text,
  CASE WHEN count(*) FILTER (trim(text) <> '') = 0 THEN 'no_content' ELSE 'ok' END AS status
  FROM turns GROUP BY doc_key""")
def assemble_paragraphs(spark, sf_dir):
    return A.assemble_paragraphs(_turns(spark, sf_dir), para_no="page_no")


# ---------------------------------------------------------------------------
# The document table
# ---------------------------------------------------------------------------

def _stored(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id"))
    return docs.select(
        F.concat(F.lit("doc-"), "doc_id").alias("document_id"),
        F.concat("source", F.lit("_"), "doc_id", F.lit(".txt")).alias("filename"),
        F.concat(F.lit("/store/"), "source", F.lit("_"), "doc_id").alias("filepath"), "text",
        F.when(F.col("lang") == "en", "old").alias("metadata"), at.alias("created_at"),
        at.alias("updated_at"))


_AT = "strftime({}, '%Y-%m-%d %H:%M:%S')"
_STORED = """stored AS (SELECT concat('doc-', doc_id) AS document_id, concat(source, '_', doc_id, '.txt') AS filename,
  concat('/store/', source, '_', doc_id) AS filepath, text, CASE WHEN lang = 'en' THEN 'old' END AS metadata,
  make_timestamp((1704067200 + doc_id) * 1000000) AS created_at,
  make_timestamp((1704067200 + doc_id) * 1000000) AS updated_at FROM documents)"""
_DOC_COLUMNS = f"""document_id, filename, filepath, md5(text) AS text_md5, metadata,
  {_AT.format('created_at')} AS created_at, {_AT.format('updated_at')} AS updated_at"""


def _document_columns(df):
    fmt = "yyyy-MM-dd HH:mm:ss"
    return df.select("document_id", "filename", "filepath", F.md5("text").alias("text_md5"),
                     "metadata", F.date_format("created_at", fmt).alias("created_at"),
                     F.date_format("updated_at", fmt).alias("updated_at"))


def _incoming(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.select(
        F.concat(F.lit("doc-"), "user_id").alias("document_id"),
        F.concat(F.lit("event_"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("filename"),
        F.concat(F.lit("/event/"), "user_id").alias("filepath"), F.col("event_type").alias("text"),
        F.col("ts").cast("timestamp").alias("created_at"),
        F.col("ts").cast("timestamp").alias("updated_at"))


@query(f"""WITH {_STORED}, incoming AS (SELECT concat('doc-', user_id) AS document_id,
    concat('event_', lpad(CAST(event_id AS VARCHAR), 12, '0')) AS filename, concat('/event/', user_id) AS filepath,
    event_type AS text, NULL AS metadata, ts AS created_at, ts AS updated_at FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
  SELECT {_DOC_COLUMNS} FROM (SELECT * FROM stored WHERE document_id NOT IN (SELECT document_id FROM incoming)
  UNION ALL SELECT * FROM incoming)""")
def upsert(spark, sf_dir):
    merged = D.upsert_documents(_stored(spark, sf_dir), _incoming(spark, sf_dir),
                                order=("updated_at", "filename"))
    return _document_columns(merged)


def _updates(spark, sf_dir):
    return table(spark, sf_dir, "labels").select(
        F.concat(F.lit("doc-"), "doc_id").alias("document_id"),
        F.concat(F.lit("q"), "quality", F.lit(" t"), "toxic").alias("metadata"),
        F.lit("2024-06-01").cast("timestamp").alias("now"))


@query(f"""WITH {_STORED} SELECT document_id, filename, filepath, md5(text) AS text_md5,
  CASE WHEN l.doc_id IS NULL THEN metadata ELSE concat('q', quality, ' t', toxic) END AS metadata,
  {_AT.format('created_at')} AS created_at,
  CASE WHEN l.doc_id IS NULL THEN {_AT.format('updated_at')} ELSE '2024-06-01 00:00:00' END AS updated_at
  FROM stored LEFT JOIN labels l ON document_id = concat('doc-', l.doc_id)""")
def update_metadata(spark, sf_dir):
    return _document_columns(D.update_metadata(_stored(spark, sf_dir), _updates(spark, sf_dir)))


@query(f"WITH {_STORED} SELECT {_DOC_COLUMNS} FROM stored WHERE document_id = 'doc-17'")
def lookup(spark, sf_dir):
    return _document_columns(D.get_document(_stored(spark, sf_dir), "doc-17"))


@query(f"WITH {_STORED} SELECT {_DOC_COLUMNS} FROM stored ORDER BY stored.created_at DESC, document_id")
def list_newest(spark, sf_dir):
    # The texts are hashed before the sort, which then carries short rows.
    return D.list_documents(_document_columns(_stored(spark, sf_dir)))


PAGE = 100


@query(f"""WITH {_STORED} SELECT {_DOC_COLUMNS} FROM stored ORDER BY stored.created_at DESC, document_id
  LIMIT {PAGE} OFFSET {PAGE}""")
def list_second_page(spark, sf_dir):
    """The page behind the first one's last row."""
    stored = _stored(spark, sf_dir)
    last = D.list_page(stored.select("document_id", "created_at"), PAGE).collect()[-1]
    return _document_columns(D.list_page(stored, PAGE, (last.created_at, last.document_id)))


def _delete_ids(spark, sf_dir):
    return table(spark, sf_dir, "labels").select(F.concat(
        F.when(F.col("quality") == 1, "doc-").otherwise("gone-"), "doc_id").alias("document_id"))


_IDS = "ids AS (SELECT DISTINCT concat(CASE WHEN quality = 1 THEN 'doc-' ELSE 'gone-' END, doc_id) AS document_id FROM labels)"


@query(f"""WITH {_STORED}, {_IDS} SELECT {_DOC_COLUMNS} FROM stored
  WHERE document_id NOT IN (SELECT document_id FROM ids)""")
def delete_remaining(spark, sf_dir):
    return _document_columns(D.delete_documents(_stored(spark, sf_dir), _delete_ids(spark, sf_dir))[0])


@query(f"""WITH {_STORED}, {_IDS} SELECT document_id, filepath IS NOT NULL AS deleted, filepath
  FROM ids LEFT JOIN stored USING (document_id)""")
def delete_outcome(spark, sf_dir):
    return D.delete_documents(_stored(spark, sf_dir), _delete_ids(spark, sf_dir))[1]


def _clustered(spark, sf_dir):
    """The stored documents as a clustered table of their own."""
    name = f"documents_{uuid.uuid4().hex}"
    K.open_table(spark, name, work_folder(spark), parts=16, buckets=16)
    K.upsert(spark, name, _stored(spark, sf_dir))
    return name


@query(ORACLES["upsert"])
def clustered_upsert(spark, sf_dir):
    name = _clustered(spark, sf_dir)
    K.upsert(spark, name, _incoming(spark, sf_dir), order=("updated_at", "filename"))
    return _document_columns(K.read_table(spark, name))


@query(ORACLES["update_metadata"])
def clustered_update(spark, sf_dir):
    name = _clustered(spark, sf_dir)
    K.update_metadata(spark, name, _updates(spark, sf_dir))
    return _document_columns(K.read_table(spark, name))


@query(ORACLES["delete_remaining"])
def clustered_delete(spark, sf_dir):
    name = _clustered(spark, sf_dir)
    K.delete(spark, name, _delete_ids(spark, sf_dir))
    return _document_columns(K.read_table(spark, name))


@query(f"""WITH {_STORED} SELECT document_id, filename, filepath, md5(text) AS text_md5,
  CAST(NULL AS VARCHAR) AS metadata, {_AT.format('created_at')} AS created_at,
  {_AT.format('updated_at')} AS updated_at FROM stored""")
def align_schema(spark, sf_dir):
    return _document_columns(D.align_schema(_stored(spark, sf_dir).drop("metadata")))


# ---------------------------------------------------------------------------
# Joins with pending sources and requests
# ---------------------------------------------------------------------------

def _local(spark, sf_dir):
    """Local sources: one per labelled document, some without document id and
    some not stored."""
    labels = table(spark, sf_dir, "labels")
    known = F.concat(F.lit("doc-"), "doc_id")
    return labels.select(
        F.when(F.col("quality") == 1, known).otherwise(F.concat(F.lit("temp-"), "doc_id")).alias("id"),
        F.concat(F.lit("local_"), "doc_id").alias("name"),
        F.when(F.col("toxic") == 1, F.lit(None)).otherwise(F.concat(F.lit("/up/"), "doc_id")).alias("filepath"),
        F.when(F.col("quality") == 1, known).alias("document_id"))


def _sources(spark, sf_dir):
    return _stored(spark, sf_dir).select(
        F.col("document_id").alias("id"), F.col("filename").alias("name"), "filepath", "document_id",
        F.when(F.col("metadata").isNotNull(), F.col("text")).alias("markdown"))


_LOCAL = """local_sources AS (SELECT CASE WHEN quality = 1 THEN concat('doc-', doc_id) ELSE concat('temp-', doc_id) END AS id,
  concat('local_', doc_id) AS name, CASE WHEN toxic = 1 THEN NULL ELSE concat('/up/', doc_id) END AS filepath,
  CASE WHEN quality = 1 THEN concat('doc-', doc_id) END AS document_id FROM labels)"""
_SOURCES = """sources AS (SELECT document_id AS id, filename AS name, filepath, document_id,
  CASE WHEN metadata IS NOT NULL THEN text END AS markdown FROM stored)"""


@query(f"""WITH {_STORED}, {_SOURCES}, {_LOCAL} SELECT id, name, filepath, document_id FROM sources
  UNION ALL SELECT id, name, filepath, document_id FROM local_sources
  WHERE document_id IS NULL OR id NOT IN (SELECT id FROM sources)""")
def merge_pending(spark, sf_dir):
    merged = L.merge_pending(_sources(spark, sf_dir).drop("markdown"), _local(spark, sf_dir))
    return merged.select("id", "name", "filepath", "document_id")


@query(f"WITH {_STORED}, {_SOURCES} SELECT id, name FROM sources WHERE markdown IS NULL OR markdown = ''")
def backlog(spark, sf_dir):
    return L.backlog(_sources(spark, sf_dir)).select("id", "name")


@query(f"""WITH {_STORED}, {_SOURCES}, {_LOCAL} SELECT id, name FROM sources
  WHERE (markdown IS NULL OR markdown = '') AND id IN (SELECT id FROM local_sources)""")
def backlog_selected(spark, sf_dir):
    return L.backlog(_sources(spark, sf_dir), _local(spark, sf_dir)).select("id", "name")


@query(f"""WITH {_STORED} SELECT req_id, document_id, CASE WHEN document_id = '' THEN 'missing_id'
  WHEN s.filename IS NULL THEN 'not_found' WHEN coalesce(text, '') = '' THEN 'no_text' ELSE 'ok' END AS status,
  length(text) AS n_chars FROM (SELECT event_id AS req_id, CASE event_type WHEN 'error' THEN ''
    WHEN 'click' THEN concat('lost-', user_id) ELSE concat('doc-', user_id) END AS document_id FROM events) e
  LEFT JOIN (SELECT document_id, filename, CASE WHEN metadata = 'old' THEN text ELSE '' END AS text FROM stored) s
  USING (document_id)""")
def metadata_requests(spark, sf_dir):
    requests = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("req_id"), F.when(F.col("event_type") == "error", "")
        .when(F.col("event_type") == "click", F.concat(F.lit("lost-"), "user_id"))
        .otherwise(F.concat(F.lit("doc-"), "user_id")).alias("document_id"))
    docs = _stored(spark, sf_dir).select("document_id", F.when(
        F.col("metadata") == "old", F.col("text")).otherwise("").alias("text"))
    return L.metadata_requests(requests, docs).select(
        "req_id", "document_id", "status", F.length("text").cast("long").alias("n_chars"))


@query(f"""SELECT req_id, doc_key, CASE WHEN d.text IS NULL THEN 'not_found' ELSE 'ok' END AS status, is_extract,
  md5(CASE WHEN d.text IS NOT NULL THEN concat('Đã nhận câu hỏi: ''', question, '''', repeat(chr(10), 2),
    'Nội dung PDF đã được trích xuất sang Markdown:', repeat(chr(10), 2),
    CASE WHEN is_extract THEN d.text ELSE concat(left(d.text, 500), '...') END) END) AS answer_md5
  FROM (SELECT concat(conv_id, '-', turn) AS req_id, conv_id * 3 AS doc_key, text AS question,
    contains(lower(text), 'trích xuất') OR contains(lower(text), 'extract') OR contains(lower(text), 'markdown')
    OR contains(lower(text), 'md') AS is_extract FROM conversations) r
  LEFT JOIN documents d ON d.doc_id = doc_key""")
def answer_requests(spark, sf_dir):
    requests = table(spark, sf_dir, "conversations").select(
        F.concat("conv_id", F.lit("-"), "turn").alias("req_id"), (F.col("conv_id") * 3).alias("doc_key"),
        F.col("text").alias("question"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc_key"), "text")
    return L.answer_requests(requests, docs).select(
        "req_id", "doc_key", "status", "is_extract", F.md5("answer").alias("answer_md5"))


# ---------------------------------------------------------------------------
# Files: document rows in the shape of the binary file source
# ---------------------------------------------------------------------------

_EXT = "case lang when 'en' then '.TXT' when 'de' then '.md' when 'fr' then '.pdf' else '.exe' end"
_PATH = f"concat('/in/', source, '/', doc_id, {_EXT})"


def _as_files(docs: DataFrame, german: str = "ISO-8859-1") -> DataFrame:
    """Documents as files: German ones in Latin-1 unless told otherwise, the others
    in UTF-8."""
    return docs.select(
        F.expr(_PATH).alias("path"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id")).alias("modificationTime"),
        F.col("n_chars").alias("length"),
        F.when(F.col("lang") == "de", F.encode("text", german))
        .otherwise(F.encode("text", "UTF-8")).alias("content"))


@query(f"""SELECT {_PATH} AS path, CASE WHEN lang = 'es' THEN 'unsupported_extension'
  WHEN n_chars > 5000 THEN 'too_large' ELSE 'accepted' END AS outcome FROM documents""")
def accept_files(spark, sf_dir):
    accepted, rejected = FS.accept_files(_as_files(table(spark, sf_dir, "documents")), max_bytes=5000)
    return (accepted.select("path", F.lit("accepted").alias("outcome"))
            .unionByName(rejected.select("path", F.col("reason").alias("outcome"))))


@query(f"""SELECT {_PATH} AS path, sha256(concat({_PATH}, '|', sha256(encode(text)))) AS document_id,
  concat(doc_id, {_EXT}) AS filename, concat(strftime(make_timestamp((1704067200 + doc_id) * 1000000),
  '%Y%m%d_%H%M%S'), '_', doc_id, {_EXT}) AS stored_name FROM documents""")
def assign_keys(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return FS.assign_keys(_as_files(docs, "UTF-8")).select("path", "document_id", "filename", "stored_name")


def _below(folder: str):
    """The path of a file below a folder, from its slash on."""
    return F.regexp_extract("path", f"/{folder.split(':')[-1].lstrip('/')}(/.*)", 1)


@query(f"""SELECT {_PATH} AS path, text, 'ok' AS status FROM documents WHERE lang IN ('en', 'de')
  UNION ALL SELECT {_PATH}, NULL, CASE lang WHEN 'fr' THEN 'needs_parser' ELSE 'unsupported_extension' END
  FROM documents WHERE lang NOT IN ('en', 'de')""")
def read_text_files(spark, sf_dir):
    """The documents written as files of their own, in two encodings, and read again:
    text files with their text, all others with the reason."""
    folder = work_folder(spark)
    FS.write_files(_as_files(table(spark, sf_dir, "documents")), folder)
    listed = FS.list_files(spark, folder)
    texts = FS.read_text_files(spark, folder, listed=listed).select(_below(folder).alias("path"), "text", "status")
    return texts.unionByName(FS.unread_files(spark, folder, listed=listed).select(
        _below(folder).alias("path"), F.lit(None).cast("string").alias("text"), F.col("reason").alias("status")))


_BYTES = "CASE WHEN lang = 'de' THEN length(text) ELSE strlen(text) END"


@query(f"""SELECT concat(doc_id, {_EXT}) AS filename, CASE WHEN lang IN ('en', 'de') AND {_BYTES} <= 5000
  THEN {_NORMAL.format('text')} END AS text, CASE WHEN lang = 'es' THEN 'unsupported_extension'
  WHEN {_BYTES} > 5000 THEN 'too_large' WHEN lang = 'fr' THEN 'needs_parser' ELSE 'ok' END AS status FROM documents""")
def stream_ingest(spark, sf_dir):
    """The documents as files that arrive in a folder, ingested to the end, delivered
    again to a second stream, compacted, and read back from the store."""
    folder = work_folder(spark)
    FS.write_files(_as_files(table(spark, sf_dir, "documents")), f"{folder}/in")
    for again in ("first", "second"):
        ingest.stream_ingest(spark, f"{folder}/in", f"{folder}/store", f"{folder}/{again}",
                             max_bytes=5000).awaitTermination()
    ingest.compact_store(spark, f"{folder}/store")
    return ingest.read_store(spark, f"{folder}/store").select("filename", "text", "status")


# ---------------------------------------------------------------------------
# Outline
# ---------------------------------------------------------------------------

@query(O.outline(OUTLINE_TAIL))
def outline(spark, sf_dir):
    """Every heading of the legal texts in its tree; of the document alone no source."""
    nodes = OL.outline(outline_corpus(spark, sf_dir)).drop("article_num", "clause_num")
    return nodes.withColumn("source", F.when(F.col("kind") != "document", F.col("source")))


# ---------------------------------------------------------------------------
# Amendments
# ---------------------------------------------------------------------------

@query(f"""WITH {O.AMENDMENTS} SELECT k AS doc_key, '2' AS article, action, concat(t, '/QĐ-ĐHTN') AS target_number,
  ta AS target_article, tc AS target_clause, '' AS target_point FROM cite""")
def citations(spark, sf_dir):
    return AM.citations(amending_corpus(spark, sf_dir)).drop("node", "citation_no")


@query(f"""WITH {O.AMENDMENTS} SELECT k AS doc_key, date, '2' AS article, action, target, ta AS target_article,
  status FROM edge""")
def amendment_edges(spark, sf_dir):
    return AM.amendment_edges(amending_corpus(spark, sf_dir)).select(
        "doc_key", "date", "article", "action", "target", "target_article", "status")


@query(f"""WITH RECURSIVE {O.AMENDMENTS}, walk(k, article, cur, cur_article, hops) AS (
    SELECT k, article, to_k, '2', 1 FROM last WHERE action <> 'repeal'
    UNION ALL SELECT w.k, w.article, l.to_k, '2', hops + 1 FROM walk w JOIN last l
      ON l.k = w.cur AND l.article = w.cur_article AND l.action <> 'repeal' WHERE hops < 300),
  ends AS (SELECT w.* FROM walk w WHERE NOT EXISTS (SELECT 1 FROM last l
    WHERE l.k = w.cur AND l.article = w.cur_article AND l.action <> 'repeal')),
  found AS (SELECT e.k AS doc_key, e.article, coalesce(d.cur, e.k) AS newest, coalesce(d.cur_article, e.article) AS newest_article,
      coalesce(d.hops, 0) AS hops, d.k IS NULL AND n.k IS NOT NULL AS cycle
    FROM every e LEFT JOIN ends d ON d.k = e.k AND d.article = e.article
      LEFT JOIN last n ON n.k = e.k AND n.article = e.article AND n.action <> 'repeal')
  SELECT doc_key, f.article, CASE WHEN NOT cycle THEN newest END AS newest, CASE WHEN NOT cycle THEN newest_article END
    AS newest_article, CAST(CASE WHEN NOT cycle THEN hops END AS INT) AS hops,
    CASE WHEN cycle THEN 'cycle' WHEN r.k IS NOT NULL THEN 'repealed' WHEN hops > 0 THEN 'amended' ELSE 'current' END AS status
  FROM found f LEFT JOIN last r ON r.k = newest AND r.article = newest_article AND r.action = 'repeal'""")
def newest_articles(spark, sf_dir):
    return AM.newest_articles(amending_corpus(spark, sf_dir))


@query(f"""WITH {O.AMENDMENTS}, had AS (SELECT t, ta, string_agg(concat(k, '/QĐ-ĐHTN'), '; ' ORDER BY date,
    concat(k, '/QĐ-ĐHTN')) AS amend FROM edge WHERE status = 'ok' GROUP BY 1, 2)
  SELECT e.k AS doc_key, concat('Điều ', article) AS source, coalesce(CASE WHEN article = '2' AND c.k IS NOT NULL THEN concat(
      CASE WHEN c.ta <> '' THEN concat('Điều ', c.ta, ' ') ELSE '' END, c.t, '/QĐ-ĐHTN') END, '') AS modify,
    coalesce(article = '2' AND c.tc <> '', false) AS partial_mod, coalesce(amend, '') AS amend
  FROM every e LEFT JOIN cite c ON c.k = e.k LEFT JOIN had ON had.t = e.k AND had.ta = article""")
def block_amendments(spark, sf_dir):
    blocks = AM.blocks_with_amendments(amending_corpus(spark, sf_dir))
    read = F.from_json("json", "metadata struct<source:string,modify:string,partial_mod:boolean,amend:string>")
    return blocks.select("doc_key", read["metadata"].alias("m")).select("doc_key", "m.*")


# ---------------------------------------------------------------------------
# Streams with state
# ---------------------------------------------------------------------------

def _text_files(docs: DataFrame, folder: str) -> DataFrame:
    return docs.select(F.concat(F.lit(folder), "doc_id", F.lit(".txt")).alias("path"),
                       F.encode("text", "UTF-8").alias("content"))


@query(f"""SELECT sha256(encode(text)) AS document_id, {_NORMAL.format('text')} AS text, 'ok' AS status
  FROM (SELECT DISTINCT text FROM documents)""")
def contents_once(spark, sf_dir):
    """Every text once: the documents as files, again under other names after a restart,
    and again to a second stream into the same store."""
    folder, docs = work_folder(spark), table(spark, sf_dir, "documents")
    for again in ("a", "b"):
        FS.write_files(_text_files(docs, f"{again}/"), f"{folder}/in")
        ingest.contents_once(spark, f"{folder}/in", f"{folder}/store", f"{folder}/first").awaitTermination()
    ingest.contents_once(spark, f"{folder}/in", f"{folder}/store", f"{folder}/second").awaitTermination()
    return ingest.read_store(spark, f"{folder}/store").select("document_id", "text", "status")


@query("""SELECT concat('r', l.doc_id) AS req_id, CASE WHEN l.quality = 0 AND l.toxic = 1 THEN 'missing_id'
    WHEN d.doc_id IS NULL OR l.doc_id % 5 = 0 THEN 'not_found' WHEN trim(d.text) = '' THEN 'empty' ELSE 'ok' END AS status
  FROM labels l LEFT JOIN documents d USING (doc_id)""")
def request_stream(spark, sf_dir):
    """Requests for the labelled documents, of which some name no document and some one
    that never comes; half of the documents come after the requests."""
    folder = work_folder(spark)
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    ident = lambda c: F.sha2(F.concat(F.lit("d"), c), 256)
    title = F.concat(F.lit("Điều 1. "), F.regexp_replace("text", "\\n", " "))
    stored = docs.select(ident(F.col("doc_id")).alias("document_id"), "doc_id",
                         F.when(F.trim("text") == "", F.lit("")).otherwise(title).alias("text"))
    rows = labels.select(
        F.concat(F.lit("r"), "doc_id").alias("req_id"),
        F.when((F.col("quality") == 0) & (F.col("toxic") == 1), "").when(F.col("doc_id") % 5 == 0, "gone")
        .otherwise(ident(F.col("doc_id"))).alias("document_id"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id")).alias("asked_at"))

    def answer(part):
        rows.where(part).write.mode("append").parquet(f"{folder}/requests")
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/requests")
        RQ.answer_stream(stream, f"{folder}/store", f"{folder}/out", f"{folder}/check",
                         "365 days").awaitTermination()

    ingest.append_versions(stored.where("doc_id % 2 = 0"), f"{folder}/store", "early")
    answer("quality = 1")
    ingest.append_versions(stored.where("doc_id % 2 = 1"), f"{folder}/store", "late")
    answer("quality = 0")
    RQ.end_waiting(spark, f"{folder}/store", f"{folder}/out", 1 << 30)
    return RQ.read_answers(spark, f"{folder}/out").select("req_id", "status")
