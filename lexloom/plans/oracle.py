"""Expected results as DuckDB SQL.

For the legal texts the answers are computed from the order columns that the
template was filled with, not by reading the text again; sections that mix
several rules are computed by line-wise window queries. For the other tables
the SQL states the same function directly.
"""
from __future__ import annotations

from ..functions import fixed_values as fv
from . import corpus as C

NL = "chr(10)"

ORD = f"""ord AS (
  SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS st, {C._P} AS p, o_orderdate AS od,
    o_orderstatus, o_orderpriority, o_orderdate, o_custkey, o_orderkey, {C._Y} AS y,
    CASE WHEN o_orderstatus = 'P' THEN 2 ELSE 1 END AS nd,
    CASE WHEN {C._P} = '5' THEN 1 ELSE 0 END AS pre,
    coalesce(has1, false) AS has1, coalesce(anyr, false) AS anyr
  FROM orders LEFT JOIN (SELECT l_orderkey, bool_or(l_linenumber = 1) AS has1,
      bool_or(l_returnflag = 'R') AS anyr FROM lineitem GROUP BY 1) i ON l_orderkey = o_orderkey)"""

DOC = f"""{ORD}, doc AS (
  SELECT *, CASE p WHEN '1' THEN concat(k, '/QĐ-ĐHTN') WHEN '2' THEN concat(k, '/QĐ-ĐHTN')
      WHEN '3' THEN CASE st WHEN 'F' THEN concat(k, '/', y, '/TT-BGDĐT')
        WHEN 'O' THEN concat(k, '/', y, '/NĐ-CP') ELSE concat(k, '/NQ-HĐT') END
      WHEN '4' THEN 'QD-DHCNTT&TT' ELSE concat(k, '/', y) END AS doc_id,
    CASE WHEN st = 'F' AND day(od) = 31 THEN '' ELSE strftime(od, '%Y-%m-%d') END AS date,
    CASE p WHEN '1' THEN 'Training Department' WHEN '2' THEN 'Academic Affairs'
      WHEN '3' THEN 'Student Affairs' WHEN '4' THEN 'Finance'
      ELSE CASE WHEN anyr THEN 'Finance' ELSE 'Administration' END END AS department,
    6 + nd AS qd, 7 + nd + pre AS d1, 9 + nd + pre AS nn,
    p IN ('1', '2', '3') AND has1 AS scoped,
    concat('Căn cứ Luật số ', c, ';', {NL}, 'Xét nhu cầu của đơn vị ', c, ';', {NL},
      'Theo đề nghị của ', CASE p WHEN '1' THEN 'phòng Đào tạo' WHEN '2' THEN 'ban Học vụ'
      WHEN '3' THEN 'hội Học sinh' WHEN '4' THEN 'phòng Tài chính' ELSE 'phòng Hành chính' END,
      ';') AS basis,
    CASE WHEN st <> 'P' THEN concat_ws({NL}, 'QUYẾT ĐỊNH:',
      CASE WHEN p = '5' THEN 'Nay ban hành:' END,
      concat('Điều 1. Ban hành kèm theo Quyết định này "Quy định ', st, ' ', c, '".'),
      'Điều 2. Quyết định này có hiệu lực từ ngày ký.') END AS decision,
    CASE WHEN st = 'P' THEN concat('Xét nhu cầu của đơn vị ', c, ';')
      ELSE concat('Quy định ', st, ' ', c) END AS title,
    CASE WHEN st = 'P' THEN 'Xét nhu cầu của đơn' ELSE concat('Quy định ', st, ' ', c) END AS keyword
  FROM ord)"""

# Articles of the legal texts: seq orders them, content is before clean-up.
ARTS = f"""{DOC}, item AS (
  SELECT k, l.*, o_orderpriority, 2 * row_number() OVER (PARTITION BY l_orderkey ORDER BY
      l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_returnflag, l_linestatus) AS seq
  FROM lineitem l JOIN ord ON k = l_orderkey), art AS (
  SELECT k, -2 AS seq, '1' AS num, '' AS title, 0 AS n, '' AS rf,
    concat('**Điều 1.** Ban hành kèm theo Quyết định này "Quy định P ', c, '".') AS content,
    CAST(NULL AS BIGINT) AS sk, CAST(NULL AS BIGINT) AS pk, 0.0 AS q FROM doc WHERE st = 'P'
  UNION ALL SELECT k, -1, '2', 'Quyết định này có hiệu lực từ ngày ký.', 0, '',
    'Điều 2. Quyết định này có hiệu lực từ ngày ký.', NULL, NULL, 0 FROM doc WHERE st = 'P'
  UNION ALL SELECT k, seq, CAST(l_linenumber AS VARCHAR), {C.TITLE}, l_linenumber, l_returnflag,
    CASE l_linenumber
      WHEN 2 THEN concat_ws({NL}, {C.HEAD}, {C.BODY}, {C.CLAUSE_1}, {C.CLAUSE_2}, '', {C.CLAUSE_3}, '')
      WHEN 3 THEN concat_ws({NL}, {C.HEAD}, {C.BODY}, concat('Tổ phụ trách mục ', l_suppkey, '.'), '')
      WHEN 4 THEN concat_ws({NL}, {C.HEAD}, {C.BODY})
      WHEN 5 THEN concat_ws({NL}, {C.HEAD}, {C.BODY}, concat('Dieu 9 noi bo mục ', l_suppkey, '.'), '')
      WHEN 6 THEN concat_ws({NL}, {C.HEAD}, {C.BODY})
      ELSE concat_ws({NL}, {C.HEAD}, {C.BODY}, '') END, l_suppkey, l_partkey, l_quantity FROM item
  UNION ALL SELECT k, seq + 1, '60', concat('Ghi nhớ ', l_suppkey), 60, '',
    concat_ws({NL}, concat('Dieu 60. Ghi nhớ ', l_suppkey), 'Phần ghi nhớ.', ''),
    l_suppkey, l_partkey, 0 FROM item WHERE l_linenumber = 6)"""

_SPLIT = "(n = 2 AND length(content) >= 600)"
_CLEAN = f"trim(replace(content, '**', ''), concat(' ', {NL}))"
SECTIONS = f"""{ARTS}, sec AS (
  SELECT k, -4 AS seq, 0 AS part, 'legal_basis' AS section_type, 'Căn cứ' AS source, basis AS content,
    CASE WHEN p = '1' THEN 'academic_affairs' ELSE '{fv.DEFAULT_CATEGORY}' END AS category,
    0 AS n, '' AS rf, CAST(NULL AS BIGINT) AS sk, CAST(NULL AS BIGINT) AS pk FROM doc
  UNION ALL SELECT k, -3, 0, 'quyet_dinh', 'Quyết định', decision, '{fv.DEFAULT_CATEGORY}', 0, '', NULL, NULL
    FROM doc WHERE decision IS NOT NULL
  UNION ALL SELECT k, seq, 0, 'article', concat('Điều ', num), {_CLEAN},
    CASE rf WHEN 'R' THEN 'finance_and_tuition' WHEN 'A' THEN 'examination' ELSE '{fv.DEFAULT_CATEGORY}' END,
    n, rf, sk, pk FROM art WHERE NOT {_SPLIT}
  UNION ALL SELECT k, seq, m, 'khoan', concat('Điều ', num, ', Khoản ', m), CASE m
      WHEN 1 THEN trim(concat('1. Khoản đầu nêu rõ: ', repeat('Các bên phải tuân theo nội dung này. ', CAST(floor(q) AS INT))))
      WHEN 2 THEN concat('2. Khoản hai dẫn mục ', sk, '.') ELSE '3. Khoản ba kết thúc.' END,
    '{fv.DEFAULT_CATEGORY}', n, rf, sk, pk FROM art, (VALUES (1), (2), (3)) v(m) WHERE {_SPLIT}),
blk AS (SELECT sec.*, doc_id, department, date, title, keyword, c, st,
    CAST(row_number() OVER (PARTITION BY sec.k ORDER BY seq, part) AS INT) AS block_no
  FROM sec JOIN doc ON sec.k = doc.k)"""

_HEADER = (f"concat_ws({NL}, '## Metadata', concat('- **doc_id:** ', doc_id), "
           f"concat('- **department:** ', department), '- **type_data:** markdown', "
           f"concat('- **category:** ', category), concat('- **date:** ', date), "
           f"concat('- **source:** ', source), '', '## Nội dung', '', '')")
RENDERED = f"""{SECTIONS}, md AS (SELECT k, block_no, source, concat({_HEADER}, CASE source
    WHEN 'Căn cứ' THEN concat('Các căn cứ pháp lý để ban hành quy định liên quan đến ', keyword, {NL}, {NL}, content, {NL})
    WHEN 'Quyết định' THEN concat('QUYẾT ĐỊNH ban hành các quy định liên quan đến ', keyword, {NL}, {NL}, content, {NL})
    ELSE content END) AS markdown FROM blk)"""

BLOCK_TITLE = """CASE section_type
  WHEN 'legal_basis' THEN 'Các căn cứ pháp lý để ban hành quy định liên quan đến Xét nhu cầu của đơn'
  WHEN 'quyet_dinh' THEN concat('Quyết định ban hành quy định liên quan đến Quy định ', st, ' ', c)
  WHEN 'khoan' THEN concat(source, ' liên quan đến ', CASE part WHEN 1 THEN 'Quy định'
    WHEN 2 THEN '2. Khoản hai dẫn mục' ELSE '3. Khoản ba kết thúc.' END)
  ELSE CASE WHEN seq = -2 THEN concat('Điều 1. Ban hành kèm theo Quyết định này "Quy định P ', c,
      '" liên quan đến Điều 1. Ban hành kèm')
    WHEN seq = -1 THEN 'Điều 2. Quyết định này có hiệu lực từ ngày ký liên quan đến Điều 2. Quyết định này'
    WHEN n = 60 THEN concat('Điều 60 liên quan đến Dieu 60. Ghi nhớ ', sk)
    ELSE concat(trim(replace(split_part(content, chr(10), 1), '**', '')), ' liên quan đến ',
      CASE rf WHEN 'R' THEN 'Mức học phí của mục' WHEN 'A' THEN 'Kết quả đánh giá mục'
      ELSE 'Các bên tuân theo mục' END) END END"""

# The legal texts themselves, and their lines, for line-wise checks.
TEXTS = f"""{ORD}, texts AS (
  SELECT k AS doc_key, concat_ws({NL}, {C.HEADER}, body) AS text FROM ord LEFT JOIN (
    SELECT l_orderkey, string_agg({C.PIECE}, {NL} ORDER BY l_linenumber, l_partkey, l_suppkey,
      l_shipdate, l_quantity, l_returnflag, l_linestatus) AS body
    FROM lineitem JOIN ord ON l_orderkey = k GROUP BY 1) b ON l_orderkey = k),
lines AS (SELECT doc_key, unnest(string_split(text, {NL})) AS line,
    unnest(range(len(string_split(text, {NL})))) AS line_no FROM texts)"""


def sections_by_line(start: str, stop: str) -> str:
    return f"""WITH {TEXTS}, seg AS (
  SELECT *, count(*) FILTER (regexp_matches(line, '{stop}')) OVER
    (PARTITION BY doc_key ORDER BY line_no) AS s FROM lines), opened AS (
  SELECT *, min(CASE WHEN regexp_matches(line, '{start}') THEN line_no END) OVER
    (PARTITION BY doc_key, s) AS f FROM seg)
SELECT doc_key, CAST(row_number() OVER (PARTITION BY doc_key ORDER BY s) AS INT) AS section_no, content
FROM (SELECT doc_key, s, string_agg(line, {NL} ORDER BY line_no) AS content
      FROM opened WHERE line_no >= f GROUP BY 1, 2)"""


def first_label(low: str, rules, default: str) -> str:
    """CASE over ordered rules, as an expression."""
    whens = " ".join("WHEN " + " OR ".join(f"contains({low}, '{w}')" for w in words) +
                     f" THEN '{label}'" for label, words in rules)
    return f"CASE {whens} ELSE '{default}' END"


# The outline by windows over lines: a node's parent is the last heading before it of a
# lower rank, and the node ends before the next heading of its rank or a lower one.
_HEAD_SQL = [
    ("chuong", 1, r"(?:\*\*)?Chương[ \t]+([IVXLC\d]+)\b"), ("phu_luc", 1, r"(?:\*\*)?Phụ[ \t]+lục[ \t]+(\d+)"),
    ("article", 2, r"(?:\*\*)?(?:Điều|Dieu)[ \t]+(\d+)"), ("khoan", 3, r"(?:(\d+)\.[ \t]|Khoản[ \t]+(\d+))"),
    ("point", 6, r"(?:([a-zđ])\)[ \t]|Điểm[ \t]+([a-zđ])(?:[^\pL\pN_]|$))"), ("buoc", 5, r"(?:-[ \t]*)?Bước[ \t]+(\d+)"),
    ("quy_trinh", 4, r"Quy[ \t]*trình(?:[^\pL\pN_]|$)()"), ("nhu_sau", 4, r".*như[ \t]+sau\"?[ \t]*:[ \t]*$()")]
_SEEN = ", ".join(f"max(CASE WHEN rank = {r} THEN node END) OVER before AS r{r}" for r in range(7))
_NEXT = ", ".join(f"min(CASE WHEN rank <= {r} THEN node END) OVER later AS e{r}" for r in range(7))
_LEVEL = " + ".join(f"CASE WHEN rank > {r} AND r{r} IS NOT NULL AND r{r} > "
                    f"greatest(-1, {', '.join(f'coalesce(r{q}, -1)' for q in range(r)) or '-1'}) THEN 1 ELSE 0 END"
                    for r in range(6))


def outline(more: str) -> str:
    kinds = " ".join(f"WHEN regexp_matches(line, '(?i)^[ \\t]*{p}') THEN '{k}'" for k, _, p in _HEAD_SQL)
    ranks = " ".join(f"WHEN '{k}' THEN {r}" for k, r, _ in _HEAD_SQL)
    numbers = " ".join(
        f"WHEN '{k}' THEN concat(regexp_extract(line, '(?i)^[ \\t]*{p}', 1)"
        + (f", regexp_extract(line, '(?i)^[ \\t]*{p}', 2))" if k in ("khoan", "point") else ")")
        for k, _, p in _HEAD_SQL)
    return f"""WITH {TEXTS}, long AS (SELECT doc_key, concat(text, {NL}, {more}) AS text FROM texts),
olines AS (SELECT doc_key, unnest(string_split(text, {NL})) AS line,
    unnest(range(len(string_split(text, {NL})))) AS line_no FROM long),
kinds AS (SELECT *, CASE {kinds} END AS kind FROM olines),
numbered AS (SELECT *, count(kind) OVER (PARTITION BY doc_key ORDER BY line_no) AS node FROM kinds),
nodes AS (
  SELECT doc_key, CAST(node AS INT) AS node, coalesce(max(kind), 'document') AS kind,
    coalesce(max(CASE kind {numbers} END), '') AS number, coalesce(max(CASE WHEN kind IS NOT NULL THEN line END), '') AS head,
    CASE coalesce(max(kind), 'document') {ranks} ELSE 0 END AS rank, string_agg(line, {NL} ORDER BY line_no) AS content
  FROM numbered GROUP BY doc_key, node),
roots AS (SELECT * FROM nodes UNION ALL SELECT doc_key, 0, 'document', '', '', 0, '' FROM texts
  WHERE doc_key NOT IN (SELECT doc_key FROM nodes WHERE node = 0)),
around AS (SELECT *, count(*) OVER (PARTITION BY doc_key) AS n, {_SEEN}, {_NEXT} FROM roots
  WINDOW before AS (PARTITION BY doc_key ORDER BY node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    later AS (PARTITION BY doc_key ORDER BY node ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
tree AS (SELECT *, {_LEVEL} AS level,
    CASE rank {' '.join(f"WHEN {r} THEN nullif(greatest({', '.join(f'coalesce(r{q}, -1)' for q in range(r))}), -1)" for r in range(1, 7))} END AS parent,
    CASE rank {' '.join(f'WHEN {r} THEN coalesce(e{r}, n)' for r in range(7))} END AS ends,
    CASE WHEN rank >= 3 AND r2 > greatest(r0, coalesce(r1, -1)) THEN r2 END AS a,
    CASE WHEN rank >= 4 AND r3 > greatest(r0, coalesce(r1, -1), coalesce(r2, -1)) THEN r3 END AS c FROM around),
named AS (SELECT t.*, CASE WHEN t.rank = 2 THEN t.number ELSE coalesce(x.number, '') END AS art,
    CASE WHEN t.rank = 3 THEN t.number ELSE coalesce(y.number, '') END AS cl
  FROM tree t LEFT JOIN nodes x ON x.doc_key = t.doc_key AND x.node = t.a
    LEFT JOIN nodes y ON y.doc_key = t.doc_key AND y.node = t.c)
SELECT doc_key, node, CAST(parent AS INT) AS parent, CAST(2 * node - level + 1 AS INT) AS "left",
  CAST(2 * ends - level AS INT) AS "right", CAST(level AS INT) AS level, kind, number,
  CASE WHEN kind = 'chuong' THEN trim(replace(head, '**', '')) WHEN kind = 'phu_luc' THEN concat('Phụ lục ', number)
    WHEN kind = 'article' THEN concat('Điều ', art) WHEN kind = 'khoan' THEN concat('Điều ', art, ', Khoản ', cl)
    WHEN kind = 'point' THEN concat('Điều ', art, ', Khoản ', cl, ', Điểm ', number)
    WHEN kind <> 'document' THEN concat('Điều ', art, CASE WHEN cl <> '' THEN concat(', Khoản ', cl) ELSE '' END) END AS source,
  content FROM named"""


# Amendments, from the columns that the texts were filled with.
AMENDMENTS = f"""ord AS (SELECT *, o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders),
cite AS (
  SELECT k, date, CASE {C._P} WHEN '1' THEN 'amend' WHEN '2' THEN 'replace' WHEN '3' THEN 'repeal' ELSE 'add' END AS action,
    {C.CITED} AS t, CASE WHEN o_orderstatus IN ('F', 'O') THEN CAST({C.CITED_ARTICLE} AS VARCHAR) ELSE '' END AS ta,
    CASE WHEN o_orderstatus = 'F' THEN '1' ELSE '' END AS tc
  FROM ord WHERE {C._P} <> '5'),
edge AS (
  SELECT c.*, CASE WHEN o.k IS NULL THEN 'unknown_document' WHEN t = c.k THEN 'self' WHEN ta = '' THEN 'whole_document'
    WHEN ta NOT IN ('1', '2', '3') THEN 'unknown_article' ELSE 'ok' END AS status, o.k AS target
  FROM cite c LEFT JOIN ord o ON o.k = c.t),
every AS (SELECT k, CAST(unnest([1, 2, 3]) AS VARCHAR) AS article FROM ord),
last AS (SELECT t AS k, ta AS article, arg_max(k, (date, k)) AS to_k, arg_max(action, (date, k)) AS action
  FROM edge WHERE status = 'ok' GROUP BY 1, 2)"""
