"""Legal texts derived from the order tables, for queries and benchmarks.

One document per order, one article per line item, written by a template whose
fragments are SQL expressions that Spark and DuckDB both understand. The
template varies with order status, priority, date and the line fields, so that
every segmentation rule meets several kinds of text.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.assemble import ordered_text

NL = "chr(10)"
_P = "substr(o_orderpriority, 1, 1)"
_Y = "year(o_orderdate)"
_DMY = "concat('ngày ', day(o_orderdate), ' tháng ', month(o_orderdate), ' năm ', year(o_orderdate))"

NUMBER = f"""case {_P}
  when '1' then concat('Số: ', o_orderkey, '/QĐ-ĐHTN')
  when '2' then concat('Trích văn bản ', o_orderkey, '/QĐ-ĐHTN.')
  when '3' then case o_orderstatus
    when 'F' then concat('Trích văn bản ', o_orderkey, '/', {_Y}, '/TT-BGDĐT.')
    when 'O' then concat('Trích văn bản ', o_orderkey, '/', {_Y}, '/NĐ-CP.')
    else concat('Trích văn bản ', o_orderkey, '/NQ-HĐT.') end
  when '4' then 'Mã QD-DHCNTT&TT.'
  else concat('Trích văn bản ', o_orderkey, '/', {_Y}, '.') end"""
DATES = f"""case o_orderstatus
  when 'F' then case when day(o_orderdate) = 31
    then concat('Hà Nội, ngày 31 tháng 2 năm ', {_Y}) else concat('Hà Nội, ', {_DMY}) end
  when 'O' then concat('Hà Nội ', {_DMY})
  else concat('Ban hành ', {_DMY}, {NL}, 'Hà Nội, ngày 31 tháng 2 năm ', {_Y}) end"""
PROPOSER = f"""case {_P} when '1' then 'phòng Đào tạo' when '2' then 'ban Học vụ'
  when '3' then 'hội Học sinh' when '4' then 'phòng Tài chính' else 'phòng Hành chính' end"""
BASIS = f"""concat(case when o_orderstatus = 'F' then '*' else '' end, 'Căn cứ Luật số ', o_custkey, ';',
  case when o_orderstatus = 'F' then '*' else '' end, {NL},
  'Xét nhu cầu của đơn vị ', o_custkey, ';', {NL}, 'Theo đề nghị của ', {PROPOSER}, ';')"""
DECISION = f"""concat_ws({NL},
  case o_orderstatus when 'F' then '**QUYẾT ĐỊNH:**' when 'O' then 'QUYẾT ĐỊNH:' else '## QUYẾT ĐỊNH:' end,
  case when {_P} = '5' then 'Nay ban hành:' end,
  concat('**Điều 1.** Ban hành kèm theo Quyết định này "Quy định ', o_orderstatus, ' ', o_custkey, '".'),
  'Điều 2. Quyết định này có hiệu lực từ ngày ký.', 'Nơi nhận:')"""
FILLER = f"""case when o_orderstatus = 'P' then '- Lưu: VT.' else concat_ws({NL}, '- Như trên;', '- Lưu: VT.',
  '', '(Ký tên và đóng dấu)', '', '***', '', case when o_orderstatus = 'F' then '## QUY ĐỊNH' end,
  'Chương I', 'NHỮNG QUY ĐỊNH CHUNG', '') end"""
HEADER = f"concat_ws({NL}, {NUMBER}, {DATES}, '', {BASIS}, '', {DECISION}, {FILLER})"

_SHIP = "cast(cast(l_shipdate as date) as string)"
SCOPE_SUBJECT = "Phạm vi điều chỉnh và đối tượng áp dụng"
SCOPE_ONLY = "Phạm vi điều chỉnh"
NO_SCOPE = "Nguyên tắc áp dụng"
# Title of a line; orders of low priority have another first title.
LINE_TITLE = f"""case l_linenumber
  when 1 then case when l_returnflag = 'R' then '{SCOPE_SUBJECT}' else '{SCOPE_ONLY}' end
  when 2 then 'Nội dung và trách nhiệm' when 3 then 'Điều khoản thi hành' when 4 then 'Hồ sơ kèm theo'
  when 5 then 'Trách nhiệm các bên' when 6 then 'Điều kiện và thủ tục' else 'Hiệu lực' end"""
SCOPED = f"{_P} in ('1', '2', '3')"
TITLE = f"case when l_linenumber = 1 and not ({SCOPED}) then '{NO_SCOPE}' else {LINE_TITLE} end"
def head_of(title: str) -> str:
    return f"""case when l_linestatus = 'F' then concat('**Điều ', l_linenumber, '. ', {title}, '**')
      else concat('Điều ', l_linenumber, '. ', {title}) end"""


HEAD = head_of(TITLE)
BODY = f"""case l_returnflag
  when 'R' then concat('Mức học phí của mục ', l_partkey, ' áp dụng từ ', {_SHIP}, '.')
  when 'A' then concat('Kết quả đánh giá mục ', l_partkey, ' công bố vào ', {_SHIP}, '.')
  else concat('Các bên tuân theo mục ', l_partkey, ' từ ', {_SHIP}, '.') end"""
CLAUSE_1 = """concat('1. Khoản đầu nêu rõ: ',
  repeat('Các bên phải tuân theo nội dung này. ', cast(floor(l_quantity) as int)))"""
CLAUSE_2 = "concat('2. Khoản hai dẫn mục ', l_suppkey, '.')"
CLAUSE_3 = "'3. Khoản ba kết thúc.'"
EXTRA = f"""case l_linenumber
  when 2 then concat_ws({NL}, {CLAUSE_1}, {CLAUSE_2}, '', {CLAUSE_3})
  when 3 then concat_ws({NL}, 'Chương II', 'QUY ĐỊNH VỀ TRÁCH NHIỆM VÀ XỬ LÝ', '-----',
                        concat('Tổ phụ trách mục ', l_suppkey, '.'))
  when 4 then concat_ws({NL}, 'Phụ lục 1', concat('Bảng kê mục ', l_suppkey, '.'))
  when 5 then concat('Dieu 9 noi bo mục ', l_suppkey, '.')
  when 6 then concat_ws({NL}, 'Phụ lục 2', concat('Bảng ', l_suppkey, '.'),
                        concat('Dieu 60. Ghi nhớ ', l_suppkey), 'Phần ghi nhớ.') end"""
PIECE = f"concat_ws({NL}, {HEAD}, {BODY}, {EXTRA}, '')"
LINE_PIECE = f"concat_ws({NL}, {head_of(LINE_TITLE)}, {BODY}, {EXTRA}, '')"
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity",
              "l_returnflag", "l_linestatus"]


def legal_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_key, text): one legal text per order.

    The pieces are joined before they meet the orders, so no order with very
    many lines becomes a hot key of a row-level join."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    # A fixed number of partitions keeps adaptive execution from merging them:
    # the texts compress so well that their size understates the work to come.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    heads = (orders.select("o_orderkey", F.expr(SCOPED).alias("_scoped"),
                           F.expr(HEADER).alias("_head")).repartition(parts, "o_orderkey"))
    # The lines are dealt before their pieces are written: every later step finds them in
    # place, and no text is shuffled.
    items = (spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", *LINE_ORDER)
             .repartition(parts, "l_orderkey"))
    lines = items.select("l_orderkey", *LINE_ORDER, F.expr(LINE_PIECE).alias("_piece"))
    bodies = ordered_text(lines, "l_orderkey", "l_linenumber", F.col("_piece"), "\n",
                          order=LINE_ORDER[1:], name="_body")
    unscoped = F.replace(F.replace("_body", F.lit(SCOPE_SUBJECT), F.lit(NO_SCOPE)),
                         F.lit(SCOPE_ONLY), F.lit(NO_SCOPE))
    body = F.when(F.col("_scoped"), F.col("_body")).otherwise(unscoped)
    return (heads.join(bodies, heads.o_orderkey == bodies.l_orderkey, "left")
            .select(F.col("o_orderkey").alias("doc_key"),
                    F.concat_ws("\n", "_head", body).alias("text")))


#: A last article with points, a procedure and steps, for the outline of a text.
OUTLINE_TAIL = f"""concat_ws({NL}, 'Điều 90. Hồ sơ', 'Hồ sơ gồm các mục như sau:', concat('a) Đơn số ', doc_key),
  '  b) Bản sao', concat('đ) Biên lai ', doc_key), '1. Thực hiện', 'Điểm c. Khác', 'Quy trình nộp',
  concat('- Bước 1: Nộp mục ', doc_key), 'a) Tại quầy', 'Bước 2: Nhận', 'Khoản 2. Thời hạn như sau:', 'a) Một ngày',
  'như một', case when doc_key % 3 = 0 then 'Chương IX' else 'Phụ lục 7' end, '1. Bảng', concat('Dieu ', doc_key))"""


def outline_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The legal texts with that article at their end."""
    return legal_corpus(spark, sf_dir).select("doc_key", F.concat(
        "text", F.lit("\n"), F.expr(OUTLINE_TAIL)).alias("text"))


# Decisions that change each other: what, which article and of which decision.
CITED = "case o_custkey % 8 when 0 then o_orderkey when 1 then o_orderkey + 4 else greatest(o_orderkey - o_custkey % 8, 0) end"
CITED_ARTICLE = "case when o_orderstatus = 'F' then 2 when o_custkey % 16 = 5 then 9 else 2 + o_custkey % 2 end"
CITES = f"""case {_P} when '1' then 'Sửa đổi, bổ sung' when '2' then 'Thay thế' when '3' then 'Bãi bỏ'
  when '4' then 'Bổ sung' end"""
AMENDMENT = f"""coalesce(concat({CITES}, case o_orderstatus when 'F' then ' Khoản 1 Điều 2 của'
  when 'O' then concat(' Điều ', {CITED_ARTICLE}, ' của') else '' end, ' Quyết định số ', {CITED}, '/QĐ-ĐHTN.'),
  'Các đơn vị thi hành.')"""
AMENDING = f"""concat_ws({NL}, concat('Số: ', o_orderkey, '/QĐ-ĐHTN'), concat('Hà Nội, ', {_DMY}), 'QUYẾT ĐỊNH:',
  concat('Điều 1. Ban hành quy định ', o_orderkey, '.'), 'Điều 2. Nội dung', concat('1. ', {AMENDMENT}),
  'Điều 3. Hiệu lực', 'Nơi nhận:')"""


def amending_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_key, text): one decision for each order, most of them changing another."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select(F.col("o_orderkey").alias("doc_key"), F.expr(AMENDING).alias("text"))
