import random
import re
import unicodedata

from pyspark.sql import functions as F

from lexloom.functions import extract as X, rules as R, text as T
from lexloom.functions.unicode_forms import ALWAYS_COMPOSED, nfc


def values(spark, fn, inputs):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(inputs)], "i int, s string")
    return [r.v for r in df.select("i", fn(F.col("s")).alias("v")).orderBy("i").collect()]


def test_always_composed_ranges_never_change():
    ranges = [chr(c) for lo, hi in ALWAYS_COMPOSED for c in range(lo, hi + 1)]
    assert all(unicodedata.normalize("NFC", ch) == ch for ch in ranges)
    joined = "".join(ranges)
    assert unicodedata.is_normalized("NFC", joined)
    assert unicodedata.is_normalized("NFC", joined[::-1])
    assert not any(unicodedata.combining(ch) for ch in ranges)


def test_nfc_of_decomposed_and_other_scripts(spark):
    inputs = ["Quyết định", unicodedata.normalize("NFD", "Quyết định số 5"), "한국어",
              unicodedata.normalize("NFD", "한국어"), "Ω", "ẹ́", None, ""]
    want = [None if s is None else unicodedata.normalize("NFC", s) for s in inputs]
    assert values(spark, nfc, inputs) == want


def test_normalize_text(spark):
    nfd = unicodedata.normalize("NFD", "Điều lệ")
    inputs = [f"  {nfd}\t\t x\r\n\n\n\n\ny\f \x85\xa0", "a\xa0b", None, " \t ", "　a "]
    assert values(spark, T.normalize_text, inputs) == [
        "Điều lệ x\n\ny", "a\xa0b", "", "", "a"]


def test_normalize_text_twice_changes_nothing(spark):
    rng = random.Random(7)
    inputs = ["".join(rng.choice("ab ộ\t\n\u0323\u200b\xa0đ") for _ in range(40))
              for _ in range(200)]
    once = values(spark, T.normalize_text, inputs)
    assert values(spark, T.normalize_text, once) == once


def test_control_character_between_letter_and_mark(spark):
    """Composition comes first, so one pass leaves the pair apart."""
    once = values(spark, T.normalize_text, ["a\x00\u0301"])
    assert once == ["a\u0301"]
    assert values(spark, T.normalize_text, once) == ["\u00e1"]


def test_fold_equals_definition(spark):
    rng = random.Random(3)
    alphabet = "aÁạộĐđỆươ \t\n ßﬁ½²İıéñḈ̣한語Ως–•"
    inputs = ["".join(rng.choice(alphabet) for _ in range(30)) for _ in range(300)]

    def want(s):
        bare = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
        return re.sub(r"\s+", " ", bare.lower())

    got = values(spark, T.fold, inputs)
    # A final sigma is the one letter whose lower case depends on its neighbours.
    norm = lambda s: s.replace("ς", "σ")
    assert [norm(g) for g in got] == [norm(want(s)) for s in inputs]


def test_fold_keeps_dyet(spark):
    assert values(spark, T.fold, ["Đường  ĐI\nđẹp"]) == ["đuong đi đep"]


def test_strip_and_blank(spark):
    inputs = ["　 a b\x1f\n", " \x85", "", "x", "\n\n", None]
    assert values(spark, T.strip, inputs) == ["a b", "", "", "x", "", None]
    assert values(spark, T.is_blank, inputs) == [False, True, True, False, True, None]


def test_markdown_cleaning(spark):
    assert values(spark, T.clean_block, [" **a** *b* "]) == ["a *b*"]
    assert values(spark, T.strip_decision_markdown, ["**# A**\n##\nB # c\n### D"]) == \
        ["A\nB # c\nD"]


def test_file_names(spark):
    names = ["/in/Quy Chế.PDF", "a.tar.md", "b.exe", " x .docx", "noext", "/p/.txt"]
    assert values(spark, T.normalize_filename, names) == \
        ["quy chế", "a.tar", "b.exe", "x", "noext", ""]
    assert values(spark, T.extension, ["/a/B.TXT", "/a/b", "/a.d/b", "/a/.txt", "/a/x.tar.gz", "q."]) == \
        [".txt", "", "", "", ".gz", "."]
    assert values(spark, T.valid_name, ["a", " ", "a/b", "a\\b", 'a"', "a|b", None, "a.b"]) == \
        [True, False, False, False, False, False, False, True]


def test_intent_and_fallback(spark):
    assert values(spark, T.is_extract_request, ["TRÍCH XUẤT đi", "cmd", "hello", None]) == \
        [True, True, False, False]
    assert values(spark, T.needs_fallback, ["x" * 50, " " + "x" * 49 + " ", None]) == \
        [False, True, True]


def test_line_helpers(spark):
    df = spark.createDataFrame([("a\nb\nc",)], "s string")
    s = F.col("s")
    row = df.select(T.line_breaks(s).alias("n"), *[
        T.drop_lines(s, F.lit(i)).alias(f"d{i}") for i in range(5)]).first()
    assert tuple(row) == (2, "a\nb\nc", "b\nc", "c", "", "")


def number(spark, text):
    df = spark.createDataFrame([(text,)], "s string")
    return df.select(X.doc_number(F.col("s"), F.lower("s"))).first()[0]


def test_document_number_order(spark):
    far = "x\n" * 1000 + "Số: 5/QĐ-ABC\n"
    assert number(spark, "a\n  số : 429/QĐ-ĐHCNT&TT \nb") == "429/QĐ-ĐHCNT&TT"
    assert number(spark, "Luật số: 5 và 1893/QĐ-ĐHTN, 1/NQ-X") == "1893/QĐ-ĐHTN"
    assert number(spark, far + "7/QĐ-XYZ") == "5/QĐ-ABC"
    assert number(spark, "x" * 2001 + "\nSố: 77-A\n9/NQ-HĐT") == "9/NQ-HĐT"
    assert number(spark, "48/2020/tt-bgdđt") == "48/2020/tt-bgdđt"
    assert number(spark, "15/NQ-HĐT 11/2015/NĐ-CP") == "11/2015/NĐ-CP"
    assert number(spark, "theo 15/NQ-HĐT") == "15/NQ-HĐT"
    assert number(spark, "QD-DHCNTTTT 12/2021") == "QD-DHCNTTTT"
    assert number(spark, "tel 0912-345-678") == "0912-345-678"
    assert number(spark, "none") == ""


def test_dates(spark):
    inputs = [
        "Hà Nội, ngày 5 tháng 06 năm 2022",
        "ngày 1 tháng 2 năm 2003. Huế, ngày 30 tháng 2 năm 2022",
        "Huế, ngày 30 tháng 2 năm 2022",
        "Hà Nội ngày 7 tháng 8 năm 2019, ngày 9 tháng 8 năm 2020",
        "x, NGÀY 3 THÁNG 4 NĂM 0045", "x, ngày 3 tháng 4 năm 0087", ", ngày 1 tháng 1 năm 2020", "",
    ]
    assert values(spark, X.doc_date_text, inputs) == [
        "2022-06-05", "2003-02-01", "", "2020-08-09", "2045-04-03", "1987-04-03", "2020-01-01", ""]


def test_rules(spark):
    dept = lambda c: R.department(F.lower(c))
    cat = lambda c: R.content_category(F.lower(c))
    inputs = ["thuộc", "SINH VIÊN", "học sinh", "kết quả học tập tín chỉ", "quản lý tài chính", "x"]
    assert values(spark, dept, inputs) == [
        "Training Department", "Training Department", "Student Affairs", "Training Department",
        "Finance", "Training Department"]
    assert values(spark, cat, ["thuộc", "ThS", "quy chế", "x"]) == [
        "finance_and_tuition", "postgraduate_training", "academic_affairs",
        "training_and_regulations"]
    assert values(spark, R.filename_category, ["/a/Quy chế đào tạo.pdf", "Học phí.xls", "b.md"]) == [
        "academic_affairs", "finance_and_tuition", "training_and_regulations"]


def test_source_from_content(spark):
    inputs = ["Căn cứ điều 5", "theo ĐIỀU 12 abc", "điều khoản của khoản 3", "quyết định ban hành",
              "khoản 2", "xem Phụ lục 3", "phụ lục A", "x"]
    assert values(spark, X.source_from_content, inputs) == [
        "Căn cứ", "Điều 12", "", "Quyết định", "", "Phụ lục 3", "", ""]


def test_titles_and_keywords(spark):
    assert values(spark, X.title_keyword, ["một hai  ba bốn năm sáu", "theo Căn cứ x", ""]) == [
        "một hai ba bốn năm", "", ""]
    split = values(spark, X.should_split, ["A và B", "Phạm vi điều chỉnh và B", "vàng", "VÀ"])
    assert split == [True, False, True, False]
    df = spark.createDataFrame([("Điều 3. Tên gọi;\nnội dung của điều này", "Điều 3"),
                                ("**Điều 1.** theo \"Quy định X\"", "Quyết định"),
                                ("ngắn", "Chương 2"), ("1. mục nhỏ thứ nhất đây", "Điều 2, Khoản 1")],
                               "content string, source string")
    titles = [r[0] for r in df.select(X.block_title(F.col("content"), F.col("source"))).collect()]
    assert titles == ["Điều 3. Tên gọi liên quan đến nội dung của điều này",
                      "Quyết định ban hành quy định liên quan đến Quy định X",
                      "Chương 2 liên quan đến Quy định",
                      "Điều 2, Khoản 1 liên quan đến 1. mục nhỏ thứ nhất"]
