"""Segmentation: one small text per rule, and random texts against a line-by-line
reading of the rules."""
import random
import re

from pyspark.sql import functions as F

from lexloom.operators import assemble as A, render as M, segment as S

LONG = "nội dung dài " * 60


def rows(df, *cols):
    order = [c for c in ("doc_key", "block_no", "article_no", "part_no", "section_no") if c in df.columns]
    return [tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]]
            for r in df.orderBy(*order).collect()]


def blocks(df, *cols):
    return rows(S.split_documents(df), *(cols or ("source", "content")))


def test_blank_documents_have_no_blocks(docs):
    assert blocks(docs("", " \n\t ", None)) == []


def test_basis_until_decision(docs):
    df = docs("x\nCăn cứ *A*  \n\n tiếp\nTheo  đề nghị B\nQuyết  định :\nCăn cứ C",
              "Căn cứ A\nhết", "QUYẾT ĐỊNH:\nCăn cứ A", "theo ĐỀ NGHỊ x Căn cứ\u2028y quyết định: z")
    got = {r.doc_key: r.content for r in S.legal_basis_blocks(df).collect()}
    assert got == {1: "Căn cứ A\n\n tiếp\nTheo  đề nghị B", 2: "Căn cứ A\nhết",
                   4: "theo ĐỀ NGHỊ x Căn cứ"}


def test_decision_block_forms(docs):
    df = docs("a **QUYẾT ĐỊNH:**\n# Điều 1\n*x*\nNơi nhận: b", "QUYẾT ĐỊNH: y\nhết",
              "## QUYẾT ĐỊNH: z", "QUYẾT ĐỊNH: đầu\n**Quyết định:** sau\nNơi  nhận :",
              "**\nQuyết\nđịnh: qua dòng")
    got = {r.doc_key: r.content for r in S.decision_blocks(df).collect()}
    assert got == {1: "QUYẾT ĐỊNH:\nĐiều 1\nx", 2: "QUYẾT ĐỊNH: y\nhết",
                   4: "Quyết định: sau", 5: "Quyết\nđịnh: qua dòng"}


def test_decision_span_ends(docs):
    df = docs(
        "a\nQUYẾT ĐỊNH:\nb\nNơi nhận: c\nĐiều 1. d",       # accented recipients do not end it
        "a\nQUYẾT ĐỊNH:\nĐiều 1\nNoi nhan: c\nd",           # plain ones do
        "Quyết định này là câu thường\nb\nhết",             # a sentence starts a span
        "a\n\n## **Quyết định**\nb\nHIỆU TRƯỞNG\nc",        # signature
        "QUYẾT ĐỊNH\n\nĐiều 1. nối\nb\nĐiều 2. c",          # no colon: runs on over blank lines
        "không có")
    got = {r.doc_key: (r.span_start, r.span_end) for r in S.decision_span(df).collect()}
    assert got == {1: (1, 3), 2: (1, 2), 3: (0, 1), 4: (2, 3), 5: (0, 3)}


def test_article_start_rules(docs):
    tail = "Nơi nhận:\nx\n(Ký tên)\nA\nB\n"
    df = docs(
        "Điều 1. Phạm vi điều chỉnh", "Điều 1\n2\n3\nPhạm vi điều chỉnh",
        "Điều 1\n2\n3\n4\n5\n6\n phạm  VI điều chỉnh", tail + "*** r\nC\n## QUY ĐỊNH a\nD",
        tail + "*** r\nC\nD", tail + "C", "Nơi nhận:\nx\nNHỮNG QUY ĐỊNH CHUNG\n## QUY ĐỊNH",
        "a\n ## QUY  ĐỊNH b\nc", "a\nb",
        "Ký và đóng dấu\nNơi nhận: Ký, đóng dấu\nx Ký và đóng  dấu\n",
        "Điều 12. x\ny\nPhạm vi điều chỉnh")
    got = [r.start_line for r in S.article_start(df).orderBy("doc_key").collect()]
    assert got == [0, 0, 6, 8, 7, 5, 3, 2, 0, 5, 0]


def test_article_heading_forms(docs):
    text = ("**Điều 1 — Tên một** thêm\nA\n**Điều 2. Tên hai\nB\n  Điều 3 . Tên ba  \n## Điều 4\n"
            "C\n**Điều 5.** sau\nDieu 6 trong")
    arts = rows(S.split_articles(docs(text)), "article_num", "article_title", "content")
    assert arts == [("1", "Tên một", "**Điều 1 — Tên một** thêm\nA"),
                    ("2", "Tên hai", "**Điều 2. Tên hai\nB"),
                    ("3", "Tên ba", "  Điều 3 . Tên ba  \nC"),
                    ("5", "", "**Điều 5.** sau\nDieu 6 trong")]


def test_article_cleaning_and_stops(docs):
    text = ("Dieu 9 đầu\nĐiều 1. A\nChương II\nQUY ĐỊNH CHUNG VỀ CÁC VIỆC\nCHỮ HOA NGẮN\nTên chương\n"
            "**Chương III x**\nxem # Chương 4\n=====\n---\n____\n_____\ncòn\n\nPhụ lục 1\nbỏ\n"
            "Điều 2. B # Chương 5\nb\nNơi nhận\nbỏ\nDieu 3 mở\nc\nDieu 4 trong")
    assert rows(S.split_articles(docs(text)), "article_num", "content") == [
        ("9", "Dieu 9 đầu"), ("1", "Điều 1. A\nCHỮ HOA NGẮN\nTên chương\n____\ncòn\n"),
        ("2", "Điều 2. B # Chương 5\nb"), ("3", "Dieu 3 mở\nc\nDieu 4 trong")]


def test_decision_articles_are_kept_unless_before_start(docs):
    head = "QUYẾT ĐỊNH:\nĐiều 1. Ban hành\nNơi nhận:\n"
    df = docs(head + "Điều 1. Phạm vi điều chỉnh", head + "a\nb\nc\nd\ne\nĐiều 1. Phạm vi điều chỉnh")
    got = [(r.doc_key, r.source, r.content) for r in S.split_documents(df).orderBy("doc_key", "block_no").collect()
           if r.section_type == "article"]
    assert got == [(1, "Điều 1", "Điều 1. Ban hành"), (1, "Điều 1", "Điều 1. Phạm vi điều chỉnh"),
                   (2, "Điều 1", "Điều 1. Phạm vi điều chỉnh")]


def test_clause_threshold(docs):
    head = "Điều 1. Quyền và nghĩa vụ\nmở đầu\n1. một\n2. hai\n"
    exact = head + "x" * (600 - len(head))
    df = docs(exact, exact[:-1], exact.replace("\n1. ", "\na. ").replace("\n2. ", "\nb. "),
              exact.replace("Quyền và nghĩa vụ", "Phạm vi điều chỉnh và b"))
    got = [(r.doc_key, r.source) for r in S.split_documents(df).orderBy("doc_key", "block_no").collect()]
    assert got == [(1, "Điều 1, Khoản 1"), (1, "Điều 1, Khoản 2"), (2, "Điều 1"), (3, "Điều 1"),
                   (4, "Điều 1")]


def test_clause_text(docs):
    text = f"Điều 7. A và B\nbỏ\n\n 1. một\nthêm\n2.\n3. ba\n4.x\n10. {LONG}"
    parts = rows(S.split_clauses(S.split_articles(docs(text))), "khoan_num", "content")
    assert parts == [("1", "1. một\nthêm"), ("2", "2.\n3. ba\n4.x"), ("10", f"10. {LONG}".strip())]


def test_line_ends_and_reserved_mark(docs):
    df = docs("Điều 1. A\r\nx\ry\ufdd0z")
    assert blocks(df) == [("Điều 1", "Điều 1. A\nx\ny\ufffdz")]


def test_sections_by_kind(docs):
    df = docs("a\nPhụ lục 1\nb\nPhụ lục 2\nc\n**Điều 1**\nd\n**Phụ lục 3**\ne\nNơi nhận\nf",
              "Chương I\na\nĐiều 1\n**Chương II**\nb\n* Nơi nhận x")
    assert rows(S.split_sections(df, "phu_luc"), "content") == [
        "Phụ lục 1\nb\nPhụ lục 2\nc", "**Phụ lục 3**\ne"]
    assert rows(S.split_sections(df, "chuong"), "content") == [
        "Chương I\na\nĐiều 1", "**Chương II**\nb"]


def test_decision_variants(docs):
    df = docs("x\nQuyết định:\nĐiều 1\nNoi nhan : a\nb", "QUYẾT ĐỊNH\na\nTheo luật\nb", "QUYẾT ĐỊNH\nb\n \n")
    got = {r.doc_key: (r.span_start, r.end_line, r.content) for r in S.decision_to_recipients(df).collect()}
    assert got == {1: (1, 2, "Quyết định:\nĐiều 1"), 2: (0, 3, "QUYẾT ĐỊNH\na\nTheo luật\nb"),
                   3: (0, 3, "QUYẾT ĐỊNH\nb")}
    got = {r.doc_key: r.content for r in S.decision_to_first_article(df).collect()}
    assert got == {1: "Quyết định:", 2: "QUYẾT ĐỊNH\na", 3: "QUYẾT ĐỊNH\nb\n \n"}


# --- a second reading of the article rules, line by line ----------------------

LINES = ["Điều 1. Phạm vi điều chỉnh", "**Điều 2. A và B**", "  Điều 3", "Dieu 4. d", "## Điều 5",
         "Chương II", "**Chương III**", "CÁC QUY ĐỊNH CHUNG VỀ VIỆC HỌC", "Phụ lục 1", "Nơi nhận",
         "Noi nhan: x", "Nơi nhận: y", "QUYẾT ĐỊNH:", "**QUYẾT ĐỊNH:**", "Quyết định", "", " ", "văn bản",
         "1. mục", "-----", "x # Chương 3", "Điều 6 # Chương 7", "(Ký tên)", "*** z", "## QUY ĐỊNH",
         "NHỮNG QUY ĐỊNH CHUNG", "HIỆU TRƯỞNG", "Căn cứ luật"]


def kind_of(line):
    s = line.strip()
    flags = re.I
    noise = bool(re.match(r"#|\*\*chương|chương\s+[ivxlc\d]|_{5,}$|=+$|-+$", s, flags)
                 or (len(s) > 20 and s == s.upper() and not re.search(r"\d|[^\w\s,.;:!?]|_", s)))
    return {"open": bool(re.match(r"(\*\*)?(điều|dieu)\s+\d", s, flags)),
            "skip": noise or bool(re.search(r"#\s*chương", s, flags)), "noise": noise,
            "stop": bool(re.match(r"(\*\*)?(điều|phụ\s+lục)\s+\d|nơi\s+nhận", s, flags))}


def expected_articles(text, first):
    found, current = [], None
    for line in text.split("\n")[first:]:
        k = kind_of(line)
        if current is not None:
            caps = k["noise"] and not re.match(r"#|\*\*chương|chương|[-_=]", line.strip(), re.I)
            if k["stop"] and not (k["skip"] and not caps):
                current = None
            elif not k["skip"]:
                current.append(line)
        if current is None and k["open"]:
            current = [line]
            found.append(current)
    return ["\n".join(a) for a in found]


def test_random_texts_against_lines(docs):
    rng = random.Random(11)
    texts = ["\n".join(rng.choice(LINES) for _ in range(rng.randint(1, 30))) for _ in range(400)]
    df = docs(*texts)
    start = {r.doc_key: r.start_line for r in S.article_start(df).collect()}
    end = {r.doc_key: r.span_end for r in S.decision_span(df).collect()}
    got = {}
    for r in S.split_articles(df).orderBy("doc_key", "article_no").collect():
        got.setdefault(r.doc_key, []).append(r.content)
    for i, text in enumerate(texts, 1):
        first = max(start[i], end.get(i, -1) + 1)
        assert got.get(i, []) == expected_articles(text, first), text


def test_block_numbers_are_dense_and_partitioning_does_not_matter(docs):
    rng = random.Random(5)
    df = docs(*["\n".join(rng.choice(LINES) for _ in range(25)) for _ in range(200)])
    one = sorted(map(tuple, S.split_documents(df.coalesce(1)).collect()))
    many = sorted(map(tuple, S.split_documents(df.repartition(7)).collect()))
    assert one == many
    numbers = {}
    for r in one:
        numbers.setdefault(r[0], []).append(r[1])
    assert all(v == list(range(1, len(v) + 1)) for v in numbers.values())


# --- rendering ----------------------------------------------------------------

def test_titles(docs):
    df = docs('Căn cứ A\n**QUYẾT ĐỊNH:**\nĐiều 1. theo " Quy chế X "\n',
              "Căn cứ A\nĐơn vị đào tạo nghề\nQUYẾT ĐỊNH:\nĐiều 1. theo “Quy chế X”\n",
              "Điều 1. A\nngắn", "")
    assert rows(M.document_titles(df), "title") == ["Quy chế X", "Đơn vị đào tạo nghề", "", ""]


def test_markdown_of_a_document(docs):
    text = ('Số: 1/QĐ-A\nHN, ngày 2 tháng 3 năm 2020\nCăn cứ luật\nQUYẾT ĐỊNH:\nĐiều 1. về "Quy chế"\n'
            "Nơi nhận:\n**Điều 2. B**\nb")
    head = ("## Metadata\n- **doc_id:** 1/QĐ-A\n- **department:** Training Department\n"
            "- **type_data:** markdown\n- **category:** {}\n- **date:** 2020-03-02\n- **source:** {}\n\n"
            "## Nội dung\n\n")
    plain, quy_che = "training_and_regulations", "academic_affairs"
    want = (head.format(plain, "Căn cứ") + "Các căn cứ pháp lý để ban hành quy định liên quan đến Quy chế\n\n"
            "Căn cứ luật\n" + "\n\n---\n\n" + head.format(quy_che, "Quyết định")
            + "QUYẾT ĐỊNH ban hành các quy định liên quan đến Quy chế\n\nQUYẾT ĐỊNH:\nĐiều 1. về \"Quy chế\"\n"
            + "\n\n\n---\n\n" + head.format(quy_che, "Điều 1") + 'Điều 1. về "Quy chế"'
            + "\n\n\n---\n\n" + head.format(plain, "Điều 2") + "Điều 2. B\nb")
    df = docs(text, "không có gì")
    assert rows(M.structure_documents(df), "metadata") == [want, ""]


def test_generator_runs_once_per_title(spark):
    titles = spark.createDataFrame([(i, t) for i, t in enumerate(["a b", "a b", "Căn cứ", "", "c"])],
                                   "doc_key int, title string")

    def count_titles(batches):
        for b in batches:
            assert b["title"].is_unique
            yield b.assign(keyword=b["title"].str.upper())

    got = M.enrich_keywords(titles, count_titles).orderBy("doc_key").collect()
    assert [r.keyword for r in got] == ["A B", "A B", "", "", "C"]


def test_block_stats(docs):
    df = docs("Căn cứ a\nQUYẾT ĐỊNH:\nx\nĐiều 1. y")
    assert rows(A.block_stats(S.split_documents(df)), "n_blocks", "n_legal_basis", "n_quyet_dinh",
                "n_article", "n_khoan") == [(3, 1, 1, 1, 0)]


def test_labels_of_other_section_types(spark):
    df = spark.createDataFrame(
        [("point", "3", "2", "", "a", "", ""), ("point", "3", "2", "9", "b", "", ""),
         ("khoan_number_clause", "3", "2", "", "", "Khoản 3 của Điều 8", ""),
         ("khoan_number_clause", "3", "2", "", "", "", ""), ("quy_trinh_article", "3", "", "", "", "", ""),
         ("chuong", "", "", "", "", "Chương II", ""), ("chuong", "", "", "", "", "", "điều 4"), ("x", "", "", "", "", "", "")],
        "section_type string, article_num string, khoan_num string, clause_num string, point_letter string,"
        " named_source string, content string")
    assert [r.source for r in S.label_sections(df).collect()] == [
        "Điều 3, Khoản 2, Điểm a", "Điều 3, Khoản 9, Điểm b", "Điều 8, Khoản 3", "Điều 3, Khoản 2", "Điều 3",
        "Chương II", "Điều 4", "Unknown"]


def test_no_basis_where_a_name_is_quoted(spark, docs):
    texts = ['Căn cứ Luật số 1;\nQUYẾT ĐỊNH:\nĐiều 1. Ban hành "Quy định A".', 'Căn cứ Luật số 1 của Quốc hội;\nQUYẾT ĐỊNH:\nĐiều 1. B.',
             'QUYẾT ĐỊNH:\nĐiều 1. Ban hành "  ".', "Điều 1. Một tiêu đề dài\nx", ""]
    titles = {r.doc_key: r.title for r in M.document_titles(docs(*texts)).collect()}
    blocks = {r.doc_key: r.title for r in S.with_blocks(docs(*texts)).select(
        "doc_key", M.document_title(F.col("blocks")).alias("title")).collect()}
    assert titles == blocks and titles[1] == "Quy định A"
    # The text is gone before the basis of a document with a name is looked for.
    seen = S.with_front_blocks(docs(*texts), unless=M._named).where("doc_key = 1").first()
    assert seen.first == seen.decision and not seen.first.startswith("Căn cứ")


def test_recipients_are_cut_from_one_match(spark, docs):
    texts = ["a\nb\n\nQUYẾT ĐỊNH:\nĐiều 1. X\n  nơi nhận :\ny", "QUYẾT ĐỊNH\n\n", "a\n## QUYẾT ĐỊNH:", "không có", "\n\n**quyết định:**\nx \n\n"]
    found = S.decision_to_recipients(docs(*texts))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "slice(" not in plan and "array_join" not in plan
    spans = {r.doc_key: r.span_start for r in S.decision_span(docs(*texts)).collect()}
    rows = {r.doc_key: r for r in found.collect()}
    assert {k: r.span_start for k, r in rows.items()} == spans
    for k, r in rows.items():
        lines = texts[k - 1].split("\n")
        assert r.content == "\n".join(lines[r.span_start:r.end_line + 1]).rstrip()


def test_words_whose_lower_case_is_longer_or_has_a_third_form(docs):
    """Dotted capital I becomes two letters and long s stays: places and words are found all the same."""
    df = docs("İİİ\nx\nPHẠM VI điều chỉnh", "İ\nQUYẾT ĐỊNH:\nNOI NHAN: x\ny", "nơı nhận:\nx\n(\u212aý tên)\na\nb\nc",
              "\U0001f600\n\U0001f600 phạm phạm vi điều chỉnh")
    assert [r.start_line for r in S.article_start(df).orderBy("doc_key").collect()] == [2, 0, 5, 1]
    assert {r.doc_key: r.span_end for r in S.decision_span(df).collect()} == {2: 1}


def test_impossible_dates_raise_nothing(docs):
    df = docs("HN, ngày 31 tháng 2 năm 2020\nngày 1 tháng 3 năm 0049", "ngày 29 tháng 2 năm 2023", "ngày 9 tháng 9 năm 0050",
              "a, ngày 5 tháng 13 năm 2020", "số 1234/567 và 89/QĐ-AB")
    got = [(r.date, r.doc_id) for r in S.document_metadata(df).orderBy("doc_key").collect()]
    assert got == [("", ""), ("", ""), ("1950-09-09", ""), ("", ""), ("", "89/QĐ-AB")]
