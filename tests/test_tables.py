"""Assembly, classification, document table, joins."""
from datetime import datetime

from pyspark.sql import functions as F

from lexloom.functions import fixed_values as fv, rules as R
from lexloom.plans import queries as Q  # noqa: E402
from lexloom.operators import assemble as A, classify as C, lookups as L, store as D
from lexloom.plans import queries as Q

T0, T1, T2 = (datetime(2024, 1, d) for d in (1, 2, 3))


def test_pages_in_order_with_a_hot_document(spark):
    """One document holds most pages; runs split it over several groups."""
    hot = [("hot", i, f"trang {i}") for i in range(2000, 0, -1)]
    pages = spark.createDataFrame(hot + [("b", 2, "hai"), ("b", 1, ""), ("b", 3, " \t"), ("c", 1, None)],
                                  "doc_key string, page_no int, text string").repartition(5)
    got = {r.doc_key: r.text for r in A.assemble_pages(pages, run=64).collect()}
    assert got["hot"] == "\n\n".join(f"## Trang {i}\n\ntrang {i}" for i in range(1, 2001))
    assert got["b"] == "## Trang 2\n\nhai\n\n## Trang 3"
    assert got["c"] == ""
    assert got == {r.doc_key: r.text for r in A.assemble_pages(pages, run=None).collect()}
    skipped = {r.doc_key: r.text for r in A.assemble_pages(pages, skip_blank=True).collect()}
    assert skipped["b"] == "## Trang 2\n\nhai"
    missing = {r.doc_key: tuple(r)[1:] for r in A.missing_pages(pages, run=64).collect()}
    assert missing == {"hot": (2000, 0, []), "b": (3, 1, [1]), "c": (1, 1, [1])}


def test_marks_meet_letters_after_assembly(spark):
    pages = spark.createDataFrame([("a", 1, "a\x00́")], "doc_key string, page_no int, text string")
    assert A.assemble_pages(pages).first().text == "## Trang 1\n\ná"


def test_candidates(spark):
    cands = spark.createDataFrame(
        [("a", 1, 1, " "), ("a", 1, 2, "hai"), ("a", 1, 3, "ba"), ("a", 2, 1, None), ("a", 2, 2, "")],
        "doc_key string, page_no int, rank int, text string")
    got = {r.page_no: (r.rank, r.text, r.status) for r in A.pick_candidate(cands, ["doc_key", "page_no"]).collect()}
    assert got == {1: (2, "hai", "ok"), 2: (None, None, "failed")}
    native = spark.createDataFrame([("a", "x" * 60), ("b", "x"), ("c", "x"), ("d", None)], "doc_key string, text string")
    rec = spark.createDataFrame([("a", "no"), ("b", "rec"), ("c", " ")], "doc_key string, text string")
    got = {r.doc_key: (r.text, r.status) for r in A.choose_text(native, rec).collect()}
    assert got == {"a": ("x" * 60, "native"), "b": ("rec", "recognised"), "c": ("", "failed"), "d": ("", "failed")}


def test_paragraphs(spark):
    paras = spark.createDataFrame([("a", 2, " hai "), ("a", 1, "một"), ("a", 3, "  "), ("b", 1, "")],
                                  "doc_key string, para_no int, text string")
    got = {r.doc_key: (r.text, r.status) for r in A.assemble_paragraphs(paras).collect()}
    assert got == {"a": ("một\n\n hai ", "ok"), "b": ("", "no_content")}


def test_rule_tables_inline_and_by_grams(spark):
    rules = spark.createDataFrame(R.rule_rows("c", fv.CONTENT_CATEGORY_RULES), R.RULE_SCHEMA)
    texts = ["THUỘC về", "thạc sĩ và học phí", "quy chế online", "t", "", None, "ts", "không"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_key int, text string")
    chain = C.classify_documents(df, rules=fv.CONTENT_CATEGORY_RULES, default=fv.DEFAULT_CATEGORY)
    want = {r.doc_key: r.label for r in chain.collect()}
    assert want[0] == "finance_and_tuition" and want[4] == want[5] == fv.DEFAULT_CATEGORY
    for chars in (1_000_000, 300):
        got = C.classify_join(df, rules, fv.DEFAULT_CATEGORY, "doc_key", max_chars=chars)
        assert {r.doc_key: r.label for r in got.collect()} == want
    keys = spark.createDataFrame([(1, "học phí"), (1, "nothing"), (None, "học phí"), (None, None)], "k int, text string")
    got = sorted((repr(r.k), r.label) for r in C.classify_join(keys, rules, "none", "k").collect())
    assert got == [("1", "finance_and_tuition"), ("1", "none"), ("None", "finance_and_tuition"), ("None", "none")]
    empty = C.classify_join(df, rules.limit(0), "none", "doc_key")
    assert {r.label for r in empty.collect()} == {"none"}
    counts = C.label_counts(chain, [x for x, _ in fv.CONTENT_CATEGORY_RULES])
    assert {r.label: r.n_documents for r in counts.collect()}["internship"] == 0


def document(i, at, metadata=None, text="t"):
    return (i, f"{i}.txt", f"/s/{i}", text, metadata, at, at)


def table(spark, *rows):
    return spark.createDataFrame(list(rows), D.DOCUMENT_SCHEMA)


def test_upsert_replaces_whole_rows_and_is_idempotent(spark):
    base = table(spark, document("a", T0, "m"), document("b", T0, "m"))
    batch = table(spark, document("b", T1, text="early"), document("b", T2, text="late"), document("c", T1))
    once = D.upsert_documents(base, batch)
    rows = {r.document_id: (r.text, r.metadata, r.created_at) for r in once.collect()}
    assert rows == {"a": ("t", "m", T0), "b": ("late", None, T2), "c": ("t", None, T1)}
    assert sorted(D.upsert_documents(once, batch).collect()) == sorted(once.collect())
    thin = base.drop("metadata")
    assert D.upsert_documents(thin, batch).columns == thin.columns


def test_update_metadata(spark):
    base = table(spark, document("a", T0, "old"), document("b", T0))
    upd = spark.createDataFrame([("a", None, T1), ("a", "x", T2), ("z", "y", T1)],
                                "document_id string, metadata string, now timestamp")
    got = {r.document_id: (r.metadata, r.created_at, r.updated_at) for r in D.update_metadata(base, upd).collect()}
    assert got == {"a": ("x", T0, T2), "b": (None, T0, T0)}
    cleared = D.update_metadata(base, upd.where("metadata is null"))
    assert {r.document_id: r.metadata for r in cleared.collect()} == {"a": None, "b": None}


def test_list_get_delete_align(spark):
    base = table(spark, document("b", T0), document("a", T0), document("c", T2))
    assert [r.document_id for r in D.list_documents(base).collect()] == ["c", "a", "b"]
    assert D.get_document(base, "a").count() == 1
    ids = spark.createDataFrame([("a",), ("a",), ("q",)], "document_id string")
    left, outcome = D.delete_documents(base, ids)
    assert {r.document_id for r in left.collect()} == {"b", "c"}
    assert {tuple(r) for r in outcome.collect()} == {("a", True, "/s/a"), ("q", False, None)}
    assert D.align_schema(base.drop("metadata")).schema.names == D.DOCUMENT_SCHEMA.names


def test_pending_and_backlog(spark):
    schema = "id string, name string, filepath string, document_id string, markdown string"
    stored = spark.createDataFrame([("a", "A", "/a", "a", None), ("b", "B", None, "b", "")], schema)
    local = spark.createDataFrame([("a", "x", "/x", "a", None), ("t", "y", "/y", None, None), ("a", "z", "/z", "", "m"),
                                   ("n", "w", "/w", "n", None)], schema)
    merged = L.merge_pending(stored, local)
    assert sorted(r.name for r in merged.collect()) == ["A", "B", "w", "y", "z"]
    assert sorted(r.name for r in L.backlog(merged).collect()) == ["A", "w", "y"]
    picked = spark.createDataFrame([("n",), ("n",)], "id string")
    assert [r.name for r in L.backlog(merged, picked).collect()] == ["w"]


def test_requests(spark):
    docs = spark.createDataFrame([("a", "x" * 600), ("b", ""), ("c", None)], "document_id string, text string")
    reqs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "q"), (5, ""), (6, None)], "req_id int, document_id string")
    got = {r.req_id: r.status for r in L.metadata_requests(reqs, docs).collect()}
    assert got == {1: "ok", 2: "no_text", 3: "no_text", 4: "not_found", 5: "missing_id", 6: "missing_id"}
    asks = spark.createDataFrame([(1, "a", "Extract"), (2, "a", "gì?"), (3, "q", "md")], "req_id int, doc_key string, question string")
    got = {r.req_id: r for r in L.answer_requests(asks, docs.withColumnRenamed("document_id", "doc_key")).collect()}
    assert got[1].answer == ("Đã nhận câu hỏi: 'Extract'\n\nNội dung PDF đã được trích xuất sang Markdown:\n\n" + "x" * 600)
    assert got[2].answer.endswith("\n\n" + "x" * 500 + "...")
    assert (got[3].status, got[3].answer, got[3].is_extract) == ("not_found", None, True)


def test_one_document_asked_for_by_most_requests(spark):
    asks = spark.range(20000).select(F.col("id").alias("req_id"), F.when(F.col("id") % 3 > 0, "hot")
                                     .otherwise(F.col("id").cast("string")).alias("doc_key"), F.lit("md").alias("question"))
    docs = spark.createDataFrame([("hot", "x"), ("3", "y")], "doc_key string, text string")
    got = L.answer_requests(asks, docs)
    assert got.count() == 20000 and got.where("status = 'ok'").count() == 13334


def test_generate_metadata(spark):
    base = table(spark, document("a", T0, "m", "Điều 1. Một"), document("b", T0, "keep", " "), document("c", T0, "m"),
                 document("d", T0, "m", None))
    reqs = spark.createDataFrame([("a",), ("a",), ("b",), ("d",), ("q",), ("",), (None,)], "document_id string")
    docs, outcome = L.generate_metadata(reqs, base, "2024-06-01")
    rows = {r.document_id: r for r in docs.collect()}
    assert len(rows) == 4 and rows["a"].metadata.endswith("Điều 1. Một") and rows["a"].updated_at > T2
    assert [(rows[i].metadata, rows[i].updated_at) for i in "bcd"] == [("keep", T0), ("m", T0), ("m", T0)]
    got = sorted((repr(r.document_id), r.status) for r in outcome.collect())
    assert got == [("''", "missing_id"), ("'a'", "ok"), ("'a'", "ok"), ("'b'", "empty"), ("'d'", "no_text"),
                   ("'q'", "not_found"), ("None", "missing_id")]
    every = {r.document_id: r for r in L.rebuild_metadata(base, "2024-06-01").collect()}
    assert every["a"] == rows["a"] and every["b"] == rows["b"] and every["d"] == rows["d"]


def test_generators_may_fail(spark):
    from lexloom.operators import render as M

    def some(batches):
        import pandas as pd
        for batch in batches:
            if batch["title"].str.contains("boom").any():
                raise ValueError("no answer")
            yield pd.DataFrame([(t, k) for t in batch["title"] for k in
                                ({"one": ["k2", "k1", None], "two": [" "]}.get(t, []))], columns=["title", "keyword"])

    titles = ["one", "one", "two", "three is a longer title with words", "", None, "Căn cứ x"]
    df = spark.createDataFrame(list(enumerate(titles)), "id int, title string")
    got = {r.id: r.keyword for r in M.enrich_keywords(df, some).collect()}
    assert got == {0: "k1", 1: "k1", 2: "two", 3: "three is a longer title", 4: "", 5: "", 6: ""}
    boom = spark.createDataFrame([(1, "boom a b c d e")], "id int, title string")
    assert M.enrich_keywords(boom, some).first().keyword == "boom a b c d"


def test_choose_text_reads_all_roles(spark, tmp_path):
    rows = [(1, 0, "system", "s" * 60), (1, 1, "user", "short"), (2, 0, "assistant", "answer"), (3, 0, "user", "short")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(
        str(tmp_path / "conversations.parquet"))
    got = {r.doc_key: (r.text, r.status) for r in Q.choose_text(spark, str(tmp_path)).collect()}
    assert got == {1: ("s" * 60 + "\nshort", "native"), 2: ("answer", "recognised"), 3: ("", "failed")}


def test_rules_with_one_keyword_count_once(spark, monkeypatch):
    """However many rules have a keyword, its text is looked through once."""
    passes = []
    patterns = C._patterns
    monkeypatch.setattr(C, "_patterns", lambda grams: passes.append(grams) or patterns(grams))
    rules = spark.createDataFrame([(i, f"l{i}", "Keyword") for i in range(50, 0, -1)],
                                  "priority int, label string, keyword string")
    texts = spark.createDataFrame([(1, "a keyword"), (2, "none")], "k int, text string")
    got = {r.k: r.label for r in C.classify_join(texts, rules, "none", "k", max_chars=60).collect()}
    assert got == {1: "l1", 2: "none"} and len(passes) == 1


def test_many_rules_cost_one_look(spark, monkeypatch):
    """Thousands of keywords of one length are no longer named in a pattern: every run of the
    text is held against them, at both ends and beside characters of two units."""
    known = []
    patterns = C._patterns
    monkeypatch.setattr(C, "_patterns", lambda grams: known.append(grams) or patterns(grams))
    words = [f"kw{i:07d}" for i in range(13_000)]
    rules = spark.createDataFrame([(i, w, w.upper()) for i, w in enumerate(words, 1)]
                                  + [(0, "long", "một từ khoá dài hơn mười sáu"), (20_000, "short", "ab")],
                                  "priority int, label string, keyword string")
    texts = [f"{words[7]} {words[5]}", f"\U0001f600{words[9]}\U0001f600", "x" * 15 + words[12_999], "kw000000", "ab",
             "một từ khoá dài hơn mười bảy", f"{words[3]} một từ khoá dài hơn mười sáu", "", None, "\U0001f600" * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = {r.k: r.label for r in C.classify_join(df, rules, "none", "k").collect()}
    assert got == {0: words[5], 1: words[9], 2: words[12_999], 3: "none", 4: "short", 5: "none", 6: "long",
                   7: "none", 8: "none", 9: "none"}
    assert len(known) == 1 and sum(map(len, known[0])) < 100
    sliced = C.classify_join(df, rules, "none", "k", max_chars=50_000)
    assert {r.k: r.label for r in sliced.collect()} == got
