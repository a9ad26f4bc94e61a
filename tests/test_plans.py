"""Plan shapes: shuffles, scans, joins, Python stages."""
import pytest

from conftest import SF
from lexloom.operators import assemble as A, render as M, segment as S, store as D
from lexloom.functions import text as T
from pyspark.sql import functions as F


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def stored_docs(spark, tmp_path):
    from lexloom.plans.corpus import legal_corpus
    legal_corpus(spark, SF).withColumn("other", F.lit("x")).write.parquet(str(tmp_path / "c"))
    return spark.read.parquet(str(tmp_path / "c"))


@pytest.mark.parametrize("op", [S.split_documents, S.split_articles, S.decision_span, S.article_start,
                                S.document_metadata, M.structure_documents, M.render_blocks,
                                M.document_titles])
def test_document_operators_are_narrow(stored_docs, op):
    text = plan(op(stored_docs))
    assert "Exchange" not in text and "Window" not in text and "Python" not in text
    assert "ReadSchema: struct<doc_key:bigint,text:string>" in text


def test_filter_on_results_does_not_repeat_the_work(stored_docs):
    """A filter stays above the cutting chain and the plan stays small."""
    plain = len(plan(S.split_documents(stored_docs)))
    for column in ("source", "content", "category"):
        filtered = S.split_documents(stored_docs).where(F.col(column) != "")
        assert len(plan(filtered)) < 1.5 * plain
    titled = M.document_titles(stored_docs)
    assert len(plan(titled.where("title <> ''"))) < 1.5 * len(plan(titled))


def test_unused_columns_are_pruned(stored_docs):
    text = plan(A.block_stats(S.split_documents(stored_docs)))
    assert text.count("Exchange") == 1 and "tiến sĩ" not in text


def test_assembly_starts_no_job_and_spreads_large_groups(spark):
    pages = spark.range(10).select(F.lit("a").alias("doc_key"), F.col("id").cast("int").alias("page_no"),
                                   F.raise_error(F.lit("a job ran")).cast("string").alias("text"))
    large = plan(A.assemble_pages(pages))
    assert large.count("Exchange") == 2 and "_run" in large
    one = plan(A.assemble_pages(pages, run=None))
    assert one.count("Exchange") == 1 and "partial_collect_list" in one


def test_newest_versions_are_found_without_the_text(spark, tmp_path):
    spark.createDataFrame([("a", "x", 1)], "document_id string, text string, at int").write.parquet(str(tmp_path / "v"))
    text = plan(D.latest_versions(spark.read.parquet(str(tmp_path / "v")), order=("at",)))
    first = [line for line in text.splitlines() if "partial_max" in line]
    assert first and all("text" not in line for line in first)


def test_headings_cut_no_article(stored_docs):
    text = plan(M.decision_headings(stored_docs))
    assert "Exchange" not in text and S.ARTICLE_STOP not in text
    assert S.ARTICLE_STOP in plan(M.structure_documents(stored_docs))


def test_size_gate_reaches_the_file_source(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    from lexloom.sources import files as FS
    accepted, rejected = FS.accept_files(FS.scan_files(spark, str(tmp_path)))
    assert "LessThanOrEqual(length,16777216)" in plan(accepted)
    assert "content" not in plan(rejected)


def test_versions_are_reduced_before_the_shuffle(spark):
    df = spark.createDataFrame([], D.DOCUMENT_SCHEMA)
    text = plan(D.latest_versions(df))
    assert "partial_max" in text and text.count("Exchange") == 1


def test_point_lookup_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([("a",)], "document_id string").write.parquet(str(tmp_path / "d"))
    text = plan(D.get_document(spark.read.parquet(str(tmp_path / "d")), "a"))
    assert "EqualTo(document_id,a)" in text


def test_composition_sends_only_risky_text_to_python(spark):
    df = spark.createDataFrame([("a",)], "s string").select(T.normalize_text(F.col("s")).alias("t"))
    text = plan(df)
    assert "ArrowEvalPython" in text and "CASE WHEN" in text and "BatchEvalPython" not in text


def test_nothing_is_broadcast_without_a_size_check(spark):
    """One operator asks for a broadcast, of a slice of rules whose characters it has
    counted; for all others the engine decides by size."""
    from pathlib import Path
    root = Path(S.__file__).parents[1]
    sources = {str(p.relative_to(root)): p.read_text() for p in root.rglob("*.py")
               if p.relative_to(root).parts[0] != "llm"}
    assert [n for n, text in sources.items() if "broadcast(" in text] == ["operators/classify.py"]
    assert sources["operators/classify.py"].count("broadcast(") == 1
    assert not any("crossJoin" in text or "localCheckpoint" in text for text in sources.values())


def test_rules_meet_texts_without_a_shuffle_of_texts(spark, tmp_path):
    from lexloom.operators import classify as C
    spark.createDataFrame([(1, "abc")], "k int, text string").write.parquet(str(tmp_path / "t"))
    rules = spark.createDataFrame([(1, "x", "bc")], "priority int, label string, keyword string")
    text = plan(C.classify_join(spark.read.parquet(str(tmp_path / "t")), rules, "none", "k"))
    shuffled = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
    assert "BroadcastHashJoin" in text and "Python" not in text and len(shuffled) == 1
    last = text[text.index("Exchange hashpartitioning"):]
    assert "_low" not in last.splitlines()[1]                # what the shuffle reads: row, key, best rule


def test_rendering_grows_with_the_blocks_only(spark, tmp_path):
    """Work per block must not repeat work per document."""
    import time
    text = "Căn cứ a\n" + "Điều 1. Tên\nnội dung\n" * 20000
    spark.createDataFrame([(1, text)], "doc_key int, text string").write.parquet(str(tmp_path / "t"))
    begin = time.time()
    df = M.structure_documents(spark.read.parquet(str(tmp_path / "t")))
    assert df.select(F.length("metadata")).first()[0] > 20000 * 100
    assert time.time() - begin < 60


def test_computed_tables_are_not_broadcast(spark):
    """Sizes of texts are guessed too small, so joins of computed tables must not go by them."""
    from lexloom.operators import amend as AM
    from lexloom.plans.corpus import amending_corpus
    texts = amending_corpus(spark, SF)
    for op in (AM.blocks_with_amendments, AM.newest_articles, AM.amendment_edges):
        df = op(texts)
        df.collect()
        assert "BroadcastExchange" not in plan(df)


def test_lines_are_shuffled_once_and_without_their_texts(spark):
    """One exchange for the orders, one for the lines."""
    from lexloom.plans.corpus import legal_corpus
    text = plan(legal_corpus(spark, SF))
    assert text.count("Exchange hashpartitioning") == 2
    assert all("_piece" not in line and "_part" not in line for line in text.splitlines() if "Exchange" in line)


def test_a_title_is_found_once_for_its_keyword(stored_docs):
    assert plan(M.decision_headings(stored_docs)).count(r"Điều\s*1[.:]") == 1


def test_searches_make_no_step_at_every_character(stored_docs):
    """Scope, signature and general rules are found by a plain search; a lazy run from the top
    is left for the two looks at the decision line."""
    text = plan(S.article_start(stored_docs))
    assert "(?s)(?dmiuU)\\A(?>.*?" not in text and text.count("[Pp](?iu)hạm") >= 1
    assert plan(S.decision_span(stored_docs)).count("\\A(?>.*?") == 0


def test_lines_are_not_counted_by_replacing(stored_docs):
    """A replacement compares at every byte: only texts with a carriage return or the reserved
    mark meet one."""
    for op in (S.article_start, S.decision_span, S.split_articles):
        text = plan(op(stored_docs))
        assert "octet_length" not in text and "Contains(" in text


def test_line_counts_and_dropped_lines(spark):
    df = spark.createDataFrame([("",), ("a",), ("\n",), ("a\nb\n",), (None,)], "s string")
    got = [tuple(r) for r in df.select(T.line_breaks(F.col("s")), T.drop_lines(F.col("s"), F.lit(1)),
                                       T.drop_lines(F.col("s"), F.lit(0))).collect()]
    assert got == [(0, "", ""), (0, "", "a"), (1, "", "\n"), (2, "b\n", "a\nb\n"), (None, None, None)]
    # The interpreted form, as inside a mapping, counts alike.
    inner = df.select(F.transform(F.array("s"), lambda s: T.drop_lines(s, F.lit(1)))[0])
    assert [r[0] for r in inner.collect()] == ["", "", "", "b\n", None]


def test_titles_of_articles_clean_no_content(stored_docs):
    """Fields of articles that nobody reads are not computed."""
    titles = plan(S.split_articles(stored_docs).select("doc_key", "article_title"))
    assert "Chương[^\\n]*" not in titles and "Chương[^\\n]*" in plan(S.split_articles(stored_docs))


def test_no_article_is_searched_by_itself(stored_docs):
    """Articles are opened and cleaned all at once, in compiled code: what is mapped over them
    holds neither the pattern of a first line nor that of lines left out."""
    for op in (S.split_documents, S.split_articles, M.structure_documents, M.render_blocks):
        text = op(stored_docs)._jdf.queryExecution().optimizedPlan().toString()
        mapped = [part.split("(?dmiuU)")[1][:60] for part in text.split("(lambda ")[1:] if "(?dmiuU)" in part[:60]]
        assert "Điều|Dieu" in text and mapped == []


def test_words_are_looked_for_in_lower_case_first(stored_docs):
    """Most texts lack the unaccented recipients or a signature and are not searched for them in any case."""
    assert "Contains(_low" in plan(S.decision_span(stored_docs)) and "[Nn](?iu)h[aă]n" not in plan(S.decision_span(stored_docs))
    assert "locate(phạm, _low" in plan(S.article_start(stored_docs))
