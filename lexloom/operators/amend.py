"""Amendments: which article a citation changes, and what its newest version is.

Citations are read from the articles of a text, in its row. They meet the documents by
number and the articles by number and article, in equi-joins of short rows; a number
that many documents cite is reduced to one row on its side of the join. Every article
then points to the article that changed it last, and chains of such pointers are
followed by doubling: a round joins the open pointers with all pointers and halves
what is left of every chain, so chains of length n take log n rounds, each of them
stored. What does not come to an end runs in a circle.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialize, shuffled
from .outline import outline
from .segment import document_metadata, explode_rows

_S = r"[ \t]"
# --- Fixed values: how a text says that it changes another ---------------------
ACTIONS = {"replace": rf"thay{_S}+thế", "repeal": rf"bãi{_S}+bỏ", "add": rf"bổ{_S}+sung",
           "amend": rf"sửa{_S}+đổi(?:,?{_S}*bổ{_S}+sung)?"}
PLACE = rf"(?:{_S}+Điểm{_S}+([a-zđ]),?)?(?:{_S}+Khoản{_S}+(\d+),?)?(?:{_S}+Điều{_S}+(\d+))?"
DOCUMENT = (rf"(?:{_S}+(?:của|tại))?{_S}+(?:Quyết{_S}+định|Thông{_S}+tư|Nghị{_S}+định|Nghị{_S}+quyết|Quy{_S}+định"
            rf"|Quy{_S}+chế){_S}+(?:số{_S}*:?{_S}*)?(\d[\p{{L}}\p{{N}}/–&.\-]*[\p{{L}}\p{{N}}])")
CITATION = rf"(?iuU)\b({'|'.join(ACTIONS.values())}){PLACE}{DOCUMENT}"


def citations(df: DataFrame, key: str = "doc_key", text: str = "text") -> DataFrame:
    """(key, node, article, citation_no, action, target_number, target_article, target_clause,
    target_point), one row for each citation in an article, in the order of the text.
    Action is `amend`, `add`, `replace` or `repeal`; places that are not given are empty.
    No shuffle."""
    return _citations(outline(df, key, text), key)


def _citations(nodes: DataFrame, key: str) -> DataFrame:
    nodes = nodes.where("article_num is not null")
    rows = explode_rows(nodes, F.regexp_extract_all("content", F.lit(CITATION), F.lit(0)), key, "node", "article_num")
    part = lambda i: F.regexp_extract("_e", CITATION, i)
    verb = F.lower(part(1))
    action = F.lit("amend")
    for name in ("add", "repeal", "replace"):
        action = F.when(F.rlike(verb, F.lit(rf"\A(?:{ACTIONS[name]})")), name).otherwise(action)
    return rows.select(key, "node", F.col("article_num").alias("article"), F.col("_pos").alias("citation_no"),
                       action.alias("action"), part(5).alias("target_number"), part(4).alias("target_article"),
                       part(3).alias("target_clause"), part(2).alias("target_point"))


def articles(df: DataFrame, key: str = "doc_key", text: str = "text") -> DataFrame:
    """(key, article): the numbers of a document's articles, each once."""
    return _articles(outline(df, key, text), key)


def _articles(nodes: DataFrame, key: str) -> DataFrame:
    return nodes.where("kind = 'article'").select(key, F.col("number").alias("article")).distinct()


def _nodes(df: DataFrame, key: str, text: str) -> DataFrame:
    """The outline, cut once and stored, since several steps read it."""
    return materialize(outline(df, key, text).where("article_num is not null")
                       .select(key, "node", "kind", "number", "article_num", "source", "content"))


def amendment_edges(df: DataFrame, key: str = "doc_key", text: str = "text") -> DataFrame:
    """The citations with `number` and `date` of the citing document, the cited document
    as `target` and a status: `ok`, `whole_document` (no article given), `self`,
    `unknown_document`, `ambiguous` (several documents have the number) or
    `unknown_article`."""
    return _edges(df, _nodes(df, key, text), key, text)


def _edges(df: DataFrame, nodes: DataFrame, key: str, text: str) -> DataFrame:
    docs = document_metadata(df, key, text).select(key, F.col("doc_id").alias("number"), "date")
    known = (docs.where("number <> ''").groupBy(F.col("number").alias("target_number"))
             .agg(F.min(key).alias("target"), F.count(F.lit(1)).alias("_n")))
    there = _articles(nodes, key).select(F.col(key).alias("target"), F.col("article").alias("target_article"),
                                           F.lit(True).alias("_there"))
    rows = (_citations(nodes, key).join(shuffled(docs), key).join(shuffled(known), "target_number", "left")
            .join(shuffled(there), ["target", "target_article"], "left"))
    status = (F.when(F.col("_n").isNull(), "unknown_document").when(F.col("_n") > 1, "ambiguous")
              .when(F.col("target") == F.col(key), "self").when(F.col("target_article") == "", "whole_document")
              .when(F.col("_there").isNull(), "unknown_article").otherwise("ok"))
    target = F.when(F.col("_n") == 1, F.col("target"))
    return rows.select(key, "number", "date", "node", "article", "citation_no", "action", "target_number",
                       target.alias("target"), "target_article", "target_clause", "target_point",
                       status.alias("status"))


def newest_articles(df: DataFrame, key: str = "doc_key", text: str = "text") -> DataFrame:
    """(key, article, newest, newest_article, hops, status) of every article.

    Of the documents that change an article the latest counts, by date, then key, then
    place; an addition, change or replacement points to the article that makes it, and a
    repeal ends the chain. Status is `current` (never changed), `amended`, `repealed` or
    `cycle`; of a circle there is no newest article."""
    nodes = _nodes(df, key, text)
    edges = materialize(_edges(df, nodes, key, text).where("status = 'ok'"))
    last = F.max_by(F.struct(F.col(key).alias("to"), F.col("article").alias("to_article"), "action"),
                    F.struct("date", key, "node", "citation_no"))
    last = materialize(edges.groupBy(F.col("target").alias("of"), F.col("target_article").alias("of_article"))
                       .agg(last.alias("_l")).select("of", "of_article", "_l.*"))
    ended = last.where("action = 'repeal'").select(F.col("of").alias("e"), F.col("of_article").alias("e_article"))
    ways = follow(last.where("action <> 'repeal'").select("of", "of_article", "to", "to_article"))
    rows = (_articles(nodes, key).join(shuffled(ways), (F.col(key) == F.col("of")) & (F.col("article") == F.col("of_article")),
                                "left"))
    newest, article = F.coalesce("to", key), F.coalesce("to_article", "article")
    rows = rows.select(key, "article", newest.alias("newest"), article.alias("newest_article"),
                       F.coalesce("hops", F.lit(0)).alias("hops"), F.coalesce("cycle", F.lit(False)).alias("cycle"))
    rows = rows.join(shuffled(ended), (F.col("newest") == F.col("e")) & (F.col("newest_article") == F.col("e_article")), "left")
    status = (F.when(F.col("cycle"), "cycle").when(F.col("e").isNotNull(), "repealed")
              .when(F.col("hops") > 0, "amended").otherwise("current"))
    known = lambda c: F.when(~F.col("cycle"), F.col(c)).alias(c)
    return rows.select(key, "article", known("newest"), known("newest_article"), known("hops"), status.alias("status"))


def follow(pointers: DataFrame) -> DataFrame:
    """(of, of_article, to, to_article, hops, cycle): the ends of chains of pointers (of,
    of_article) -> (to, to_article), of which a pair has one at most.

    After round n an open chain has more than 2 ** n steps left. Chains that are longer
    still have shorter ones within them, so once a round ends no chain, all that are
    open run in circles."""
    keys = ["of", "of_article"]
    every = materialize(pointers.withColumn("hops", F.lit(1)))
    done, open_, n_open = None, every, every.count()
    while True:
        step = every.select(F.col("of").alias("_o"), F.col("of_article").alias("_a"), F.col("to").alias("_to"),
                            F.col("to_article").alias("_to_article"), F.col("hops").alias("_hops"))
        met = open_.join(shuffled(step), (F.col("to") == F.col("_o")) & (F.col("to_article") == F.col("_a")), "left")
        met = materialize(met)
        ended = met.where("_o is null").select(*every.columns)
        done = ended if done is None else done.unionByName(ended)
        open_ = met.where("_o is not null").select(
            *keys, F.col("_to").alias("to"), F.col("_to_article").alias("to_article"),
            (F.col("hops") + F.col("_hops")).alias("hops"))
        left = open_.count()
        if left in (0, n_open):
            break
        n_open, every = left, materialize(done.unionByName(open_))
    return (done.withColumn("cycle", F.lit(False)).unionByName(
        open_.withColumn("cycle", F.lit(True))))


def blocks_with_amendments(df: DataFrame, key: str = "doc_key", text: str = "text") -> DataFrame:
    """(key, node, json): the articles as JSON blocks whose metadata say what they change
    (`modify`: article and number of the changed ones, `partial_mod`: whether clauses or
    points alone) and who changed them (`amend`: numbers, by date)."""
    nodes = _nodes(df, key, text)
    edges = materialize(_edges(df, nodes, key, text))
    place = F.when(F.col("target_article") == "", F.col("target_number")).otherwise(
        F.concat(F.lit("Điều "), "target_article", F.lit(" "), "target_number"))
    made = (edges.groupBy(F.col(key).alias("_k"), F.col("article").alias("_a")).agg(
        F.array_join(F.array_sort(F.collect_set(place)), "; ").alias("modify"),
        F.bool_and((F.col("target_clause") != "") | (F.col("target_point") != "")).alias("partial_mod")))
    had = (edges.where("status = 'ok'").groupBy(F.col("target").alias("_t"), F.col("target_article").alias("_ta")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("date", "number"))), lambda x: x["number"]), "; ")
        .alias("amend")))
    docs = document_metadata(df, key, text)
    blocks = nodes.where("kind = 'article'").select(key, "node", "number", "source", "content")
    rows = (blocks.join(shuffled(docs), key)
            .join(shuffled(made), (F.col(key) == F.col("_k")) & (F.col("number") == F.col("_a")), "left")
            .join(shuffled(had), (F.col(key) == F.col("_t")) & (F.col("number") == F.col("_ta")), "left"))
    metadata = F.struct(
        "doc_id", "source", "date", F.coalesce("modify", F.lit("")).alias("modify"),
        F.coalesce("partial_mod", F.lit(False)).alias("partial_mod"), F.lit("markdown").alias("data_type"),
        F.coalesce("amend", F.lit("")).alias("amend"))
    return rows.select(key, "node", F.to_json(F.struct(metadata.alias("metadata"), "content")).alias("json"))
