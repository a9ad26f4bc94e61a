"""Ordered assembly of pieces (pages, paragraphs, blocks) into one text.

A group may hold a third of all rows. Pieces are first joined within (key, run of
positions), which spreads one large group over many tasks, and only the joined runs
are then brought together by key. Callers whose groups are small by nature may ask
for one step (`run=None`). The text of one document has to fit one row, as it does
in the input of every other operator here.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as fv
from ..functions.text import is_blank, needs_fallback, normalize_text

RUN = 256           # positions joined in the first step


def ordered_text(df: DataFrame, key: str, position: str, text: Column, separator: str,
                 order=None, run: int | None = RUN, name: str = "text") -> DataFrame:
    """One row per key with its texts joined in order; NULL texts are skipped
    and a key with none gives NULL.

    `position` is an integer column that the order starts with; `order` adds
    tie-breakers. `run` is the length of a first-step run, None for one step."""
    ties = [F.col(c) for c in (order or [])]
    entry = F.struct(F.col(position).alias("p"), *[c.alias(f"o{i}") for i, c in enumerate(ties)],
                     F.col("_text").alias("t"))
    rows = df.select(key, position, *(order or []), text.alias("_text"))
    listed = F.collect_list(F.when(F.col("_text").isNotNull(), entry))

    def joined(entries: Column, sep: str) -> Column:
        return F.when(F.size(entries) > 0, F.array_join(
            F.transform(F.array_sort(entries), lambda e: e["t"]), sep))

    if run is None:
        return rows.groupBy(key).agg(joined(listed, separator).alias(name))
    runs = (rows.withColumn("_run", F.floor(F.col(position) / F.lit(run)))
            .groupBy(key, "_run").agg(joined(listed, separator).alias("_part")))
    parts = F.collect_list(F.when(F.col("_part").isNotNull(),
                                  F.struct(F.col("_run").alias("p"), F.col("_part").alias("t"))))
    return runs.groupBy(key).agg(joined(parts, separator).alias(name))


def assemble_pages(pages: DataFrame, key: str = "doc_key", page_no: str = "page_no",
                   text: str = "text", skip_blank: bool = False,
                   run: int | None = RUN) -> DataFrame:
    """Pages in order, each under its page heading, as one normalised text.

    A page counts when its raw text is not empty; with `skip_blank` (the rule
    for recognised text) only when something is left after normalisation.
    Pages are normalised before the shuffle, the joined text once more after it:
    dropping a control character may have left a letter next to its mark."""
    ready = pages.select(key, page_no, (F.length(text) > 0).alias("_has"),
                         normalize_text(F.col(text)).alias("_n"))
    counts = F.col("_has") & ~is_blank(F.col("_n")) if skip_blank else F.col("_has")
    body = F.when(counts, F.concat(F.lit(fv.PAGE_HEADING), F.col(page_no).cast("string"),
                                  F.lit("\n\n"), F.col("_n"), F.lit("\n\n")))
    joined = ordered_text(ready, key, page_no, body, "\n", run=run, name="_joined")
    return joined.select(key, normalize_text(F.col("_joined")).alias("text"))


def missing_pages(pages: DataFrame, key: str = "doc_key", page_no: str = "page_no",
                  text: str = "text", run: int = RUN) -> DataFrame:
    """Per document: number of pages, number of pages without text and their
    sorted numbers."""
    empty = F.coalesce(F.length(text), F.lit(0)) == 0
    runs = (pages.select(key, page_no, empty.alias("_empty"))
            .withColumn("_run", F.floor(F.col(page_no) / F.lit(run)))
            .groupBy(key, "_run")
            .agg(F.count(F.lit(1)).alias("_n"), F.count_if("_empty").alias("_m"),
                 F.sort_array(F.collect_list(F.when(F.col("_empty"), F.col(page_no)))).alias("_l")))
    listed = F.array_sort(F.collect_list(F.struct("_run", "_l")))
    return runs.groupBy(key).agg(
        F.sum("_n").alias("n_pages"), F.sum("_m").alias("n_missing"),
        F.flatten(F.transform(listed, lambda r: r["_l"])).alias("missing_pages"))


def pick_candidate(cands: DataFrame, key, rank: str = "rank", text: str = "text") -> DataFrame:
    """First candidate by rank with text in it, per key; NULL text and status
    `failed` when all are blank. The minimum is combined on the map side."""
    keys = [key] if isinstance(key, str) else list(key)
    usable = F.when(~is_blank(F.coalesce(F.col(text), F.lit(""))), F.struct(
        F.col(rank).alias("rank"), F.col(text).alias("text")))
    best = cands.select(*keys, usable.alias("_u")).groupBy(*keys).agg(F.min("_u").alias("_b"))
    return best.select(*keys, F.col("_b.rank").alias("rank"), F.col("_b.text").alias("text"),
                       F.when(F.col("_b").isNull(), "failed").otherwise("ok").alias("status"))


def choose_text(native: DataFrame, recognised: DataFrame, key: str = "doc_key") -> DataFrame:
    """Native text unless there is too little of it, then recognised text, else
    status `failed` with empty text."""
    rec = recognised.select(key, F.col("text").alias("_rec"))
    both = native.select(key, F.col("text").alias("_nat")).join(rec, key, "left")
    enough = ~needs_fallback(F.col("_nat"))
    has_rec = ~is_blank(F.coalesce("_rec", F.lit("")))
    return both.select(
        key, F.when(enough, F.col("_nat")).when(has_rec, F.col("_rec")).otherwise("").alias("text"),
        F.when(enough, "native").when(has_rec, "recognised").otherwise("failed").alias("status"))


def assemble_paragraphs(paras: DataFrame, key: str = "doc_key", para_no: str = "para_no",
                        text: str = "text", run: int | None = RUN) -> DataFrame:
    """Paragraphs that are not blank, in order, with a blank line between;
    status `no_content` when there are none."""
    kept = F.when(~is_blank(F.col(text)), F.col(text))
    joined = ordered_text(paras, key, para_no, kept, "\n\n", run=run, name="_joined")
    return joined.select(key, F.coalesce("_joined", F.lit("")).alias("text"),
                         F.when(F.col("_joined").isNull(), "no_content").otherwise("ok")
                         .alias("status"))


def block_stats(blocks: DataFrame, key: str = "doc_key") -> DataFrame:
    """Blocks per document by kind; plain counts, combined on the map side."""
    kinds = ["legal_basis", "quyet_dinh", "article", "khoan"]
    return blocks.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_blocks"),
        *[F.count_if(F.col("section_type") == k).alias(f"n_{k}") for k in kinds])
