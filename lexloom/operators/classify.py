"""Keyword classification of tables, with fixed rules or rules given as data."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed_values as fv, rules as R
from ..session import materialize, shuffled

#: Characters of keywords that are broadcast at once.
MAX_RULE_CHARS = 4_000_000
#: Characters of the longest grams under which keywords are filed.
GRAM = 16
#: Characters of grams of one length that a pattern names; of more, all runs of that length are taken.
PATTERN_CHARS = 2_000
#: Runs of a text that are cut from one piece of it. A cut counts the characters before it.
PIECE = 16


def classify_documents(df: DataFrame, text: str = "text", rules=None, default=None,
                       name: str = "label") -> DataFrame:
    """Add the label of the first matching rule (department rules unless given)."""
    rules = fv.DEPARTMENT_RULES if rules is None else rules
    default = fv.DEFAULT_DEPARTMENT if default is None else default
    low = df.withColumn("_low", F.lower(F.coalesce(F.col(text), F.lit(""))))
    return low.withColumn(name, R.first_label(F.col("_low"), rules, default)).drop("_low")


def classify_join(df: DataFrame, rules_df: DataFrame, default: str, key: str,
                  text: str = "text", name: str = "label",
                  max_chars: int = MAX_RULE_CHARS) -> DataFrame:
    """(key, label), one row per row, with rules (priority, label, keyword) given as a
    table: the contained keyword of least priority decides, then label, then keyword.

    A keyword can only be in a text that holds each of its grams (runs of 16 characters,
    or the keyword itself if it is shorter), so every rule is filed under the gram that it
    shares with the fewest other rules. The grams of a text meet the rules in an equi-join
    inside the task, keywords longer than their gram are looked for in the text, and the
    least rule of each row is a partial minimum of its rank: texts are never shuffled, rows
    without a rule stay, and keys may repeat or be NULL. Grams of a length that few rules
    have are found by a pattern that names them; of other lengths all runs of the text are
    taken, so a look costs the same however many rules there are.

    Of rules with the same keyword only the least is kept. They are broadcast in slices of
    about `max_chars` characters (or one rule), whose number follows the total length of
    the different keywords; each slice is one more look at the text."""
    given = rules_df.select("priority", "label", F.lower("keyword").alias("keyword")).where(
        "priority is not null and label is not null and length(keyword) > 0")
    # Of rules with one keyword the least decides alone, so their number follows the words and not the rules.
    wanted = given.groupBy("keyword").agg(F.min(F.struct("priority", "label")).alias("_r")).select(
        "_r.priority", "_r.label", "keyword")
    starts = F.sequence(F.lit(1), F.greatest(F.length("keyword") - GRAM + 1, F.lit(1)))
    grams = wanted.withColumn("_gram", F.explode(F.transform(starts, lambda i: F.substring("keyword", i, GRAM))))
    shared = grams.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    filed = (grams.join(shuffled(shared), "_gram").groupBy("priority", "label", "keyword")
             .agg(F.min_by("_gram", F.struct("_n", "_gram")).alias("_gram")))
    # Increasing numbers of sorted rows are ranks, which are compared and kept more cheaply than rules.
    rules = materialize(filed.orderBy("priority", "label", "keyword").select(
        F.monotonically_increasing_id().alias("_rank"), "label", "keyword", "_gram"))
    chars = rules.agg(F.sum(F.length("keyword").cast("long"))).first()[0] or 0
    n = max(1, -(-chars // max(1, max_chars)))
    rows = df.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_key"),
                     F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_low"))
    rows = materialize(rows) if n > 1 else rows                             # one numbering for all slices
    best = None
    for i in range(n):
        own = rules.where(F.pmod(F.xxhash64("keyword"), F.lit(n)) == i)
        grams = _spread(rows, own)
        hit = ((F.xxhash64("_g") == F.col("_hash")) & (F.col("_g") == F.col("_gram"))
               & ((F.length("keyword") <= GRAM) | F.contains("_low", "keyword")))
        filed = own.select("_rank", "keyword", "_gram", F.xxhash64("_gram").alias("_hash"))
        # One row without a gram stays for each text, whether it meets a rule or not.
        least = (grams.join(_sent(filed), hit, "left").where("_g is null or _rank is not null")
                 .groupBy("_row", "_key").agg(F.min("_rank").alias("_rank")))
        found = least.join(_sent(own.select(F.col("_rank").alias("_own"), "label")),
                           F.col("_rank") == F.col("_own"), "left").select("_row", "_key", "_rank", "label")
        best = found if best is None else best.unionByName(found)
    if n > 1:
        best = best.groupBy("_row", "_key").agg(F.min(F.when(
            F.col("_rank").isNotNull(), F.struct("_rank", "label"))).alias("_b")).select("_key", "_b.label")
    return best.select(F.col("_key").alias(key), F.coalesce("label", F.lit(default)).alias(name))


def _sent(rules: DataFrame) -> DataFrame:
    """A slice of rules, whose characters were counted, for every task."""
    return F.broadcast(rules)


def _spread(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """The rows with each gram of their texts that some rules may be filed under as `_g`, and
    once with NULL. Runs are cut from short pieces of the text one by one: no list of them is
    held, and a run that ends with the text is a run all the same."""
    sums = rules.select(F.length("_gram").alias("_l")).groupBy("_l").agg(F.sum("_l").alias("_c")).collect()
    few = [r["_l"] for r in sums if r["_c"] <= PATTERN_CHARS]
    many = [r["_l"] for r in sums if r["_c"] > PATTERN_CHARS]
    known = [r[0] for r in rules.where(F.length("_gram").isin(few)).select("_gram").distinct().collect()]
    found = [F.regexp_extract_all("_low", F.lit(p), F.lit(1)) for p in _patterns(known)]
    none = F.array(F.lit(None).cast("string"))                              # joins nothing and keeps the row
    if not many:
        return rows.withColumn("_g", F.explode(F.concat(none, *found)))
    pieces = F.regexp_extract_all("_low", F.lit(f"(?s)(?=(.{{1,{PIECE + max(many) - 1}}})).{{1,{PIECE}}}"), F.lit(1))
    cut = rows.withColumn("_piece", F.explode(F.concat(none, pieces)))
    whole = F.col("_piece").isNull()
    cut = cut.withColumn("_at", F.explode(F.when(whole, F.array(F.lit(0))).otherwise(
        F.sequence(F.lit(1), F.least(F.length("_piece"), F.lit(PIECE))))))
    runs = [F.substring("_piece", F.col("_at"), n) for n in many]
    if len(runs) == 1 and not found:
        return cut.withColumn("_g", runs[0])
    return cut.withColumn("_g", F.explode(F.when(whole, F.concat(none, *found)).otherwise(F.array(*runs))))


def _patterns(grams: list[str]) -> list[str]:
    """Patterns that find all of some strings of up to GRAM characters, wherever they
    overlap: one for each length, as a tree by their first characters."""
    def sign(c: str) -> str:
        return f"\\x{{{ord(c):x}}}"

    def tree(rest: list[str]) -> str:
        if len(rest[0]) == 1:
            return f"[{''.join(sign(c) for c in rest)}]"
        heads: dict[str, list[str]] = {}
        for g in rest:
            heads.setdefault(g[0], []).append(g[1:])
        return "(?:" + "|".join(sign(c) + tree(tails) for c, tails in heads.items()) + ")"

    lengths: dict[int, list[str]] = {}
    for g in sorted(grams):
        lengths.setdefault(len(g), []).append(g)
    return [f"(?=[{''.join(sorted({sign(g[0]) for g in some}))}])(?=({tree(some)}))" for some in lengths.values()]


def label_counts(labelled: DataFrame, labels, name: str = "label") -> DataFrame:
    """(label, n_documents) for every listed label, zeros included. Labels are
    counted on the map side, so a label with most of the rows is no hot key."""
    spark = labelled.sparkSession
    listed = spark.createDataFrame([(x,) for x in dict.fromkeys(labels)], f"{name} string")
    counts = labelled.groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    return (listed.join(counts, name, "left")
            .select(name, F.coalesce("n", F.lit(0)).alias("n_documents")))


def label_deltas(base: DataFrame, changed: DataFrame, key: str, name: str = "label") -> DataFrame:
    """(label, n): how the counts of labels change when rows of (key, label) replace the
    stored ones of their keys; a NULL label deletes. Keys are single on both sides. Of the
    stored rows only those of changed keys leave the join."""
    old = base.select(key, F.col(name).alias("_old"))
    pairs = changed.select(key, F.col(name).alias("_new")).join(old, key, "left")
    signed = pairs.select(F.explode(F.array(
        F.struct(F.col("_old").alias(name), F.lit(-1).alias("n")),
        F.struct(F.col("_new").alias(name), F.lit(1).alias("n")))).alias("_d")).select("_d.*")
    return signed.where(F.col(name).isNotNull()).groupBy(name).agg(F.sum("n").alias("n")).where("n <> 0")


def maintain_counts(counts: DataFrame, deltas: DataFrame, name: str = "label") -> DataFrame:
    """(label, n_documents) after changes: counts and deltas added up, labels that none has
    any more included with zero. The cost follows labels and changes, not documents."""
    both = counts.select(name, F.col("n_documents").alias("n")).unionByName(deltas.select(name, "n"))
    return both.groupBy(name).agg(F.sum("n").alias("n_documents"))
