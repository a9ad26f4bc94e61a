"""URL filters: longest matching (host, path) rule by a sort-merge range join.

A rule's canonical key is its reversed host followed by its path, so the rule is
the interval of all keys that begin with it. A URL has one key for itself and one
for each parent domain; a parent's key keeps the URL's path. Rule starts, rule
ends and URL keys are sorted together, and a sweep over that order keeps the
stack of open rules: intervals of one host are nested or apart, so the depth is a
running count, and the top of the stack at depth d is the last rule that opened
at depth d. Only built-in functions are used.

Skew: identical (id, host, path) rows are counted before anything else. The keys
of one rule host are dealt over as many pieces as its share of all keys asks for,
and its rules are repeated in each of those pieces.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A host that holds all keys is dealt over this many pieces, a smaller one over
#: a proportional number.
PIECES = 1024


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; null
    or without `://`: empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, UPPER.lower()), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; null or without `://`: empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def parent_hosts(host: Column) -> Column:
    """The host and all its parent domains: a.b.c -> [a.b.c, b.c, c]."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)),
                       lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))


def match_urls(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
               default: str = "allow", pieces: int = PIECES) -> DataFrame:
    """(id, host, path, rule, verdict), one row for each input row.

    `rules` has host, path and verdict strings. A rule fits its host and all
    subdomains when the URL's path starts with the rule's path. The longest rule
    (host and path together, then host) wins; of equal rules with different
    verdicts `block` does. Rules with a null part fit nothing. `rule` is host and
    path, null where none fits; `verdict` is then `default`. Null URLs and URLs
    without `://` have an empty host and path, which only a rule with an empty
    host and path fits. Repeated rows and null ids are kept; other columns,
    whatever their names, are not read.
    """
    key = ["id", "host", "path"]
    rows = (urls.select(F.col(id_col).alias("id"), url_host(F.col(url_col)).alias("host"),
                        url_path(F.col(url_col)).alias("path"))
            .groupBy(*key).agg(F.count(F.lit(1)).alias("copies")))
    rules = (rules.where("host is not null and path is not null and verdict is not null")
             .groupBy("host", "path")
             .agg(F.max(F.struct((F.col("verdict") == "block").alias("b"), "verdict"))["verdict"]
                  .alias("verdict")))

    # Keys of URLs below hosts that have rules, and the pieces each such host needs.
    keys = (rows.select(*key, F.explode(parent_hosts(F.col("host"))).alias("owner"))
            .join(rules.select(F.col("host").alias("owner")).distinct(), "owner"))
    share = _shares(keys, rows, pieces)
    dealt = (keys.join(share, "owner")
             .withColumn("piece", F.pmod(F.xxhash64("id", "path"), F.col("pieces"))))

    canonical = lambda owner, path: F.encode(
        F.concat(reversed_host(owner), F.lit("/"), path), "UTF-8")
    open_rules = (rules.withColumnRenamed("host", "owner").join(share, "owner")
                  .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"),
                                                            F.col("pieces") - 1)))
                  .withColumn("key", canonical(F.col("owner"), F.col("path"))))
    rule = F.struct((F.length("owner") + F.length("path")).alias("length"),
                    F.length("owner").alias("host_length"),
                    F.concat("owner", "path").alias("rule"), "verdict")
    none = F.lit(None)
    starts = open_rules.select("owner", "piece", "key", F.lit(0).alias("kind"),
                               F.lit(1).alias("step"), rule.alias("opened"))
    # 0xFF does not occur in UTF-8: this key follows all keys that begin with the rule.
    ends = open_rules.select("owner", "piece", F.concat("key", F.unhex(F.lit("FF"))).alias("key"),
                             F.lit(2).alias("kind"), F.lit(-1).alias("step"),
                             none.cast(starts.schema["opened"].dataType).alias("opened"))
    points = dealt.select("owner", "piece", canonical(F.col("owner"), F.col("path")).alias("key"),
                          F.lit(1).alias("kind"), F.lit(0).alias("step"),
                          none.cast(starts.schema["opened"].dataType).alias("opened"), *key)
    events = points.unionByName(starts, allowMissingColumns=True).unionByName(
        ends, allowMissingColumns=True)
    # Dealt by piece too: the join above may have dealt the keys by owner alone.
    events = events.repartition("owner", "piece")

    sweep = Window.partitionBy("owner", "piece").orderBy("key", "kind")
    so_far = (Window.unboundedPreceding, Window.currentRow)
    level = Window.partitionBy("owner", "piece", "depth").orderBy("key", "kind").rowsBetween(*so_far)
    fits = (events.withColumn("depth", F.sum("step").over(sweep.rowsBetween(*so_far)))
            .withColumn("top", F.last("opened", ignorenulls=True).over(level))
            .where("kind = 1 and depth > 0").select(*key, "top"))

    best = (rows.unionByName(fits, allowMissingColumns=True)
            .groupBy(*key).agg(F.max("copies").alias("copies"), F.max("top").alias("top")))
    return (best.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
            .select(F.col("id").alias(id_col), "host", "path", F.col("top.rule").alias("rule"),
                    F.coalesce("top.verdict", F.lit(default)).alias("verdict")))


def _shares(keys: DataFrame, rows: DataFrame, pieces: int) -> DataFrame:
    """(owner, pieces): pieces in proportion to the owner's share of all rows."""
    total = rows.agg(F.count(F.lit(1))).scalar()
    return (keys.groupBy("owner").agg(F.count(F.lit(1)).alias("n"))
            .select("owner", F.ceil(F.lit(pieces) * F.col("n") / total).alias("pieces")))
