"""Secret scans judged by corpus-wide ownership.

Each text is scanned once for base secrets (assignments, access keys, long hex
strings) and for further high-entropy strings. The hashes of all candidates are
counted over the whole corpus by distinct repositories, owners and texts. A string
held by one owner only, or only in copies of one text, is a live-looking credential;
one that many owners hold in many repositories is a widely copied example; between
them it is shared. High-entropy strings become findings (`owned`) unless they are
examples; base findings stay, whatever the counts say.

Skew: distinct (hash, owner), (hash, repository) and (hash, text) rows are reduced by
partial aggregation before each shuffle, and the counts come back by a join of two stored tables, in
which adaptive execution splits a hash that a third of the rows hold. Values
never leave the scan: only their hashes do.
"""
from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import stage

# Fixed by the contract of the base scan.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "owned")
#: A further candidate: a run of this many characters or more.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{24,}")
#: Its least entropy in bits, over all its characters, and the most characters on
#: average of its pieces: words in lower, upper or title case, and numbers. With this
#: many digits and different characters the pieces may be of any length.
RUN_BITS, PIECE_CHARS, RUN_DIGITS, RUN_CHARS = 64, 5, 5, 10
PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
#: At most so many owners: owner-specific. At least so many owners and repositories: a
#: copied example.
OWNED, COPIED = 1, 5

SCAN = ("id {id}, owner string, text_md5 string, n_assign long, n_access long, n_hex long, "
        "base_sha256 string, base string, "
        "found array<struct<start:int,kind:int,stop:int,hash:string>>")


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of the base secrets, in order."""
    out = []
    # None of the names can match where none of these letters stand in either case.
    low = text.lower()
    if "pass" in low or "secret" in low or "token" in low or "api" in low or not low.isascii():
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def high_entropy(value: str) -> bool:
    """Whether a run looks drawn at random and not put together from words."""
    counts = Counter(value)
    bits = sum(n * math.log2(len(value) / n) for n in counts.values())
    digits = sum(counts[c] for c in "0123456789")
    if not any(c.isalpha() for c in counts):
        return False
    return (bits >= RUN_BITS and len(PIECE.findall(value)) * PIECE_CHARS >= len(value)
            or digits >= RUN_DIGITS and len(counts) >= RUN_CHARS)


def further_spans(text: str, base: list) -> list[tuple[int, int, int, str]]:
    """High-entropy runs that do not touch a base span. Runs and base spans both come in
    order: a run is free where no span that begins before its end ends after its start."""
    out, i, reach = [], 0, 0
    for m in RUN.finditer(text):
        while i < len(base) and base[i][0] < m.end():
            reach = max(reach, base[i][2])
            i += 1
        if reach <= m.start() and high_entropy(m[0]):
            out.append((m.start(), 3, m.end(), m[0]))
    return out


def span_list(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in spans)


def _scan(batches):
    for batch in batches:
        rows: list[dict] = []
        for text in batch["text"].to_pylist():
            text = text or ""
            base = base_spans(text)
            listed = span_list(base)
            found = [(a, k, b, hashlib.sha256(v.encode()).hexdigest())
                     for a, k, b, v in sorted(base + further_spans(text, base))]
            rows.append({"text_md5": hashlib.md5(text.encode()).hexdigest(),
                         **{f"n_{KINDS[k]}": sum(s[1] == k for s in base) for k in range(3)},
                         "base_sha256": hashlib.sha256(listed.encode()).hexdigest(), "base": listed,
                         "found": [dict(zip(("start", "kind", "stop", "hash"), f)) for f in found]})
        span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32()),
                          ("hash", pa.string())])
        own = pa.schema([("text_md5", pa.string()), ("n_assign", pa.int64()),
                         ("n_access", pa.int64()), ("n_hex", pa.int64()),
                         ("base_sha256", pa.string()), ("base", pa.string()),
                         ("found", pa.list_(span))])
        out = pa.Table.from_pylist(rows, own)
        yield from pa.table({"id": batch["id"], "owner": batch["owner"],
                             **{c: out[c] for c in out.column_names}}).to_batches()


def judge_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  owner_col: str = "source", owned: int = OWNED,
                  copied: int = COPIED) -> DataFrame:
    """(id, owner, text_md5, n_assign, n_access, n_hex, base_sha256, spans, copies):
    one row for each different (id, owner, text), with the number of its copies.

    spans: array of (start, kind, stop, repositories, owners, verdict), verdict
    `live`, `shared` or `example`, in order; `owned` spans unless they are examples.
    The id is the repository. A null owner or id is one of its kind. A null text is empty.
    Other columns, whatever their names, are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(owner_col).cast("string").alias("owner"),
                       F.col(text_col).alias("text"))
    key = [c for c in ("id", "owner", "text_md5", "n_assign", "n_access", "n_hex", "base_sha256",
                       "base", "found")]
    seen = stage(rows.mapInArrow(_scan, SCAN.format(id=rows.schema["id"].dataType.simpleString()))
                 .groupBy(*key).agg(F.count(F.lit(1)).alias("copies")), "scan")
    found = seen.withColumn("f", F.explode("found"))
    held = stage(found.select("f.hash", F.explode(F.array(*[
        F.struct(F.lit(i).alias("of"), F.col(c).cast("string").alias("v"))
        for i, c in enumerate(("id", "owner", "text_md5"))])).alias("h")).select("hash", "h.*").distinct()
        .groupBy("hash").agg(*[F.count_if(F.col("of") == i).alias(c)
                               for i, c in enumerate(("repositories", "owners", "texts"))]), "held")
    verdict = (F.when((F.col("owners") >= copied) & (F.col("repositories") >= copied), "example")
               .when((F.col("owners") <= owned) | (F.col("texts") == 1), "live").otherwise("shared"))
    row = ["id", "owner", "text_md5"]
    judged = (found.select(*row, "f.*").join(held, "hash").withColumn("verdict", verdict)
              .where((F.col("kind") < len(KINDS) - 1) | (F.col("verdict") != "example"))
              .select(*row, F.struct("start", "kind", "stop", "repositories", "owners", "verdict")
                      .alias("span")))
    return (seen.drop("found", "base").unionByName(judged, allowMissingColumns=True)
            .groupBy(*row).agg(
                *[F.max(c).alias(c) for c in ("n_assign", "n_access", "n_hex", "base_sha256", "copies")],
                F.sort_array(F.collect_list("span")).alias("spans")))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 owner_col: str = "source") -> DataFrame:
    """The judged rows as (id, n_assign, n_access, n_hex, base_sha256, spans,
    n_live, n_example), one for each input row; spans as kind:start:end text."""
    names = F.array(*map(F.lit, KINDS))
    listed = F.array_join(F.transform("spans", lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"], s["stop"])), ",")
    count = lambda v: F.size(F.filter("spans", lambda s: s["verdict"] == v)).cast("long")
    return (judge_secrets(docs, id_col, text_col, owner_col)
            .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
            .select(F.col("id").alias(id_col), "n_assign", "n_access", "n_hex", "base_sha256",
                    listed.alias("spans"), count("live").alias("n_live"),
                    count("example").alias("n_example")))


def _redact(text, spans, mark):
    if spans is None or text is None:
        return text
    out, at = [], 0
    for s in spans:
        if s["stop"] > at:
            out += [text[at:max(at, s["start"])], mark]
            at = s["stop"]
    return "".join([*out, text[at:]])


def _redacted(mark: str):
    """The redaction as a function of Arrow columns."""
    def run(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([_redact(t, s, mark) for t, s in zip(texts.to_pylist(), spans.to_pylist())], pa.string())
    run.__annotations__ = {"texts": pa.Array, "spans": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, T.StringType())


def redact_secrets(docs: DataFrame, mark: str = "<secret>", id_col: str = "doc_id",
                   text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """The documents, all rows and columns, with every secret but widely copied
    examples replaced by a mark; documents without any keep their text, null
    texts stay null."""
    drop = F.filter("spans", lambda s: s["verdict"] != "example")
    hits = (judge_secrets(docs, id_col, text_col, owner_col)
            .select(F.col("id").alias("_id"), F.col("owner").alias("_owner"), "text_md5",
                    drop.alias("_spans")).where(F.size("_spans") > 0))
    same = ((F.md5(F.encode(F.col(text_col), "UTF-8")) == F.col("text_md5"))
            & F.col(id_col).eqNullSafe(F.col("_id"))
            & F.col(owner_col).cast("string").eqNullSafe(F.col("_owner")))
    # Of rows without secrets Python gets NULL for the text.
    text = _redacted(mark)(F.when(F.col("_spans").isNotNull(), F.col(text_col)), F.col("_spans"))
    # A merge join at every size, as for the findings of a large corpus.
    return (docs.join(hits.hint("merge"), same, "left")
            .withColumn(text_col, F.coalesce(text, F.col(text_col)))
            .select(*docs.columns))
