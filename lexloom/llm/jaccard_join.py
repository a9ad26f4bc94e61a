"""Self-join of documents by Jaccard similarity of word-shingle sets, exact, by
prefix filters under several global token orders.

If two sets of sizes n and m have similarity t or more, they share a token among the
n - ceil(t n) + 1 first of one and the m - ceil(t m) + 1 first of the other, under any
order of all tokens. Three orders are used; all put tokens that occur in one set only
first, and then go by frequency, or by two independent hashes. Pairs come from the
first order's prefixes; only those that also share a token in the prefixes of the
other two are verified on the full sets.

1. Scan. Each task hashes shingles, takes equal sets as one class, and gathers the
   tokens of its classes in blocks; a block goes to hash buckets of tokens as a few
   binary rows. Tokens that are frequent within a block travel as one count.
2. Token buckets find the frequency of each token and return the tokens that occur in
   two or more classes. Two sets can only share such tokens.
3. Class buckets join these into the shared part of each class and cut its prefixes.
   Classes with enough unique tokens drop out: nothing can be similar to them.
4. Links. Classes that share a prefix token are not paired all with all: each is
   verified against the token's leader, one of a few spread by hash. Links make
   components; looser ones (COARSE) make clusters, which hold large groups of near
   copies. What may still link different components is verified in two ways, and no
   link is lost: pairs that share a prefix token and are in different clusters one by
   one; members of a cluster with several components block against block, where a task
   holds two blocks and gives one link for two components that meet.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import stage, stage_split
from .components import components
from .shingles import WIDTH, mix, shingle_set

#: Least similarity in hundredths, of links and of clusters.
SIMILAR, COARSE = 80, 60
#: Members of a cluster's block, and tokens counted at once in it.
MEMBERS, COLUMNS = 256, 4096
#: Tokens of a block, and tokens or returned tokens of a bucket.
BLOCK, BUCKET = 1_000_000, 3_000_000
#: A token in so many classes of a block travels as a count.
FREQUENT = 64
#: Leaders of a token's classes are the smallest under one of so many hashes.
LEADERS = 4
#: Characters that a word takes at least on average, for the number of buckets only.
WORD_CHARS = 6

#: kind 0: documents and their classes; 1: classes and tokens with frequencies;
#: 2: classes and frequent tokens without; 3: frequencies of those. In the scan, 4:
#: classes and tokens of a block; 5: counts of its frequent tokens.
ROWS = ("kind int, bucket long, ids array<{id}>, classes binary, counts binary, tokens binary, "
        "df binary, targets binary")
EMPTY = b"\0" * 16


def class_key(tokens: np.ndarray) -> bytes:
    """16 bytes that stand for a set: a digest and, in the last 4, its size."""
    if not len(tokens):
        return EMPTY
    return (hashlib.blake2b(tokens.tobytes(), digest_size=12).digest()
            + len(tokens).to_bytes(4, "big"))


def _rows(kind_id, rows: list[dict]) -> pa.RecordBatch:
    fields = [("kind", pa.int32()), ("bucket", pa.int64()), ("ids", pa.list_(kind_id)),
              *[(c, pa.binary()) for c in ("classes", "counts", "tokens", "df", "targets")]]
    return pa.RecordBatch.from_pydict(
        {c: pa.array([r.get(c) for r in rows], t) for c, t in fields})


def _by(target: np.ndarray, n: int):
    """Positions in order of their target, and the cut points of the n targets."""
    small = np.uint16 if n <= 1 << 16 else np.int64
    order = np.argsort(target.astype(small), kind="stable")
    return order, np.searchsorted(target[order], np.arange(n + 1))


def _targets_of(keys: np.ndarray, n: int) -> np.ndarray:
    """The class bucket of each 16-byte class key."""
    head = np.frombuffer(keys.tobytes(), "<u8").reshape(-1, 2)[:, 0]
    return (mix(head, 5) % np.uint64(n)).astype(np.int64)


def _classes_and_counts(keys: np.ndarray, owner: np.ndarray) -> tuple[bytes, bytes]:
    """Class keys and how many tokens of each follow; owner ascends."""
    cls, counts = np.unique(owner, return_counts=True)
    return keys[cls].tobytes(), counts.astype("<u4").tobytes()


def _scan(n_buckets: int, width: int):
    def run(batches):
        seen: set[bytes] = set()
        block: list[np.ndarray] = []
        keys: list[bytes] = []
        size, number = 0, 0
        kind_id = pa.int64()

        def flush():
            nonlocal block, keys, size
            if not block:
                return
            key = np.frombuffer(b"".join(keys), "V16")
            owner = np.repeat(np.arange(len(block)), [len(b) for b in block])
            tokens = np.concatenate(block)
            block, keys, size = [], [], 0
            cls_target = _targets_of(key, n_buckets)
            rows = []
            distinct, back, counts = np.unique(tokens, return_inverse=True, return_counts=True)
            often = counts[back] >= FREQUENT
            if often.any():
                # To the class buckets: which classes hold which frequent tokens.
                t, o = tokens[often], owner[often]
                order, cuts = _by(cls_target[o], n_buckets)
                for b in range(n_buckets):
                    at = order[cuts[b]:cuts[b + 1]]
                    if len(at):
                        cls, n = _classes_and_counts(key, o[at])
                        rows.append({"kind": 2, "bucket": b, "classes": cls, "counts": n,
                                     "tokens": t[at].tobytes()})
                # To the token buckets: how many, and which class buckets want to know.
                pair = np.unique(np.stack([t, cls_target[o].astype(np.uint64)]), axis=1)
                hot, n_targets = np.unique(pair[0], return_counts=True)
                hot_counts = counts[np.searchsorted(distinct, hot)]
                bucket = (hot % np.uint64(n_buckets)).astype(np.int64)
                starts = np.concatenate(([0], np.cumsum(n_targets)))
                for b in np.unique(bucket).tolist():
                    at = np.flatnonzero(bucket == b)
                    rows.append({"kind": 5, "bucket": b, "tokens": hot[at].tobytes(),
                                 "df": hot_counts[at].astype("<u4").tobytes(),
                                 "counts": n_targets[at].astype("<u4").tobytes(),
                                 "targets": np.concatenate(
                                     [pair[1][starts[i]:starts[i + 1]] for i in at]).tobytes()})
            t, o = tokens[~often], owner[~often]
            order, cuts = _by((t % np.uint64(n_buckets)).astype(np.int64), n_buckets)
            for b in range(n_buckets):
                at = order[cuts[b]:cuts[b + 1]]
                if len(at):
                    cls, n = _classes_and_counts(key, o[at])
                    rows.append({"kind": 4, "bucket": b, "classes": cls, "counts": n,
                                 "tokens": t[at].tobytes()})
            for at in range(0, len(rows), 32):
                yield _rows(kind_id, rows[at:at + 32])

        for batch in batches:
            ids, kind_id = batch["id"], batch["id"].type
            of_batch = []
            for text in batch["text"].to_pylist():
                tokens = shingle_set(text or "", width)
                key = class_key(tokens)
                of_batch.append(key)
                if len(tokens) and key not in seen:
                    seen.add(key)
                    block.append(tokens)
                    keys.append(key)
                    size += len(tokens)
                    if size >= BLOCK:
                        yield from flush()
            yield _rows(kind_id, [{"kind": 0, "bucket": number % n_buckets, "ids": ids.to_pylist(),
                                   "classes": b"".join(of_batch)}])
            number += 1
        yield from flush()
    return run


def _read(rows: list[dict]):
    """Class keys, owner of each token, tokens, of rows with classes and counts."""
    keys = np.frombuffer(b"".join(r["classes"] for r in rows), "V16")
    counts = np.frombuffer(b"".join(r["counts"] for r in rows), "<u4")
    tokens = np.frombuffer(b"".join(r["tokens"] for r in rows), "<u8")
    return keys, np.repeat(np.arange(len(keys)), counts), tokens


def _frequencies(n_buckets: int):
    def run(key, group):
        """One token bucket: the tokens of two classes or more, by class bucket, and
        what only passes through."""
        kind_id = group.schema.field("ids").type.value_type
        rows = group.to_pylist()
        out = [r for r in rows if r["kind"] in (0, 2)]
        plain, often = [r for r in rows if r["kind"] == 4], [r for r in rows if r["kind"] == 5]
        del rows
        hot = np.empty(0, np.uint64)
        hot_df = pair_hot = pair_target = np.empty(0, np.int64)
        if often:
            t = np.frombuffer(b"".join(r["tokens"] for r in often), "<u8")
            n = np.frombuffer(b"".join(r["df"] for r in often), "<u4")
            hot, back = np.unique(t, return_inverse=True)
            hot_df = np.bincount(back, n, len(hot)).astype(np.int64)
            counts = np.frombuffer(b"".join(r["counts"] for r in often), "<u4")
            pair_hot = np.repeat(back, counts)
            pair_target = np.frombuffer(b"".join(r["targets"] for r in often), "<u8").astype(np.int64)
        if plain:
            keys, owner, tokens = _read(plain)
            del plain
            # Only tokens that occur twice here or are frequent in some block matter.
            ordered = np.sort(tokens)
            twice = np.unique(np.concatenate((ordered[1:][ordered[1:] == ordered[:-1]], hot)))
            del ordered
            if len(twice):
                at = np.minimum(np.searchsorted(twice, tokens), len(twice) - 1)
                keep = twice[at] == tokens
                owner, tokens = owner[keep], tokens[keep]
                keys, back = np.unique(keys, return_inverse=True)     # a class of several blocks
                owner = back[owner]
                order = np.lexsort((tokens, owner))
                owner, tokens = owner[order], tokens[order]
                new = np.append(True, (owner[1:] != owner[:-1]) | (tokens[1:] != tokens[:-1]))
                owner, tokens = owner[new], tokens[new]
                shared, back, df = np.unique(tokens, return_inverse=True, return_counts=True)
                if len(hot):
                    i = np.minimum(np.searchsorted(shared, hot), max(0, len(shared) - 1))
                    is_in = shared[i] == hot
                    hot_df = hot_df + np.where(is_in, df[i], 0)
                    df = df.copy()
                    df[i[is_in]] = hot_df[is_in]
                df = df[back]
                keep = df >= 2
                owner, tokens, df = owner[keep], tokens[keep], df[keep]
                target = _targets_of(keys, n_buckets)[owner]
                order, cuts = _by(target, n_buckets)
                for b in range(n_buckets):
                    at = order[cuts[b]:cuts[b + 1]]
                    if len(at):
                        cls, n = _classes_and_counts(keys, owner[at])
                        out.append({"kind": 1, "bucket": b, "classes": cls, "counts": n,
                                    "tokens": tokens[at].tobytes(), "df": df[at].astype("<u8").tobytes()})
        if len(hot):
            pairs = np.unique(np.stack([pair_target, pair_hot]), axis=1)
            for b in np.unique(pairs[0]).tolist():
                which = pairs[1][pairs[0] == b]
                out.append({"kind": 3, "bucket": b, "tokens": hot[which].tobytes(),
                            "df": hot_df[which].astype("<u8").tobytes()})
        return pa.Table.from_batches([_rows(kind_id, out[i:i + 64]) for i in range(0, len(out), 64)]
                                     or [_rows(kind_id, [])])
    return run


CANDIDATES = "class binary, n int, tokens array<long>, p1 array<long>, p2 array<long>, p3 array<long>"


def _prefixes(similar: int):
    def run(key, group):
        """One class bucket: the shared tokens of its classes and their prefixes."""
        out: dict[str, list] = {c.split()[0]: [] for c in CANDIDATES.split(", ")}
        rows = group.to_pylist()
        known = [r for r in rows if r["kind"] == 1]
        often, told = [r for r in rows if r["kind"] == 2], [r for r in rows if r["kind"] == 3]
        keys, owner, tokens = _read(known + often)
        df = np.frombuffer(b"".join(r["df"] for r in known), "<u8")
        if often:
            t = np.frombuffer(b"".join(r["tokens"] for r in told), "<u8")
            n = np.frombuffer(b"".join(r["df"] for r in told), "<u8")
            order = np.argsort(t)
            df = np.concatenate((df, n[order][np.searchsorted(t[order], tokens[len(df):])]))
        keys, back = np.unique(keys, return_inverse=True)
        owner = back[owner]
        order = np.lexsort((tokens, df, owner))
        owner, tokens, df = owner[order], tokens[order], df[order]
        if len(owner):
            new = np.append(True, (owner[1:] != owner[:-1]) | (tokens[1:] != tokens[:-1]))
            owner, tokens, df = owner[new], tokens[new], df[new]
        cuts = np.searchsorted(owner, np.arange(len(keys) + 1))
        for i in range(len(keys)):
            k = keys[i].tobytes()
            n = int.from_bytes(k[12:], "big")
            own = tokens[cuts[i]:cuts[i + 1]]
            of_prefix = n - -(-similar * n // 100) + 1 - (n - len(own))
            if of_prefix <= 0:
                continue
            for c, v in (("class", k), ("n", n), ("tokens", np.sort(own).view(np.int64)),
                         ("p1", own[:of_prefix].view(np.int64)),
                         *[(f"p{s}", own[np.argsort(mix(own, s))[:of_prefix]].view(np.int64))
                           for s in (2, 3)]):
                out[c].append(v)
        kinds = [pa.binary(), pa.int32(), *[pa.list_(pa.int64())] * 4]
        return pa.table({c: pa.array(v, t) for (c, v), t in zip(out.items(), kinds)})
    return run


def _verified(pairs: DataFrame, found: DataFrame, similar: int) -> DataFrame:
    """The pairs (u, v) that pass the other two filters and are similar, with the size
    of their intersection. Unique tokens are in neither list, so shared tokens give the
    whole intersection."""
    side = lambda c: found.select(F.col("class").alias(c), *[
        F.col(x).alias(f"{x}_{c}") for x in ("n", "tokens", "p2", "p3")])
    both = F.size(F.array_intersect("tokens_u", "tokens_v"))
    return (pairs.join(side("u"), "u").join(side("v"), "v")
            .where(F.arrays_overlap("p2_u", "p2_v") & F.arrays_overlap("p3_u", "p3_v"))
            .select("u", "v", both.alias("both"), (F.col("n_u") + F.col("n_v")).alias("sizes"))
            .where(_at_least(similar)))


def _at_least(similar: int):
    return 100 * F.col("both") >= similar * (F.col("sizes") - F.col("both"))


def _compare(similar: int):
    def run(key, group):
        """Two blocks of a cluster: one link for each two components that are similar."""
        roots, _, root = np.unique(np.array(group["root"].to_pylist(), "S16"), return_index=True,
                                   return_inverse=True)
        sizes = group["n"].to_numpy()
        lists = [np.asarray(t, np.int64) for t in group["tokens"].to_pylist()]
        owner = np.repeat(np.arange(len(lists)), [len(t) for t in lists])
        tokens, back, count = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        order = np.argsort(back, kind="stable")
        order = order[count[back[order]] > 1]
        back, owner = back[order], owner[order]
        both = np.zeros((len(lists), len(lists)), np.float32)
        # Whole numbers below 2^24 in a block of columns, so that sums are exact.
        for at in range(0, int(back.max(initial=-1)) + 1, COLUMNS):
            part = slice(*np.searchsorted(back, (at, at + COLUMNS)))
            if part.start < part.stop:
                m = np.zeros((len(lists), COLUMNS), np.float32)
                m[owner[part], back[part] - at] = 1
                both += m @ m.T
        either = sizes[:, None] + sizes[None, :] - both
        i, j = np.nonzero((100 * both >= similar * either) & (root[:, None] < root[None, :]))
        _, one = np.unique(root[i] * len(roots) + root[j], return_index=True)
        classes = group["class"].take(pa.array(np.concatenate((i[one], j[one]))))
        n = len(one)
        return pa.table({"u": classes.slice(0, n), "v": classes.slice(n, n)})
    return run


def _within_clusters(found: DataFrame, clusters: DataFrame, roots: DataFrame, similar: int) -> DataFrame:
    """Links (u, v) between components of one cluster. Large components have blocks of
    their own, which are not held against each other."""
    placed = (clusters.withColumnRenamed("node", "class").withColumnRenamed("root", "cluster")
              .join(roots.withColumnRenamed("node", "class"), "class", "left")
              .withColumn("root", F.coalesce("root", "class")))
    split = (placed.groupBy("cluster").agg(F.min("root").alias("a"), F.max("root").alias("b"))
             .where("a <> b").select("cluster"))
    large = (placed.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("n_root"))
             .withColumn("part", F.when(F.col("n_root") >= MEMBERS, F.col("root")).otherwise(F.unhex(F.lit("")))))
    parts = large.groupBy("cluster", "part").agg(F.sum("n_root").alias("n_part"))
    blocks = stage(placed.join(split, "cluster").join(large.drop("n_root"), ["cluster", "root"])
                   .join(parts, ["cluster", "part"])
                   .withColumn("i", F.pmod(F.xxhash64("class"), F.ceil(F.col("n_part") / MEMBERS)))
                   .select("cluster", "class", "root", F.struct("part", "i").alias("block")), "blocks")
    every = stage(blocks.select("cluster", "block").distinct(), "every_block")
    one, two = [every.withColumnRenamed("block", c) for c in ("one", "two")]
    meet = (one.join(two, "cluster").where("one <= two")
            .where("one.part <> two.part or one.part = unhex('')")
            .withColumn("meeting", F.struct("cluster", "one", "two"))
            .select("meeting", "cluster", F.explode(F.array_distinct(F.array("one", "two"))).alias("block")))
    members = (blocks.join(meet, ["cluster", "block"]).select("meeting", "class", "root")
               .join(found.select("class", "n", "tokens"), "class"))
    return members.groupBy("meeting").applyInArrow(_compare(similar), "u binary, v binary")


def _links(found: DataFrame, similar: int) -> DataFrame:
    """(node, root) of all classes that are similar to another."""
    n_close = lambda a, b: 100 * F.least(a, b) >= similar * F.greatest(a, b)
    posts = found.select("class", "n", F.explode("p1").alias("token"))
    turn = F.pmod("token", F.lit(LEADERS))
    leaders = stage(posts.groupBy("token").agg(
        F.min(F.struct(F.xxhash64("class", turn).alias("h"), "class", "n")).alias("first"),
        F.count(F.lit(1)).alias("held")).where("held > 1")
        .select("token", F.col("first.class").alias("leader"), F.col("first.n").alias("leader_n")),
        "leaders")
    ordered = lambda a, b: (F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
    stars = (posts.join(leaders, "token").where(F.col("class") != F.col("leader"))
             .select(*ordered(F.col("class"), F.col("leader"))).distinct())
    near = stage(_verified(stars, found, min(COARSE, similar)), "stars")
    links = near.where(_at_least(similar)).select("u", "v")
    roots = stage(components(links), "roots")
    clusters = stage(components(near.select("u", "v")), "clusters")

    # Pairs across clusters, of tokens whose classes are in more than one.
    placed = stage(posts.join(leaders.select("token"), "token")
                   .join(clusters.withColumnRenamed("node", "class"), "class", "left")
                   .withColumn("cluster", F.coalesce("root", "class")).drop("root"), "placed")
    split = (placed.groupBy("token").agg(F.min("cluster").alias("a"), F.max("cluster").alias("b"))
             .where("a <> b").select("token"))
    mixed = stage(placed.join(split, "token"), "mixed")
    one, two = [mixed.select("token", *[F.col(c).alias(f"{c}{i}") for c in ("class", "n", "cluster")])
                for i in (1, 2)]
    across = (one.join(two, "token").where("cluster1 < cluster2").where(n_close(F.col("n1"), F.col("n2")))
              .select(*ordered(F.col("class1"), F.col("class2"))).distinct())
    more = stage(_verified(across, found, similar).select("u", "v").unionByName(
        _within_clusters(found, clusters, roots, similar)), "more")
    if more.isEmpty():
        return roots
    return components(links.unionByName(more))


def _classes(docs: DataFrame, id_col: str, text_col: str, similar: int, width: int):
    """(id, class) of each row, and (class, root, component_id) of each class."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = ROWS.format(id=kind)
    chars = rows.agg(F.sum(F.length("text").cast("bigint"))).first()[0] or 0
    n = max(1, -(-chars // (WORD_CHARS * BUCKET)))
    tagged = stage_split(rows.mapInArrow(_scan(n, width), schema).groupBy("bucket")
                         .applyInArrow(_frequencies(n), schema), "tokens", "kind")
    found = stage(tagged.where("kind in (1, 2, 3)").groupBy("bucket")
                  .applyInArrow(_prefixes(similar), CANDIDATES), "found")

    at = F.col("pos") * 16 + 1
    own = tagged.where("kind = 0").select("classes", F.posexplode("ids").alias("pos", "id")).select(
        F.col("id").cast(kind).alias("id"), F.substring(F.col("classes"), at, F.lit(16)).alias("class"))
    roots = _links(found, similar).withColumnRenamed("node", "class")
    smallest = (own.groupBy("class").agg(F.min("id").alias("least")).join(roots, "class", "left")
                .withColumn("root", F.coalesce("root", "class")))
    by_root = stage(smallest.groupBy("root").agg(F.min("least").alias("component_id")), "by_root")
    return own, stage(smallest.select("class", "root").join(by_root, "root"), "placed")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       similar: int = SIMILAR, width: int = WIDTH) -> DataFrame:
    """(id, n_shingles, component_id), one row for each document.

    A document's set: its distinct shingles of `width` words; with fewer words the
    whole sequence as one; without words or text empty, and linked with nothing. Two
    documents link when 100 * intersection >= similar * union. component_id is the
    smallest id that links reach, the document's own included. Repeated rows and
    equal texts are in one component; null ids are never the smallest, and stay null
    where a component has no other. Other columns, whatever their names, are not read.
    """
    own, placed = _classes(docs, id_col, text_col, similar, width)
    # The last four bytes of the class are the size of the set; 0: linked with nothing.
    size = F.conv(F.hex(F.substring("class", 13, 4)), 16, 10).cast("bigint")
    return (own.join(placed, "class")
            .select(F.col("id").alias(id_col), size.alias("n_shingles"),
                    F.when(size == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id")))


def _with_class(text_col: str, width: int):
    def run(batches):
        for batch in batches:
            keys = [class_key(shingle_set(t or "", width)) for t in batch[text_col].to_pylist()]
            yield batch.append_column("_class", pa.array(keys, pa.binary()))
    return run


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                similar: int = SIMILAR, width: int = WIDTH) -> DataFrame:
    """The documents, with all columns, that have the smallest id of their component:
    one row for each component, also where that id is repeated. Rows of one id with
    different texts are decided each by its own text. Of a component without ids one
    row stays; texts without words are linked with nothing and stay, repeated rows of
    them once."""
    own, placed = _classes(docs, id_col, text_col, similar, width)
    wordless = F.col("_class") == F.lit(EMPTY)
    found = stage(own.where("id is not null").groupBy("id", "class").agg(F.count(F.lit(1)).alias("n"))
                  .join(placed, "class").select(
                      F.col("id").alias("_id"), F.col("class").alias("_class"), F.col("root").alias("_root"), "n",
                      F.when(F.col("class") == F.lit(EMPTY), F.col("id")).otherwise(F.col("component_id"))
                      .alias("least")), "ids")
    rows = stage(found.groupBy("_id").agg(F.sum("n").alias("n"), F.min(F.col("_id") == F.col("least")).alias("stay"),
                                          F.max(F.col("_id") == F.col("least")).alias("any_stay")), "rows_of_ids")
    named = docs.where(F.col(id_col).isNotNull())
    by_id = F.col(id_col) == F.col("_id")
    # Merge joins at every size, as for the ids of a large corpus. An id of one row is
    # decided by the id alone.
    once = named.join(rows.where("n > 1 or not stay").select("_id").hint("merge"), by_id, "left_anti")
    with_class = lambda of: of.mapInArrow(_with_class(text_col, width), T.StructType(
        [*docs.schema.fields, T.StructField("_class", T.BinaryType())]))
    repeated = with_class(named.join(rows.where("n > 1 and any_stay").select("_id").hint("merge"), by_id, "left_semi"))
    # Of the near copies under one id the smallest class stands for the component.
    first = (found.where("_id = least").join(rows.where("n > 1").select("_id"), "_id")
             .groupBy("_id", "_root").agg(F.min("_class").alias("_class")))
    repeated = repeated.join(first.withColumnRenamed("_class", "_of").hint("merge"),
                             by_id & (F.col("_class") == F.col("_of")), "left_semi")
    repeated = (repeated.where(~wordless).dropDuplicates([id_col, "_class"])
                .unionByName(repeated.where(wordless).dropDuplicates([id_col, text_col])))
    # Rows without an id, by the class of their text.
    bare = with_class(docs.where(F.col(id_col).isNull()))
    alone = placed.where("component_id is null").select(F.col("class").alias("_class"), F.col("root").alias("_root"))
    first = bare.join(alone, "_class").where(~wordless).dropDuplicates(["_root"])
    return (once.unionByName(repeated.select(*docs.columns)).unionByName(first.select(*docs.columns))
            .unionByName(bare.where(wordless).select(*docs.columns)))
