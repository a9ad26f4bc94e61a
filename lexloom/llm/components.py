"""Connected components of an edge table: alternating stars while the table is
large, one pass of union-find once its edges fit a task."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import stage

#: Edges that one task finishes. More of them are first worked on by all tasks, and
#: never meet in one.
TASK_EDGES = 500_000


def _finish(batches):
    """(node, root) of all edges of a task."""
    us, vs = [], []
    for batch in batches:
        us.append(batch["u"])
        vs.append(batch["v"])
    if not us:
        return
    both = pa.chunked_array(us + vs).combine_chunks().dictionary_encode()
    names = both.dictionary
    order = pc.array_sort_indices(names)
    rank = np.empty(len(names), np.int64)
    rank[order.to_numpy()] = np.arange(len(names))
    ids = rank[both.indices.to_numpy()]
    half = len(ids) // 2
    parent = list(range(len(names)))
    for a, b in zip(ids[:half].tolist(), ids[half:].tolist()):
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[b] != b:
            parent[b] = b = parent[parent[b]]
        if a < b:                                   # the smaller node is the root
            parent[b] = a
        else:
            parent[a] = b
    for i in range(len(parent)):                    # parents come before their children
        parent[i] = parent[parent[i]]
    nodes = names.take(order)
    yield pa.RecordBatch.from_arrays([nodes, nodes.take(pa.array(parent))], ["node", "root"])


def _least(groups: DataFrame, name: str) -> DataFrame:
    """The smallest neighbour of each u, stored, so that the join back to a hub's
    many edges can be split."""
    return stage(groups.groupBy("u").agg(F.min("v").alias("m")), name)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes with an edge: root is the smallest node that is
    reachable. `edges` has columns u and v of one type. Of more than TASK_EDGES edges,
    large and small stars are formed in turn until nothing changes: every edge then
    leads to its root. Each round is stored."""
    edges = stage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                  .where("u <> v"), "edges")
    if edges.count() <= TASK_EDGES:
        kind = edges.schema["u"].dataType.simpleString()
        return edges.coalesce(1).mapInArrow(_finish, f"node {kind}, root {kind}")
    edges = stage(edges.distinct(), "edges")
    seen = None
    while True:
        # Large star: larger neighbours of a node move to its smallest one.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (both.join(_least(both, "least"), "u").where("v > u")
                 .select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct())
        large = stage(large, "large")
        # Small star: smaller neighbours and the node itself move to the smallest one.
        least = _least(large, "least")
        small = (large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.withColumnRenamed("m", "v")).distinct())
        edges = stage(small, "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
