"""Connected components of a graph of any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelorus.llm.common import in_arrow, stage

#: Edges that one task joins at once; a graph with more goes through rounds of joins.
ONE_TASK = 500_000


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node reachable.

    A graph of ``ONE_TASK`` edges at most is one task's work. For a larger one,
    large-star and small-star rounds in turn: each round ties a node's larger
    neighbours, then its smaller ones, to the smallest of them, until every
    component is a star. The result is the same. Nodes may be of any ordered
    type. Loops and repeated edges do no harm; an empty table gives no rows. The
    rounds grow with the logarithm of the longest path, and each writes its
    edges to the shared folder.
    """
    smaller, larger = F.least("a", "b"), F.greatest("a", "b")
    now = stage(edges.where("a <> b").select(larger.alias("u"), smaller.alias("v")).distinct(), name)
    if now.count() <= ONE_TASK:
        kind = now.schema["u"].dataType.simpleString()
        return stage(in_arrow(now.repartition(1), rooted_nodes, f"node {kind}, root {kind}"), name)
    seen = _mark(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(least, "u")
        small = tied.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = stage(small.distinct(), name)
        before, seen = seen, _mark(now)
        if seen == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def rooted_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all edges (u, v) of a task."""
    parts = list(batches)
    if not sum(b.num_rows for b in parts):
        return
    ends = pa.chunked_array([b.column(i) for i in (0, 1) for b in parts]).combine_chunks().dictionary_encode()
    names, place = ends.dictionary, ends.indices.to_numpy()
    order = pc.sort_indices(names).to_numpy()
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    root = least_reachable(*np.split(rank[place], 2), len(order))
    yield pa.RecordBatch.from_arrays([names.take(pa.array(order)), names.take(pa.array(order[root]))], names=["node", "root"])


def least_reachable(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each node 0..n-1 the least that it reaches over the edges a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        for end in (a, b):
            np.minimum.at(new, root[end], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _mark(edges: DataFrame) -> tuple[int, int]:
    """Number of edges and a sum over their hashes, to see whether a round changed any."""
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], int(r["h"] or 0)
