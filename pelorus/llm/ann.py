"""Nearest neighbours by largest inner product, over neighbour graphs made by NN-descent.

Vectors get one component more, so that all have one length and the largest
inner product with a query (whose added component is 0) is the nearest vector.
They are dealt to shards of bounded size by a hash. Each shard's graph starts
from leaves of random hyperplanes and is bettered by rounds of NN-descent over
all shards at once, as Spark joins: nodes' neighbours, both ways, are joined
with their vectors, neighbours of one node are scored against each other, and
each node keeps its best. Rounds end when few edges change.

A query goes to every shard, with a greedy search of the graph that keeps a
beam of the best nodes seen and starts, where the query is a node, from itself.
A sample of each block of queries is audited against all vectors of the shard:
its beam grows until the recall is high enough, all queries of the block are
searched with that beam, and those of the sample that miss a node with wider
ones. Scores are inner products of the given vectors in
double precision.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pelorus.llm.common import drop, stage
from pelorus.llm.graphsearch import beam_search, reverse_capped, valid_vector

SHARD_NODES, BLOCK_QUERIES, BIN_NODES = 16_000, 4096, 1500
#: Neighbours kept, reverse neighbours used, trees and leaf size of the start.
NEIGHBOURS, REVERSE, TREES, LEAF_NODES = 20, 12, 2, 128
#: Rounds of descent end when fewer of the edges are new than this share, or after so many.
CHANGED, ROUNDS = 0.1, 12
#: Random links of each node, which join parts that the neighbour graph leaves apart.
FAR_LINKS = 3
FIRST_BEAM, ENTRIES = 64, 64
#: Queries of a block that are audited, the recall they must reach, and by what the beam grows until then.
AUDITED, LEAST_RECALL, WIDEN = 64, 0.97, 1.4

EDGES = "shard int, node long, nbr long, score float, new boolean"


def _halves(vectors: np.ndarray) -> list[bytes]:
    return [row.tobytes() for row in vectors.astype(np.float16)]


def _whole(data: pd.Series) -> np.ndarray:
    return np.stack([np.frombuffer(b, dtype=np.float16) for b in data]).astype(np.float32)


def _best(node: np.ndarray, nbr: np.ndarray, score: np.ndarray, k: int, new: np.ndarray | None = None) -> np.ndarray:
    """Rows of each node's ``k`` best neighbours, each neighbour once, as a known one if it is known."""
    order = np.lexsort((-score, nbr, node) if new is None else (new, nbr, node))
    once = np.ones(len(order), dtype=bool)
    once[1:] = (node[order][1:] != node[order][:-1]) | (nbr[order][1:] != nbr[order][:-1])
    order = order[once]
    order = order[np.lexsort((nbr[order], -score[order], node[order]))]
    n = node[order]
    first = np.flatnonzero(np.concatenate([[True], n[1:] != n[:-1]])) if len(n) else np.empty(0, dtype=np.int64)
    rank = np.arange(len(n)) - np.repeat(first, np.diff(np.append(first, len(n))))
    return order[rank < k]


def _edges(shard: int, node: np.ndarray, nbr: np.ndarray, score: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"shard": np.full(len(node), shard, dtype=np.int32), "node": node, "nbr": nbr, "score": score.astype(np.float32), "new": True})


def start(nodes: DataFrame, bits: int, seed: int = 1) -> DataFrame:
    """First edges: the best within leaves, a leaf being the nodes on the same side of random hyperplanes."""

    def leaf(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, v = pdf["node"].to_numpy(), _whole(pdf["half"])
        out = []
        for lo in range(0, len(ids), 512):
            s = v[lo : lo + 512] @ v.T
            s[np.arange(len(s)), lo + np.arange(len(s))] = -np.inf
            k = min(NEIGHBOURS, len(ids) - 1)
            if k:
                best = np.argpartition(-s, k - 1, axis=1)[:, :k]
                out.append((np.repeat(ids[lo : lo + 512], k), ids[best].ravel(), np.take_along_axis(s, best, axis=1).ravel()))
        parts = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, dtype=np.int64)] * 2 + [np.empty(0)]
        return _edges(int(pdf["shard"].iloc[0]), *parts)

    def sides(batches):
        planes: dict[tuple[int, int], np.ndarray] = {}
        for pdf in batches:
            if not len(pdf):
                continue
            v = _whole(pdf["half"])
            for tree in range(TREES):
                p = planes.setdefault((tree, v.shape[1]), np.random.default_rng((seed, tree)).standard_normal((v.shape[1], bits)).astype(np.float32))
                yield pdf.assign(tree=np.int32(tree), leaf=((v - 0) @ p > 0) @ (1 << np.arange(bits)))

    placed = nodes.select("shard", "node", "half").mapInPandas(sides, "shard int, node long, half binary, tree int, leaf long")
    return placed.groupBy("shard", "tree", "leaf").applyInPandas(leaf, EDGES)


def keep_best(edges: DataFrame, bins: int) -> DataFrame:
    """Each node's ``NEIGHBOURS`` best edges."""

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.iloc[_best(*(pdf[c].to_numpy() for c in ("node", "nbr", "score")), NEIGHBOURS, pdf["new"].to_numpy())].drop(columns="bin")

    return edges.withColumn("bin", _bin(F.col("node"), bins)).groupBy("bin").applyInPandas(best, EDGES)


def _bin(node: Column, bins: int) -> Column:
    return F.pmod(F.xxhash64(node, F.lit(5)), F.lit(bins)).cast("int")


def descend(nodes: DataFrame, graph: DataFrame, bins: int) -> DataFrame:
    """One round: edges among the neighbours of each node, where they better an end's list."""
    back = graph.select("shard", F.col("nbr").alias("node"), F.col("node").alias("nbr"), "score")
    few = Window.partitionBy("node").orderBy(F.desc("score"), "nbr")
    back = back.withColumn("r", F.row_number().over(few)).where(F.col("r") <= REVERSE).drop("r", "score")
    both = graph.select("shard", "node", "nbr").unionByName(back).distinct()
    least = graph.groupBy("node").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    known = nodes.select(F.col("node").alias("nbr"), "half").join(least.select(F.col("node").alias("nbr"), F.when(F.col("n") >= NEIGHBOURS, F.col("least")).otherwise(F.lit(-9.0)).cast("float").alias("least")), "nbr")
    met = both.join(known, "nbr").withColumn("bin", _bin(F.col("node"), bins))

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(pdf["node"].to_numpy(), kind="stable")
        node, nbr, least, shard = (pdf[c].to_numpy()[order] for c in ("node", "nbr", "least", "shard"))
        v = _whole(pdf["half"])[order]
        cuts = np.append(np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])), len(node))
        out = []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            s = v[lo:hi] @ v[lo:hi].T
            np.fill_diagonal(s, -np.inf)
            a, b = np.nonzero(s > least[lo:hi, None])
            out.append((shard[lo + a], nbr[lo + a], nbr[lo + b], s[a, b]))
        sh, a, b, s = (np.concatenate(c) for c in zip(*out, strict=True))
        best = _best(a, b, s, NEIGHBOURS)
        return pd.DataFrame({"shard": sh[best], "node": a[best], "nbr": b[best], "score": s[best].astype(np.float32), "new": True})

    found = met.groupBy("bin").applyInPandas(pairs, EDGES)
    return keep_best(graph.withColumn("new", F.lit(False)).unionByName(found), bins)


class Index:
    """A shard's vectors and graph."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, scaled: np.ndarray, node: np.ndarray, nbr: np.ndarray, score: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors, self.scaled = ids[order], vectors[order], scaled[order].astype(np.float32)
        n = len(ids)
        own = np.full((n, NEIGHBOURS), -1, dtype=np.int64)
        a, b = np.searchsorted(self.ids, node), np.searchsorted(self.ids, nbr)
        best = np.lexsort((b, -score, a))
        a, b = a[best], b[best]
        col = np.arange(len(a)) - np.searchsorted(a, a)
        own[a[col < NEIGHBOURS], col[col < NEIGHBOURS]] = b[col < NEIGHBOURS]
        far = np.random.default_rng(n).integers(0, max(n, 1), (n, FAR_LINKS))
        self.graph = np.concatenate([own, reverse_capped(own, NEIGHBOURS), far], axis=1).astype(np.int32)

    def found(self, scaled: np.ndarray, enter: np.ndarray, k: int) -> np.ndarray:
        """Best nodes found for each query, best first, ``k + 1`` at least (-1 where there are fewer).

        The beam is one with which a sample of the queries finds ``LEAST_RECALL``
        of what a look at all vectors finds. Those of the sample that still
        miss a node are searched with wider beams until they miss none.
        """
        n = len(self.ids)
        sample = np.unique(np.linspace(0, len(scaled) - 1, min(AUDITED, len(scaled))).astype(int))
        truth = np.argsort(-(scaled[sample] @ self.scaled.T), axis=1, kind="stable")[:, : k + 1]
        beam, out, todo = min(n, max(FIRST_BEAM, 2 * k)), None, np.arange(len(sample))
        while True:
            own, _ = beam_search(self.scaled, self.graph, scaled[sample[todo]], enter[sample[todo]], beam)
            hits = np.array([len(np.intersect1d(a, b)) for a, b in zip(own, truth[todo], strict=True)])
            if out is None and (hits.sum() >= LEAST_RECALL * truth.size or beam == n):
                out, _ = beam_search(self.scaled, self.graph, scaled, enter, beam)
                out = out[:, : min(beam, 4 * k + 8)]
            if out is not None:
                out[sample[todo]] = own[:, : out.shape[1]]
                todo = todo[hits < truth.shape[1]]
                if beam == n or not len(todo):
                    return out
            beam = min(n, int(WIDEN * beam))

    def nearest(self, queries: np.ndarray, scaled: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the ``k`` best found for each query, itself left out, with double-precision scores."""
        n = len(self.ids)
        spread = np.unique(np.linspace(0, n - 1, min(n, ENTRIES)).astype(np.int64))
        at = np.minimum(np.searchsorted(self.ids, own), n - 1)
        enter = np.concatenate([np.broadcast_to(spread, (len(queries), len(spread))), np.where(self.ids[at] == own, at, -1)[:, None]], axis=1)
        found = self.found(scaled, enter, k)
        safe = np.maximum(found, 0)
        scores = np.zeros(found.shape)
        for d in range(queries.shape[1]):  # one component after the other, as a plain sum would
            scores += queries[:, d, None].astype(np.float64) * self.vectors[safe, d].astype(np.float64)
        scores = np.where((found < 0) | (self.ids[safe] == own[:, None]), -np.inf, scores)
        rank = np.lexsort((self.ids[safe], -scores), axis=1)[:, :k]
        return np.take_along_axis(safe, rank, axis=1), np.take_along_axis(scores, rank, axis=1)


def search(vectors: DataFrame, is_query: Callable[[Column], Column], k: int = 20) -> DataFrame:
    """The ``k`` nearest rows of each query: query_id, rank (from 1), vec_id, score.

    ``vectors``: vec_id, embedding. Queries are the rows whose vec_id meets
    ``is_query``, candidates all rows but the query's own. Ties go to the
    smaller vec_id; with fewer candidates than ``k`` all are returned. Null,
    empty and zero vectors and such with null or non-finite components take no
    part, nor do rows without vec_id; the first length by frequency is the
    table's, vectors of another take no part. Rows that repeat a vec_id count
    once. Of equal vectors only the ``k + 1`` rows with the smallest ids can be
    among the nearest, so the others are left out before the graph is made.
    """
    rows = vectors.where(valid_vector("embedding") & F.col("vec_id").isNotNull()).select("vec_id", "embedding")
    empty = "query_id long, rank int, vec_id long, score double"
    dims = rows.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not dims:
        return vectors.sparkSession.createDataFrame([], empty)
    rows = rows.where(F.size("embedding") == dims[0]["dim"])
    salted = Window.partitionBy("embedding", F.pmod(F.xxhash64("vec_id"), F.lit(256))).orderBy("vec_id")
    whole = Window.partitionBy("embedding").orderBy("vec_id")
    kept = rows.dropDuplicates(["vec_id"]).withColumn("r", F.row_number().over(salted)).where(F.col("r") <= k + 1)
    kept = kept.withColumn("r", F.row_number().over(whole)).where(F.col("r") <= k + 1).drop("r")
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    nodes = stage(kept.withColumn("length", length), "ann-vectors")
    n, longest = nodes.agg(F.count("*"), F.max("length")).first()
    shards, bins = max(1, -(-n // SHARD_NODES)), max(1, -(-n // BIN_NODES))

    def scale(pdfs):
        for pdf in pdfs:
            if len(pdf):
                v = np.stack(pdf["embedding"].to_numpy()).astype(np.float64) / longest
                more = np.sqrt(np.maximum(0, 1 - (v * v).sum(axis=1)))
                yield pd.DataFrame({"shard": pdf["shard"], "node": pdf["vec_id"], "half": _halves(np.concatenate([v, more[:, None]], axis=1))})

    shard = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(shards)).cast("int")
    nodes = nodes.withColumn("shard", shard)
    halves = stage(nodes.select("shard", "vec_id", "embedding").mapInPandas(scale, "shard int, node long, half binary"), "ann-halves")
    bits = max(0, int(np.ceil(np.log2(max(1.0, n / shards / LEAF_NODES)))))
    graph = stage(keep_best(start(halves, bits), bins), "ann-graph")
    for _ in range(ROUNDS):
        before, graph = graph, stage(descend(halves, graph, bins), "ann-graph")
        drop(before)
        if (graph.agg(F.avg(F.col("new").cast("int"))).first()[0] or 0) < CHANGED:
            break

    def build(key: tuple, own: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame({"shard": [], "index": []})
        v = np.stack(own["embedding"].to_numpy())
        s = v.astype(np.float64) / longest
        s = np.concatenate([s, np.sqrt(np.maximum(0, 1 - (s * s).sum(axis=1)))[:, None]], axis=1)
        index = Index(own["vec_id"].to_numpy(), v, s, edges["node"].to_numpy(), edges["nbr"].to_numpy(), edges["score"].to_numpy())
        return pd.DataFrame({"shard": [key[0]], "index": [pickle.dumps(index, protocol=5)]})

    indexes = stage(nodes.select("shard", "vec_id", "embedding").groupBy("shard").cogroup(graph.groupBy("shard")).applyInPandas(build, "shard int, index binary"), "ann-indexes")
    asked = rows.where(is_query(F.col("vec_id"))).dropDuplicates(["vec_id"])
    blocks = max(1, -(-asked.count() // BLOCK_QUERIES))
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    asked = asked.select(F.col("vec_id").alias("query_id"), "embedding", F.pmod(F.xxhash64("vec_id", F.lit(4)), F.lit(blocks)).cast("int").alias("block"), every)
    copies = indexes.select("shard", "index", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def find(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        index, own = pickle.loads(left["index"].iloc[0]), right["query_id"].to_numpy()
        q = np.stack(right["embedding"].to_numpy())
        s = unit_queries(q)
        at, scores = index.nearest(q, s, own, k)
        r, c = np.nonzero(scores > -np.inf)
        return pd.DataFrame({"query_id": own[r], "vec_id": index.ids[at[r, c]], "score": scores[r, c]})

    found = copies.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInPandas(find, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def unit_queries(q: np.ndarray) -> np.ndarray:
    """Queries of length 1 with a last component 0, for the scaled space."""
    s = q.astype(np.float64)
    s = s / np.abs(s).max(axis=1, keepdims=True)
    s = s / np.sqrt((s * s).sum(axis=1, keepdims=True))
    return np.concatenate([s, np.zeros((len(s), 1))], axis=1).astype(np.float32)
