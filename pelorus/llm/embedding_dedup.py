"""Near-duplicate embeddings by hierarchical navigable small-world graphs, one for each shard.

Equal vectors of a label are one node with a weight, gathered before anything
else moves. A label's nodes are dealt to shards of bounded size by a hash, each
shard gets its graph, and every node is searched for in every shard of its
label. A beam is widened while its last entry is still within the threshold.
The block's other queries are audited against all of the shard's vectors, each
query counting alike, and all of them are widened while their recall is too
low. Candidates are verified by their cosine in double precision.

Links are counted where they are found. Only a spanning forest of a task's
links leaves it, so that a group of n near copies sends n rows, not n squared.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelorus.llm.common import stage
from pelorus.llm.graph import components, least_reachable
from pelorus.llm.graphsearch import Layers, valid_vector

#: Nodes of a shard and of a block of queries, about.
SHARD_NODES, BLOCK_QUERIES = 20_000, 2048
DEGREE, BUILD_BEAM, FIRST_BEAM = 16, 64, 64
#: Queries of a block that are audited, and the recall they must reach.
AUDITED, LEAST_RECALL = 48, 0.99


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows over their lengths, safe for very large and very small components."""
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each pair of rows, in double precision."""
    dot, x, y = ((p * q).sum(axis=1) for p, q in ((a, b), (a, a), (b, b)))
    return dot / np.sqrt(x * y)


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edges (node, least node of its component) of the graph with edges a-b, for nodes other than the least."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = least_reachable(at[: len(a)], at[len(a) :], len(nodes))
    rest = np.flatnonzero(root != np.arange(len(nodes)))
    return np.stack([nodes[rest], nodes[root[rest]]], axis=1)


def near(index: Layers, queries: np.ndarray, threshold: float, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) pairs that the graph finds within the threshold, a little below it included. own: the queries' own nodes, -1 where they have none here."""
    low, n = np.float32(threshold - 1e-4), len(index.vectors)
    own = np.full(len(queries), -1) if own is None else own
    todo, beam, rows, nodes = np.arange(len(queries)), min(FIRST_BEAM, n), [], []
    while len(todo):
        ids, scores = index.search(queries[todo], beam)
        # beams that end within the threshold are widened; the others are audited among themselves
        ends = np.flatnonzero(scores[:, -1] < low)
        sample = ends[np.unique(np.linspace(0, len(ends) - 1, min(AUDITED, len(ends))).astype(int))]
        if recall(index, queries[todo[sample]], own[todo[sample]], ids[sample], scores[sample], low) >= LEAST_RECALL:
            r, c = np.nonzero(scores[ends] >= low)
            rows.append(todo[ends[r]])
            nodes.append(ids[ends[r], c])
            todo = np.delete(todo, ends)
        beam *= 4
        if DEGREE * beam >= n:  # it would open most of the graph
            break
    for lo in range(0, len(todo), 256):
        r, c = np.nonzero(queries[todo[lo : lo + 256]].astype(np.float32) @ index.vectors.T >= low)
        rows.append(todo[lo + r])
        nodes.append(c)
    r, c = np.concatenate([np.empty(0, dtype=np.int64), *rows]), np.concatenate([np.empty(0, dtype=np.int64), *nodes])
    order = np.argsort(r, kind="stable")
    return r[order], c[order]


def recall(index: Layers, queries: np.ndarray, own: np.ndarray, ids: np.ndarray, scores: np.ndarray, low: float) -> float:
    """Mean share of a query's links that were found, the query itself left out; 1 if none has a link."""
    truth = queries.astype(np.float32) @ index.vectors.T >= low
    here = np.flatnonzero(own >= 0)
    truth[here, own[here]] = False
    hit = np.zeros_like(truth)
    r, c = np.nonzero(scores >= low)
    hit[r, ids[r, c]] = True
    some = truth.any(axis=1)
    return float(((hit & truth)[some].sum(axis=1) / truth[some].sum(axis=1)).mean()) if some.any() else 1.0


def near_duplicates(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors`` (vec_id, embedding, label).

    Two rows link when their labels are equal and not null and the cosine of
    their vectors is ``threshold`` or more. n_links counts the other rows linked
    directly; component_id is the smallest vec_id reachable, the row's own
    included; kept tells whether that is the row itself. Rows whose vec_id or label is
    null or whose vector is null, empty, zero or not finite link with nothing (without vec_id, component_id and kept
    are null); vectors of different lengths do not link; repeated rows link with each
    other. Labels may be of any type that can be compared. An empty table gives no rows; other columns are not read.
    """
    rows = vectors.select("vec_id", "embedding", "label")
    kind = rows.schema["label"].dataType.simpleString()
    takes_part = valid_vector("embedding") & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    nodes = rows.where(takes_part).groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("weight"))
    nodes = stage(nodes.withColumn("dim", F.size("embedding")), "nodes")
    sizes = nodes.groupBy("label", "dim").agg(F.count("*").alias("n"))
    sizes = sizes.select("label", "dim", F.ceil(F.col("n") / SHARD_NODES).cast("int").alias("shards"), F.ceil(F.col("n") / BLOCK_QUERIES).cast("int").alias("blocks"))
    dealt = nodes.join(sizes, ["label", "dim"])
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("node"), F.col("shards")).cast("int")).withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        v = np.stack(pdf["embedding"].to_numpy())
        index = Layers(unit(v), DEGREE, BUILD_BEAM)
        blob = pickle.dumps((index, v, pdf["node"].to_numpy(), pdf["weight"].to_numpy()), protocol=5)
        return pd.DataFrame({c: [pdf[c].iloc[0]] for c in ("label", "dim", "shard", "blocks")} | {"index": [blob]})

    indexes = stage(dealt.select("label", "dim", "shard", "blocks", "node", "weight", "embedding").groupBy("label", "dim", "shard").applyInPandas(build, f"label {kind}, dim int, shard int, blocks int, index binary"), "indexes")
    asked = dealt.select("label", "dim", "block", "node", "embedding", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    copies = indexes.select("label", "dim", "shard", "index", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))

    def search(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"node": [], "to": [], "links": []})
        index, v, ids, weight = pickle.loads(left["index"].iloc[0])
        own, q = right["node"].to_numpy(), np.stack(right["embedding"].to_numpy())
        at = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
        r, c = near(index, unit(q), threshold, np.where(ids[at] == own, at, -1))
        keep = own[r] != ids[c]
        r, c = r[keep], c[keep]
        true = np.concatenate([cosines(q[r[i : i + 200_000]].astype(np.float64), v[c[i : i + 200_000]].astype(np.float64)) >= threshold for i in range(0, len(r), 200_000)]) if len(r) else np.empty(0, dtype=bool)
        r, c = r[true], c[true]
        links = np.bincount(r, weights=weight[c], minlength=len(own)).astype(np.int64)
        edges = forest(own[r], ids[c])
        some = np.flatnonzero(links)
        return pd.DataFrame({"node": np.concatenate([own[some], edges[:, 0]]), "to": np.concatenate([own[some], edges[:, 1]]), "links": np.concatenate([links[some], np.zeros(len(edges), dtype=np.int64)])})

    keys = ["label", "dim", "shard", "block"]
    found = stage(copies.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(search, "node long, to long, links long"), "found")
    roots = components(found.where("node <> to").select(F.col("node").alias("a"), F.col("to").alias("b")))
    links = found.where("links > 0").groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.select("label", "embedding", "node", "weight").join(links, "node", "left").join(roots.withColumnRenamed("root", "component_id"), "node", "left")
    named = named.select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "node").alias("component_id"))
    named = named.withColumnsRenamed({"label": "__label", "embedding": "__embedding"})
    out = rows.join(named, F.col("vec_id").isNotNull() & (F.col("label") == F.col("__label")) & (F.col("embedding") == F.col("__embedding")), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
