import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shared import SF, against_duckdb
from pelorus.llm import ann, embedding_dedup, graphsearch
from pelorus.llm.queries import ORACLE_SQL, QUERIES

BAD = [(900, None, 1), (901, [0.0] * 8, 1), (902, [math.nan] + [1.0] * 7, 1), (903, [math.inf] + [1.0] * 7, 1), (904, [None] + [1.0] * 7, 1), (905, [], 1), (906, [1.0, 2.0], 1)]


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"node": F.lit("x"), "shard": F.lit("x"), "rank": F.lit(0)})


def points(rng, n, groups, dim=8):
    out = []
    for i in range(n):
        v = rng.standard_normal(dim)
        if groups and i % 2:
            v = np.random.default_rng(i % groups).standard_normal(dim) * rng.uniform(0.5, 2) + 0.05 * v
        out.append((i * 3, v.astype(np.float32).tolist(), int(rng.integers(0, 2))))
    return out


def link_brute(rows, threshold):
    good = {i: np.array(v, dtype=np.float64) for i, (_, v, label) in enumerate(rows) if v and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in good:
        for j in good:
            if i < j and rows[i][2] == rows[j][2] and len(good[i]) == len(good[j]) and good[i] @ good[j] / math.sqrt((good[i] @ good[i]) * (good[j] @ good[j])) >= threshold:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                parent[a] = b
    least = {}
    for i, (k, _, _) in enumerate(rows):
        least.setdefault(find(i), []).append(k)
    return [(k, links[i], min(least[find(i)])) for i, (k, _, _) in enumerate(rows)]


@pytest.mark.parametrize(("shard", "beam"), [(20_000, 64), (60, 4)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, shard, beam):
    monkeypatch.setattr(embedding_dedup, "SHARD_NODES", shard)
    monkeypatch.setattr(embedding_dedup, "FIRST_BEAM", beam)
    rows = points(np.random.default_rng(5), 240, 9)
    rows += [(1000 + i, v, label) for i, (_, v, label) in enumerate(rows[:5])] + [rows[7], (1100, rows[9][1], None)] + BAD
    got = sorted(tuple(r) for r in embedding_dedup.near_duplicates(table(spark, rows)).select("vec_id", "n_links", "component_id").collect())
    assert got == sorted(link_brute(rows, 0.98))


class Blind:
    """An index whose search finds all of the group of 300, and of any other node only itself."""

    def __init__(self, vectors):
        self.vectors = vectors

    def search(self, queries, beam):
        s = (queries @ self.vectors.T).astype(np.float32)
        hot = s[:, 0] > 0.99
        s[~hot] = np.where(s[~hot] > 0.9999, s[~hot], -1)
        ids = np.argsort(-s, axis=1, kind="stable")[:, :beam]
        return ids, np.take_along_axis(s, ids, axis=1)


@pytest.mark.parametrize("hot", [0, 300, 900])
def test_audit_sees_small_groups_beside_a_hot_one(hot):
    rng = np.random.default_rng(11)
    v = rng.standard_normal((1500, 32))
    v[:hot] = v[0] + 0.01 * v[:hot]
    v[1001::2] = v[1000::2] + 0.1 * rng.standard_normal((250, 32))
    v = embedding_dedup.unit(v)
    r, c = embedding_dedup.near(Blind(v.astype(np.float32)), v, 0.98, np.arange(1500))
    got, want = set(zip(r.tolist(), c.tolist(), strict=True)), np.argwhere(v @ v.T >= 0.98).tolist()
    assert len(want) > 1900 and got >= {(a, b) for a, b in want}


def test_labels_of_any_type_and_rows_without_id(spark):
    v = [1.0, 2.0, 0.5]
    rows = [(1, v, "a"), (2, [x * 2 for x in v], "a"), (None, v, "a"), (3, v, "b"), (2**40, v, "b")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")
    got = sorted(tuple(r) for r in embedding_dedup.near_duplicates(df).collect() if r["vec_id"] is not None)
    assert got == [(1, 1, 1, True), (2, 1, 1, False), (3, 1, 3, True), (2**40, 1, 3, False)]
    assert [tuple(r) for r in embedding_dedup.near_duplicates(df).where("vec_id is null").collect()] == [(None, 0, None, None)]


def test_no_vectors(spark):
    assert embedding_dedup.near_duplicates(table(spark, [])).count() == 0 and ann.search(table(spark, []), lambda v: v % 2 == 0).count() == 0
    assert ann.search(table(spark, BAD[:6]), lambda v: v % 2 == 0).count() == 0
    assert embedding_dedup.near_duplicates(table(spark, BAD)).where("n_links > 0 or not kept").count() == 0


def nearest_brute(rows, k, step):
    good = [(i, np.array(v, dtype=np.float64)) for i, v, _ in rows if v and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    good = list({i: (i, v) for i, v in good}.values())
    out = {}
    for q, v in good:
        if q % step == 0:
            s = [(-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good if i != q]
            out[q] = [(i, -x) for x, i in sorted(s)[:k]]
    return out


def test_search_on_small_tables_is_exact(spark):
    rows = points(np.random.default_rng(6), 150, 4) + [(2000 + i, [1.0] * 8, 0) for i in range(40)] + [(2001, [1.0] * 8, 0)] + BAD
    got = {}
    for r in ann.search(table(spark, rows), lambda v: v % 5 == 0, k=7).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = nearest_brute(rows, 7, 5)
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}
    assert all(a[1] == pytest.approx(b[1], abs=1e-12) for q in got for a, b in zip(got[q], want[q], strict=True))
    few = ann.search(table(spark, rows[:3]), lambda v: v == 0, k=7)
    assert few.count() == 2


def test_search_in_graphs_reaches_the_recall(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_NODES", 1500)
    rng = np.random.default_rng(7)
    v = rng.standard_normal((4000, 32)).astype(np.float32)
    v[1::4] = v[0] + 0.2 * v[1::4]
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v * rng.uniform(0.5, 1.5, (4000, 1)).astype(np.float32))]
    v = np.array([r[1] for r in rows], dtype=np.float32).astype(np.float64)
    got = {}
    for r in ann.search(table(spark, rows), lambda c: c % 40 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in range(0, 4000, 40):
        s = v @ v[q]
        s[q] = -np.inf
        hits += len(got[q] & set(np.argsort(-s)[:20].tolist()))
    assert hits / 2000 >= 0.9


def test_search_needs_the_graph():
    rng = np.random.default_rng(12)
    v = rng.standard_normal((6000, 24))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    scaled, n = np.concatenate([v, np.zeros((6000, 1))], axis=1), 6000
    near = np.argsort(-(v @ v.T), axis=1)[:, 1:21]
    far = rng.integers(0, n, near.shape)

    def looked_at(nbr):
        """Share of the queries' nearest found with a narrow beam."""
        node = np.repeat(np.arange(n), 20)
        index = ann.Index(np.arange(n), v, scaled, node, nbr.ravel(), (v[node] * v[nbr.ravel()]).sum(axis=1))
        enter = np.broadcast_to(np.arange(0, n, 100), (100, 60))
        ids, _ = graphsearch.beam_search(index.scaled, index.graph, index.scaled[:100], enter, 32)
        return np.mean([len(set(a) & set(b)) / 20 for a, b in zip(ids, near, strict=False)])

    assert looked_at(near) > 0.95 and looked_at(far) < 0.4


def test_descent_betters_the_graph(spark):
    rng = np.random.default_rng(13)
    v = rng.standard_normal((2000, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    nodes = spark.createDataFrame([(0, i, h) for i, h in enumerate(ann._halves(v))], "shard int, node long, half binary").cache()
    near = np.argsort(-(v @ v.T), axis=1)[:, 1:21]
    recall = lambda g: np.mean([len({r["nbr"] for r in rows} & set(near[i])) / 20 for i, rows in enumerate(lists(g))])

    def lists(graph):
        out = [[] for _ in range(2000)]
        for r in graph.collect():
            out[r["node"]].append(r)
        return out

    first = ann.keep_best(ann.start(nodes, 4), 3).cache()
    second = ann.descend(nodes, first, 3).cache()
    third = ann.descend(nodes, second, 3)
    a, b, c = recall(first), recall(second), recall(third)
    assert b > a + 0.1 and c > b and 0 < second.where("new").count() < second.count()
    nodes.unpersist()


def test_layers_find_neighbours():
    rng = np.random.default_rng(8)
    v = rng.standard_normal((3000, 24)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    index = graphsearch.Layers(v)
    ids, _ = index.search(v[:200], 128)
    best = np.argsort(-(v[:200] @ v.T), axis=1)[:, :10]
    assert np.mean([len(set(a[:10]) & set(b)) for a, b in zip(ids, best, strict=True)]) / 10 > 0.95
    assert graphsearch.Layers(np.zeros((0, 4), dtype=np.float32)).search(v[:2, :4], 5)[0].shape == (2, 0)


def test_forest_spans():
    rng = random.Random(3)
    a = np.array([rng.randrange(60) for _ in range(50)])
    b = np.array([rng.randrange(60) for _ in range(50)])
    f = embedding_dedup.forest(a, b)
    root = dict(f.tolist())
    assert all(root.get(x, x) == root.get(y, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)) and len(f) < len(set(a) | set(b))


@pytest.mark.parametrize("name", ["op6_ann_nn_descent", "op8_embedding_hnsw"])
def test_same_rows_as_duckdb(spark, name):
    ours, theirs = against_duckdb(spark, QUERIES[name], ORACLE_SQL[name], SF)
    assert ours == theirs
