import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shared import SF, against_duckdb
from llm.helpers import edge_docs, empty_docs, words
from pelorus.llm import graph, ngram_join
from pelorus.llm.graph import components
from pelorus.llm.queries import ORACLE_SQL, QUERIES


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


@pytest.mark.parametrize(("seed", "one_task"), [(0, 500_000), (1, 0), (0, 0)])
def test_components(spark, monkeypatch, seed, one_task):
    monkeypatch.setattr(graph, "ONE_TASK", one_task)
    rng = random.Random(seed)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    parent = list(range(400))
    for a, b in edges:
        a, b = find(parent, a), find(parent, b)
        parent[max(a, b)] = min(a, b)
    want = {x: find(parent, x) for a, b in edges for x in (a, b) if a != b}
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def shingle_set(text, width):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute(rows, width, num, den):
    parent = list(range(len(rows)))
    sets = [shingle_set(t, width) for _, t in rows]
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                x, y = find(parent, i), find(parent, j)
                parent[max(x, y)] = min(x, y)
    least = {}
    for i, (k, _) in enumerate(rows):
        least.setdefault(find(parent, i), []).append(k)
    return [(k, len(s), min([x for x in least[find(parent, i)] if x is not None], default=None)) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True))]


def family(rng, n, size, edits):
    base = words(rng, size, 70).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = rng.choice(("alpha", "beta", "gamma"))
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("width", "num", "block", "pivots", "best"), [(3, 90, 1024, 2, 2), (5, 80, 4, 2, 2), (5, 80, 4, 0, 0), (5, 80, 1024, 1, 0)])
def test_equals_brute_force(spark, monkeypatch, width, num, block, pivots, best):
    for name, value in (("BLOCK_SETS", block), ("PIVOT_ROUNDS", pivots), ("BEST_ROUNDS", best)):
        monkeypatch.setattr(ngram_join, name, value)
    rng = random.Random(num + width)
    texts = [t for size, edits in ((12, 1), (40, 2), (150, 6), (400, 12)) for t in family(rng, 14, size, edits)]
    texts += [words(rng, rng.randint(1, 80), 70) for _ in range(20)] + texts[:4] + [t.upper() for t in texts[20:23]] + ["", None, "  ", "one", "one", "ONE", "one two"]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(df, width, num, 100).collect())
    assert got == brute(rows, width, num, 100)


def test_edges(spark):
    rows = [(r["doc_id"], r["text"]) for r in edge_docs(spark).collect()]
    key = lambda t: tuple(-1 if x is None else x for x in t)
    got = sorted(key(r) for r in ngram_join.near_duplicates(edge_docs(spark)).collect())
    assert got == sorted(key(r) for r in brute(rows, 5, 80, 100))
    assert ngram_join.near_duplicates(empty_docs(spark)).count() == 0


def test_one_of_each_group_stays(spark):
    rng = random.Random(8)
    texts = family(rng, 8, 60, 1) + [words(rng, 30, 70) for _ in range(5)]
    rows = list(enumerate(texts)) + [(3, texts[3]), (11, texts[11]), (50, None), (51, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("root", F.lit("x")).withColumn("t", F.lit("y"))
    got = ngram_join.deduplicate(df)
    want = sorted({c for k, n, c in brute(rows, 5, 80, 100)})
    assert got.columns == df.columns and sorted(r["doc_id"] for r in got.collect()) == want
    assert ngram_join.deduplicate(edge_docs(spark)).count() == 9
    assert ngram_join.deduplicate(empty_docs(spark)).count() == 0


def test_bands_never_part_similar_sizes():
    for num in (80, 90):
        bands = ngram_join.Bands(num, 100)
        for a in range(1, 400):
            for b in range(a, 400):
                if a * 100 >= b * num:
                    shared = set(bands.of(a)) & set(bands.of(b))
                    assert any(m > (a + b) * (100 - num) // (100 + num) for _, m in shared), (a, b)


def unlike(rng, n, size):
    """Documents of which no two share a shingle of five words."""
    return [" ".join(f"w{rng.randrange(10**9)}" for _ in range(size)) for _ in range(n)]


def test_sets_unlike_each_other_meet_in_no_tile():
    rng, bands = random.Random(4), ngram_join.Bands(80, 100)
    for n in (100, 1000):
        sets = list(ngram_join.shingle_sets([t.encode() for t in unlike(rng, n, 60)], 5, ngram_join.WordHashes()))
        keys = [k for s in sets for k in ngram_join.tile_keys(s, bands).tolist()]
        assert len(set(keys)) == len(keys)


@pytest.mark.parametrize("num", [80, 90])
def test_similar_sets_share_a_tile(num):
    rng, bands = np.random.default_rng(num), ngram_join.Bands(num, 100)
    for n in [*range(1, 40), 64, 100, 333, 1000]:
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            cut = rng.integers(0, n - -(-n * num // 100) + 1)  # elements left out
            b = rng.permutation(a)[cut:]
            more = int((len(b) * 100 // num - len(a)) * rng.random()) if len(b) * 100 // num > len(a) else 0
            b = np.unique(np.concatenate([b, rng.integers(0, 2**64, more, dtype=np.uint64)]))
            if 100 * len(np.intersect1d(a, b)) >= num * len(np.union1d(a, b)):
                assert np.intersect1d(ngram_join.tile_keys(a, bands), ngram_join.tile_keys(b, bands)).size, (n, cut, more)


def test_few_sets_exceed_the_slack():
    rng = np.random.default_rng(5)
    for num in (80, 90):
        bands = ngram_join.Bands(num, 100)
        for n in (3, 8, 20, 60, 200, 800):
            band, m = bands.of(n)[0]
            over = sum(m - len(np.unique(rng.integers(0, m, n))) > bands.slack(band) for _ in range(2000))
            assert over <= 2, (num, n, over)


def test_same_rows_as_duckdb(spark):
    ours, theirs = against_duckdb(spark, QUERIES["op5_ngram_jaccard"], ORACLE_SQL["op5_ngram_jaccard"], SF)
    assert ours == theirs
