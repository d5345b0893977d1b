import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm.helpers import DOCS, edge_docs, empty_docs, words
from pelorus.llm import mixing


def test_targets():
    assert mixing.targets({"a": 100, "b": 100, None: 100}) == pytest.approx({"a": 200.0, "b": 250 / 3, None: 500 / 3})
    got = mixing.targets({"x": 10, "y": 1000, "z": 0})
    assert got == pytest.approx({"x": 20.0, "y": 1495.0, "z": 0.0}) and mixing.targets({}) == {}
    rng = random.Random(1)
    for _ in range(50):
        sizes = {f"s{i}": rng.randrange(0, 1000) for i in range(rng.randint(1, 12))}
        t = mixing.targets(sizes)
        assert sum(t.values()) == pytest.approx(1.5 * sum(sizes.values())) and all(t[s] <= 2 * sizes[s] + 1e-9 for s in sizes)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000])
def test_permutations(n):
    a = mixing.permute(np.arange(2 * n), n, "k")
    assert sorted(a[:n]) == sorted(a[n:]) == list(range(n))
    assert (mixing.permute(np.arange(n, 2 * n), n, "k") == a[n:]).all()
    if n > 60:
        assert (a[:n] != a[n:]).any() and (a[:n] != np.arange(n)).mean() > 0.9


def test_draws_add_up():
    d = mixing.draws([100, 0, 7], 8, 3)
    assert d.sum(axis=0).tolist() == [100, 0, 7] and (d >= 0).all() and max(d.sum(axis=1)) - min(d.sum(axis=1)) <= 1
    big = mixing.draws([2 * 10**9, 10**9], 4, 3)
    assert big.sum(axis=0).tolist() == [2 * 10**9, 10**9]


def corpus(spark):
    rng = random.Random(9)
    rows = [(i, words(rng, rng.choice([0, 3, 50, 400])), "en", rng.choice(["a", "a", "a", "b", "c", None]), 0) for i in range(120)]
    return spark.createDataFrame(rows + rows[:3], DOCS).repartition(3, "doc_id")


def test_mix(spark):
    docs = corpus(spark).withColumn("uid", F.lit("clash")).withColumn("src", F.lit(1))
    rows = mixing.mix(docs, block=16).collect()
    assert len(rows) == 123
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
        assert r["taken"] <= 2 * r["size"]
    goals = mixing.targets({s: sum(r["size"] for r in own) for s, own in by.items()})
    for s, own in by.items():
        assert own[0]["source_size"] == sum(r["size"] for r in own) and own[0]["target"] == pytest.approx(goals[s])
        assert abs(sum(r["taken"] for r in own) - goals[s]) <= 16 + 1
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, mixing.mix(docs.repartition(5), block=16).collect())) == sorted(map(key, rows))


def test_mixed_texts_hold_what_the_mix_takes(spark):
    docs = corpus(spark)
    taken, got = mixing.mix(docs, block=16).collect(), mixing.mixed_texts(docs, block=16)
    assert got.columns == docs.columns
    count = lambda rows, n: {s: sum(n(r) for r in rows if r["source"] == s) for s in ("a", "b", "c", None)}
    rows = got.collect()
    assert count(rows, lambda r: len(r["text"].split())) == count(taken, lambda r: r["taken"])
    source = {r["doc_id"]: r["text"].split() for r in docs.collect()}
    assert all(r["n_chars"] == len(r["text"]) and set(r["text"].split()) <= set(source[r["doc_id"]]) for r in rows)


@pytest.mark.parametrize("shards", [1, 5])
def test_blocks_come_by_shard_and_slot_as_drawn(spark, shards):
    docs = corpus(spark)
    taken, blocks = mixing.mix(docs, block=16, shards=shards).collect(), mixing.mixed_blocks(docs, block=16, shards=shards)
    rows = blocks.collect()
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
    assert len(by) == shards and all([r["slot"] for r in own] == list(range(len(own))) for own in by.values())
    sizes = {s: sum(r["size"] for r in taken if r["source"] == s) for s in ("a", "b", "c", None)}
    n, goals = {s: -(-size // 16) for s, size in sizes.items()}, mixing.targets(sizes)
    drawn = mixing.draws([round(goals[s] * n[s] / sizes[s]) for s in sizes], shards, 17)
    assert [[sum(r["source"] == s for r in by[k]) for s in sizes] for k in range(shards)] == drawn.tolist()
    for s in sizes:
        assert sum(len(r["text"].split()) for r in rows if r["source"] == s) == sum(r["taken"] for r in taken if r["source"] == s)
        assert all(len(r["text"].split()) <= 16 for r in rows)
    words_ = {w for r in docs.collect() for w in r["text"].split()}
    assert {w for r in rows for w in r["text"].split()} <= words_ and len({r["source"] for r in by[0][:20]}) > 2
    again = mixing.mixed_blocks(docs.repartition(4), block=16, shards=shards).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    assert mixing.mixed_blocks(empty_docs(spark)).count() == 0 and mixing.mixed_blocks(edge_docs(spark), block=4).count() > 0


def test_edges(spark):
    rows = mixing.mix(edge_docs(spark), block=4).collect()
    assert sorted((r["doc_id"] or -1, r["size"]) for r in rows) == [(-1, 3), (1, 0), (2, 0), (3, 0), (4, 2), (4, 2), (5, 9000), (6, 60), (7, 3), (8, 6)]
    assert mixing.mix(empty_docs(spark)).count() == 0 and mixing.mixed_texts(empty_docs(spark)).count() == 0
    assert mixing.mixed_texts(edge_docs(spark), block=4).columns == edge_docs(spark).columns
