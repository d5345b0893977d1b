import collections
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from shared import SF, against_duckdb
from llm.helpers import edge_docs, empty_docs, words
from pelorus.llm import substring
from pelorus.llm.queries import ORACLE_SQL, QUERIES
from pelorus.session import shared_folder


def brute(texts, window):
    split = [(t or "").encode().split() for t in texts]
    seen = collections.Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


@pytest.mark.parametrize(("window", "leaves"), [(5, 200_000), (20, 200_000), (18, 20)])
def test_equals_brute_force(spark, monkeypatch, window, leaves):
    monkeypatch.setattr(substring, "GROUP_LEAVES", leaves)
    rng = random.Random(window)
    shared = [words(rng, rng.randint(window - 2, 3 * window)) for _ in range(6)]
    texts = [" ".join(rng.choice([rng.choice(shared), words(rng, rng.randint(1, 30))]) for _ in range(rng.randint(0, 5))) for _ in range(60)]
    texts += [texts[3], texts[3], "go on " * 40, None, "", "one two"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substring.dedup(df, window).collect()}
    assert got == dict(enumerate(brute(texts, window)))


def test_edges(spark):
    docs = edge_docs(spark)
    got = sorted((r["doc_id"] or -1, r["n_words"], r["n_removed"], r["kept_text"]) for r in substring.dedup(docs, 2).collect())
    rows = docs.collect()
    assert got == sorted((d["doc_id"] or -1, *b) for d, b in zip(rows, brute([d["text"] for d in rows], 2), strict=True))
    assert substring.dedup(empty_docs(spark)).count() == 0


def test_same_rows_as_duckdb(spark):
    ours, theirs = against_duckdb(spark, QUERIES["op2_substring_suffix_tree"], ORACLE_SQL["op2_substring_suffix_tree"], SF)
    assert ours == theirs


def test_pieces_of_the_tree():
    h = np.random.default_rng(1).integers(1, 2**63, 50, dtype=np.uint64)
    for k in (1, 2, 7, 16, 35):
        want = [0] * (51 - k)
        for i in range(51 - k):
            for x in h[i : i + k].tolist():
                want[i] = (want[i] * substring._A + x) % 2**64
        assert substring.runs(h, k, substring._A).tolist() == want
        assert substring.sliding(h, k, np.minimum).tolist() == [min(h[i : i + k].tolist()) for i in range(51 - k)]
    high, low = np.array([1 << 32 | 1, 2 << 32, 1 << 32 | 1, 1 << 32 | 1, 1 << 32 | 7], dtype=np.uint64), np.array([5, 5, 6, 5, 5], dtype=np.uint64)
    tree = substring.Tree(high, low)
    under = {d: set(tree.order[tree.below(d)].tolist()) for d in (1, 2, 3, 4)}
    assert under == {1: {0, 2, 3, 4}, 2: {0, 2, 3}, 3: {0, 2, 3}, 4: {0, 3}}
    assert [(tree.order[a], tree.order[b]) for a, b in zip(*tree.nodes(4), strict=True)] == [(0, 3)]
    assert len(substring.Tree(high[:0], low[:0]).below(4)) == 0 and not substring.Tree(high[:1], low[:1]).below(4).any()


def test_prefixes_get_longer_where_leaves_are_many(spark, monkeypatch):
    monkeypatch.setattr(substring, "GROUP_LEAVES", 30)
    rng = np.random.default_rng(2)
    leaves = np.zeros(600, dtype=substring.LEAF)
    leaves["high"] = rng.integers(0, 2**63, 600, dtype=np.uint64)
    leaves["high"][:200] = (np.uint64(9) << np.uint64(56)) + np.arange(200, dtype=np.uint64) % np.uint64(8)  # differ in the eighth byte
    leaves["high"][200:250], leaves["low"][200:250] = 7, 7  # one window
    first = (leaves["high"] >> np.uint64(56)).astype(int)
    found = spark.createDataFrame([(int(p), int((first == p).sum()), substring.packed(leaves[first == p])) for p in np.unique(first)], "prefix int, n long, data binary")
    names = substring.prefixes(found)
    paths = [p.ljust(16, b"\0") for p in substring.path_bytes(leaves).tolist()]
    below = [sum(p.startswith(n) for p in paths) for n in names]
    assert sum(below) == 600 and all(k <= 30 or len(n) == 16 for k, n in zip(below, names, strict=True))
    assert {len(n) for n in names} >= {1, 8, 16}


def test_rows_that_repeat_share_their_spans(spark):
    text = words(random.Random(3), 60)
    df = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.lit(text).alias("text")).repartition(3)
    got = substring.dedup(df, 35).groupBy("n_words", "n_removed", "kept_text").count().collect()
    assert [tuple(r) for r in got] == [(60, 60, "", 3000)]
    n, most = spark.read.parquet(sorted(Path(shared_folder(spark)).glob("pelorus-spans-*"), key=lambda p: p.stat().st_mtime)[-1].as_uri()).agg(F.count("*"), F.max(F.size("spans"))).first()
    assert n == 1 and most <= 26
