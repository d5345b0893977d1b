import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shared import SF
from llm.helpers import edge_docs, empty_docs, words
from pelorus.llm import brown
from pelorus.llm.queries import QUERIES


def test_probabilities_sum_to_one(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(i, words(rng, rng.randint(0, 60), 70)) for i in range(80)], "doc_id long, text string")
    model, counts = brown.train(df, head=40, core=20, classes=5)
    assert np.allclose((10**model.transition).sum(axis=1), 1)
    c = Counter(w for r in df.collect() for w in r["text"].lower().split())
    rare = [n for w, n in c.items() if w.encode() not in model.head]
    assert len(rare) == model.rare_types and sum(rare) == model.rare_tokens and len(rare) > 5
    per_class = np.bincount(model.klass, weights=10**model.emission, minlength=len(model.transition))
    per_class[model.rare] += (sum(n + 1 for n in rare) + 1) / (sum(rare) + len(rare) + 1)
    assert np.allclose(per_class[per_class > 0], 1)
    assert counts.agg(F.sum("c")).first()[0] == sum(c.values()) + 80


def test_exchange_finds_classes():
    rng = np.random.default_rng(3)
    kind = np.arange(30) % 3
    bigrams = rng.poisson(0.2, (31, 31)).astype(float)
    for a in range(30):
        for b in range(30):
            bigrams[a, b] += rng.poisson(20) if (kind[a] + 1) % 3 == kind[b] else 0
    of = brown.exchange(bigrams, 30, 3, 10)
    assert all(len(set(of[:30][kind == k])) == 1 for k in range(3)) and len(set(of[:30])) == 3 and of[30] == 3


def test_gains_are_those_of_the_likelihood():
    rng = np.random.default_rng(5)
    big = rng.poisson(0.4, (30, 30)).astype(float)
    of = np.concatenate([rng.integers(0, 4, 26), [4, 5, 6, 6]])
    square = lambda c: np.eye(7)[c].T @ big @ np.eye(7)[c]
    word, k, n = [], [], []
    for w in range(30):
        for kind, values in ((0, np.bincount(of, big[w], 7)), (7, np.bincount(of, big[:, w], 7)), (14, big[w, w : w + 1])):
            for j in np.flatnonzero(values):
                word.append(w), k.append(kind + j), n.append(values[j])
    got = brown.gains(square(of), 4, of, np.array(word), np.array(k), np.array(n))
    for w in range(30):
        want = [brown.likelihood(square(np.where(np.arange(30) == w, b, of))) for b in range(4)]
        assert np.allclose(got[w] - got[w, 0], np.array(want) - want[0])


def test_head_words_beyond_the_core_join_the_class_of_their_contexts(spark):
    rng = random.Random(6)
    kinds = [[f"{c}{i}" for i in range(40)] for c in "xyz"]
    weights = [40 / (i + 1) for i in range(40)]
    texts = [" ".join(rng.choices(kinds[i % 3], weights)[0] for i in range(60)) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    model, _ = brown.train(df, core=9, classes=3, sweeps=5)
    assert len(model.head) == 121 and len(model.transition) == 5
    of = {w: model.klass[i] for w, i in model.head.items()}
    assert [len({of[w.encode()] for w in kind}) for kind in kinds] == [1, 1, 1] and len(set(of.values())) == 4


def test_score_equals_the_formula(spark):
    rng = random.Random(8)
    texts = [words(rng, rng.randint(0, 40), 60) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    model, counts = brown.train(df, head=25, core=12, classes=4)
    of = lambda w: int(model.klass[model.head[w]]) if w in model.head else model.rare
    tokens = lambda t: [w.encode() for w in t.split()] + [b""]
    seen, m = Counter(), np.zeros((model.rare + 1,) * 2)
    for t in texts:
        seen.update(tokens(t))
        for a, b in zip([b"", *tokens(t)], tokens(t), strict=False):
            m[of(a), of(b)] += 1
    rare = {w: n for w, n in seen.items() if w not in model.head}
    size = Counter()
    for w in model.head:
        size[of(w)] += seen[w]

    def p(before, w):
        a, b = of(before), of(w)
        share = (m[:, b].sum() + 1) / (m.sum() + len(m))
        kinds, whole = (m[a] > 0).sum(), m[a].sum()
        step = (m[a, b] + kinds * share) / (whole + kinds) if whole else share
        return step * (seen[w] / size[b] if w in model.head else (rare.get(w, 0) + 1) / (sum(rare.values()) + len(rare) + 1))

    asked = [*texts[:20], "", "unseen " + texts[0], texts[1] + " more unseen words"]
    got = brown.score(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model, counts).collect()
    want = {i: sum(math.log10(p(a, b)) for a, b in zip([b"", *tokens(t)], tokens(t), strict=False)) for i, t in enumerate(asked)}
    assert {r["doc_id"]: r["score"] for r in got} == pytest.approx(want, abs=1e-9)


def test_edges_and_base(spark):
    docs = edge_docs(spark)
    train = docs.where("doc_id < 6")
    model, counts = brown.train(train)
    got = brown.score(docs, model, counts).collect()
    c = Counter()
    for r in train.collect():
        c.update((r["text"] or "").encode().lower().split())
        c[b""] += 1
    n, v = sum(c.values()), len(c)
    want = []
    for r in docs.collect():
        tokens = (r["text"] or "").encode().lower().split() + [b""]
        want.append((r["doc_id"] or -1, len(tokens), sum(c[t] > 0 for t in tokens), round(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in tokens), 6)))
    assert sorted((r["doc_id"] or -1, r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == sorted(want)
    assert all(math.isfinite(r["score"]) and r["score"] <= 1e-9 and r["train_tokens"] == n for r in got)


def test_nothing_to_learn_from_and_nothing_to_score(spark):
    model, counts = brown.train(empty_docs(spark))
    got = brown.score(edge_docs(spark), model, counts).collect()
    assert len(got) == 10 and all(r["base_score"] == pytest.approx(0) and math.isfinite(r["score"]) for r in got)
    assert brown.score(empty_docs(spark), model, counts).count() == 0


def test_better_than_the_base_on_held_out_texts(spark):
    got = QUERIES["op3_brown_classes"](spark, SF.replace("0.001", "0.01")).groupBy("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).collect()
    assert len(got) == 2 and all(r["s"] > r["b"] for r in got)
