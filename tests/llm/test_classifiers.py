import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shared import SF
from llm.helpers import edge_docs, empty_docs, words
from pelorus.llm import language_id, toxicity
from pelorus.llm.queries import QUERIES


def brute_counts(text):
    out, word = collections.Counter(), []
    low = "".join(chr(language_id.letters()[ord(c)]) or "\0" for c in text or "")
    for word in (w for w in low.replace("\0", " ").split(" ") if w):
        padded = "\0" + word + "\0"
        for n in (1, 2, 3):
            for i in range(len(padded) - n + 1):
                g = padded[i : i + n]
                if (n == 1 and g != "\0") or n == 2 or (n == 3 and g[1] != "\0"):
                    out[g] += 1
    return out


def code(gram):
    points = [2**21 - 1] * (3 - len(gram)) + [ord(c) for c in gram]
    return (points[0] << 42) | (points[1] << 21) | points[2]


TEXTS = ["Hello, hello wörld!", "", None, "123", "a", "ßtraße İstanbul ΣΑΣ", "one  two\n\nthree " * 50, "漢字 かな", "x" * 300, "mot à mot"]


@pytest.mark.parametrize("block", [1_000_000, 40])
def test_counts_equal_brute_force(monkeypatch, block):
    monkeypatch.setattr(language_id, "BLOCK_CHARS", block)
    got = collections.defaultdict(collections.Counter)
    for row, codes, n in language_id.count_ngrams(TEXTS):
        for r, c, k in zip(row.tolist(), codes.tolist(), n.tolist(), strict=True):
            got[r][c] += k
    for i, t in enumerate(TEXTS):
        if block == 40 and t and len(t) > 80:
            continue  # cut inside words: checked by its letters alone
        assert dict(got[i]) == {code(g): n for g, n in brute_counts(t).items()}, t


def test_distances_equal_brute_force():
    profiles = {lang: [code(g) for g, _ in sorted(brute_counts(t).items(), key=lambda x: (-x[1], code(x[0])))[:20]] for lang, t in (("xx", TEXTS[6]), ("yy", TEXTS[5] * 2 + TEXTS[0]))}
    judge = language_id.Profiles(profiles, 20)
    far = judge.distances(TEXTS)
    for i, t in enumerate(TEXTS):
        top = sorted(((code(g), n) for g, n in brute_counts(t).items()), key=lambda x: (-x[1], x[0]))[:20]
        for k, lang in enumerate(judge.langs):
            ranks = {c: r for r, c in enumerate(profiles[lang])}
            want = sum(abs(ranks[c] - r) if c in ranks else 20 for r, (c, _) in enumerate(top)) / (20 * len(top)) if top else None
            assert (want is None and np.isnan(far[i, k])) or far[i, k] == pytest.approx(want)


def test_language_edges(spark):
    docs = edge_docs(spark)
    profiles = language_id.train(docs)
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in language_id.identify(docs, profiles).collect()]
    assert sorted(k or -1 for k, _, _ in got) == [-1, 1, 2, 3, 4, 4, 5, 6, 7, 8]
    assert all((lang == "und") == (k in (1, 2, 3, 7)) and 0 <= s <= 1 for k, lang, s in got)
    assert language_id.train(empty_docs(spark)) == {} and language_id.identify(empty_docs(spark), profiles).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(docs, {}).collect()} == {"und"}
    kept = language_id.keep_known(docs, profiles)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 4, 4, 5, 6, 8]
    assert language_id.keep_known(docs, {}).count() == 6


def test_language_accuracy(spark):
    sf = SF.replace("0.001", "0.01")
    got = QUERIES["op9_language_rank_order"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97


def test_foreign_text_is_rejected(spark):
    docs = spark.createDataFrame([(i, words(random.Random(i), 50), "en") for i in range(20)] + [(99, "Съешь же ещё этих мягких французских булок", "en")], "doc_id long, text string, lang string")
    profiles = language_id.train(docs.where("doc_id < 20"))
    assert sorted(r["doc_id"] for r in language_id.keep_known(docs, profiles).collect()) == list(range(20))


def toxic_corpus(spark, n=1500):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.15
        w = words(rng, rng.randint(5, 80), 70).split()
        for _ in range(rng.randint(2, 4) if toxic else 0):
            w[rng.randrange(len(w))] = rng.choice(("vilefoo", "vilebar", "grotty"))
        rows.append((i, " ".join(w)))
        if rng.random() < 0.6:
            labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), rows


def test_toxicity_on_held_out_texts(spark):
    docs, labels, rows = toxic_corpus(spark)
    model = toxicity.train(docs.where("doc_id % 5 <> 0"), labels.where("doc_id % 5 <> 0"))
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    truth = {i: any(w in t for w in ("vile", "grotty")) for i, t in rows if i % 5 == 0}
    caught = [got[i]["predicted"] for i, bad in truth.items() if bad]
    wrong = [got[i]["predicted"] for i, bad in truth.items() if not bad]
    assert np.mean(caught) > 0.9 and np.mean(wrong) < 0.02
    assert all((r["score"] >= 0.5) == (r["predicted"] == 1) for r in got.values())


def test_risk_is_held_at_zero():
    one = [np.array([0, 1])] * 40
    model = toxicity.fit(one, one * 3 + [np.array([2])] * 60, 0.5, passes=200)
    assert model.score(np.array([0, 1])) > 0.5 > model.score(np.array([2]))
    assert toxicity.fit([], one, 0.5).score(np.array([0])) < 1e-9 and toxicity.fit(one, [], 0.5).score(np.array([0])) < 1e-9


def test_toxicity_edges(spark):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(5, 1), (6, 0), (6, 0), (77, 1), (None, 1), (4, None)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(got) == 10 and all(0 <= r["score"] <= 1 for r in got)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["predicted"] for r in toxicity.score(docs, toxicity.train(docs, none)).collect()} == {0}
    assert toxicity.score(empty_docs(spark), toxicity.train(empty_docs(spark), labels)).count() == 0


def test_toxicity_is_fitted_on_twenty_thousand_texts():
    import inspect

    fitted = inspect.signature(toxicity.train).parameters
    assert (fitted["positives"].default, fitted["unlabelled"].default) == (6000, 14_000)
