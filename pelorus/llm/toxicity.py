"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over words and word beginnings, trained with numpy on
texts confirmed to be toxic and on unlabelled texts. The unlabelled texts hold
toxic ones too, as many as the class prior says, so their loss as negatives is
corrected by what the positives would add; where the corrected risk falls
below zero it is held at zero, which keeps the model from fitting the
unlabelled texts that are toxic.

    risk = prior * loss(P, +) + max(0, loss(U, -) - prior * loss(P, -))
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelorus.llm.common import in_arrow, portions

#: Hashed features.
DIM = 1 << 18
#: Lengths of word beginnings that are features besides the whole word.
STEMS = (4, 5, 6)
#: At most about so many texts are fitted on.
POSITIVES, UNLABELLED = 6000, 14_000
DEFAULT_PRIOR = 0.1
#: Words whose features a worker remembers.
REMEMBERED_WORDS = 500_000

_WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> tuple[int, ...]:
    """Hashed features of a word: itself and its beginnings."""
    parts = ["=" + word, *("^" + word[:k] for k in STEMS if len(word) >= k)]
    return tuple(zlib.crc32(p.encode("utf-8", "surrogatepass")) % DIM for p in parts)


class Featurizer:
    """Distinct features of a text, sorted."""

    def __init__(self):
        self.memory: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        found: set[int] = set()
        if len(self.memory) > REMEMBERED_WORDS:
            self.memory.clear()
        for w in set(_WORD.findall((text or "").lower())):
            f = self.memory.get(w)
            if f is None:
                f = self.memory[w] = word_features(w)
            found.update(f)
        return np.sort(np.fromiter(found, dtype=np.int32, count=len(found)))


@dataclass
class Model:
    """Weights of features and the bias; a text's margin is their sum."""

    weights: np.ndarray
    bias: float

    def score(self, features: np.ndarray) -> float:
        margin = self.bias + float(self.weights[features].sum())
        return float(1 / (1 + np.exp(-np.clip(margin, -40, 40))))


def telling(positive: list[np.ndarray], unlabelled: list[np.ndarray], least: float) -> np.ndarray:
    """Mask of features whose share among positives is ``least`` standard errors off that among unlabelled."""
    a, b = (np.bincount(np.concatenate(xs), minlength=DIM) for xs in (positive, unlabelled))
    n, m = len(positive), len(unlabelled)
    pooled = (a + b + 1) / (n + m + 2)
    return (np.abs(a / n - b / m) >= least * np.sqrt(pooled * (1 - pooled) * (1 / n + 1 / m))) & (a + b >= 3)


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, passes: int = 400, rate: float = 0.05, decay: float = 5e-4, batch: int = 2000, least: float = 4.0, discount: float = 0.1, lift: float = 1.5, seed: int = 5) -> Model:
    """Minimise the non-negative risk with Adam over mini-batches; logistic loss.

    Only telling features are fitted. If fewer unlabelled texts come out toxic
    than 0.85 of the prior, the bias is lifted towards that share, by ``lift``
    at most, and by less where under 1000 positives speak for it. Without positives or unlabelled texts the model calls
    nothing toxic.
    """
    full = np.zeros(DIM)
    if not positive or not unlabelled:
        return Model(full, -40.0)
    chosen = np.flatnonzero(telling(positive, unlabelled, least))
    place = np.full(DIM, -1)
    place[chosen] = np.arange(len(chosen))
    n = len(chosen) + 1  # the last is the bias
    rows = {k: [np.append(y[y >= 0], n - 1) for y in (place[x] for x in xs)] for k, xs in (("p", positive), ("u", unlabelled))}
    prior = float(np.clip(prior, 1e-3, 0.999))
    rng = np.random.default_rng(seed)
    weights, m, v = np.zeros(n), np.zeros(n), np.zeros(n)
    weights[-1] = np.log(prior / (1 - prior))
    steps = max(1, -(-len(unlabelled) // batch))
    per = max(1, -(-len(positive) // steps))
    t, turns = 0, max(1, passes // steps)
    for turn in range(turns):
        p_order, u_order = rng.permutation(len(rows["p"])), rng.permutation(len(rows["u"]))
        for s in range(steps):
            p = [rows["p"][i] for i in p_order[np.arange(s * per, (s + 1) * per) % len(p_order)]]
            u = [rows["u"][i] for i in u_order[s * batch : (s + 1) * batch]]
            flat, of = np.concatenate(p + u), np.repeat(np.arange(len(p) + len(u)), [len(x) for x in p + u])
            z = np.clip(np.bincount(of, weights=weights[flat], minlength=len(p) + len(u)), -40, 40)
            sigma, plus = 1 / (1 + np.exp(-z)), np.logaddexp(0, z)  # plus: loss as a negative
            negative = plus[len(p) :].mean() - prior * plus[: len(p)].mean()
            if negative >= 0:
                g = np.concatenate([np.full(len(p), -prior / len(p)), sigma[len(p) :] / len(u)])
            else:  # climb back out of a risk below zero, by smaller steps
                g = discount * np.concatenate([prior * sigma[: len(p)] / len(p), -sigma[len(p) :] / len(u)])
            grad = np.bincount(flat, weights=g[of], minlength=n) + decay * np.append(weights[:-1], 0)
            t += 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            weights = weights - rate * (1 - turn / turns) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    full[chosen] = weights[:-1]
    margins = np.array([weights[x].sum() for x in rows["u"]])
    short = -float(np.quantile(margins, 1 - 0.85 * prior))
    return Model(full, float(weights[-1] + min(max(short, 0.0), lift * min(1.0, len(positive) / 1000))))


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, prior: float | None = None) -> Model:
    """Fit on about ``positives`` texts labelled toxic and ``unlabelled`` texts of any kind.

    ``docs``: doc_id, text; ``labels``: doc_id, toxic (1 or 0). Both samples
    are taken by a hash of the id, with one text of each id, and are all that
    reaches the driver, as feature numbers (``DIM`` at most of a text, however
    long). The prior is the share of toxic labels unless it is given; an id with
    several labels is toxic if one says so. Empty tables teach nothing.
    """
    marks = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = docs.select("doc_id").join(marks, "doc_id")
    seen = known.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    total = docs.count()
    if prior is None:
        prior = seen["toxic"] / seen["n"] if seen["n"] else DEFAULT_PRIOR
    million = 1_000_000
    draw = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(million))
    toxic = marks.where((F.col("toxic") == 1) & (draw < round(million * min(1.0, positives / max(1, seen["toxic"]))))).select("doc_id", F.lit(1).alias("kind"))
    # about ``positives`` ids whatever the input's size, so that no text moves for them
    pos = docs.select("doc_id", "text").join(F.broadcast(toxic), "doc_id")
    any_ = docs.select("doc_id", "text", F.lit(0).alias("kind")).where(F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(million)) < round(million * min(1.0, unlabelled / max(1, total))))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Featurizer()
        for batch in portions(batches, 1):
            rows = [of(t).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, type=pa.binary())], names=["doc_id", "kind", "features"])

    sample = pos.unionByName(any_).groupBy("doc_id", "kind").agg(F.min("text").alias("text")).select("doc_id", "text", "kind")
    rows = in_arrow(sample, features, "doc_id long, kind int, features binary").collect()
    rows.sort(key=lambda r: (r["kind"], r["doc_id"] if r["doc_id"] is not None else -1, bytes(r["features"])))
    of_kind = {k: [np.frombuffer(r["features"], dtype=np.int32) for r in rows if r["kind"] == k] for k in (0, 1)}
    return fit(of_kind[1], of_kind[0], prior)


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Add score (0..1) and predicted (1 if score >= 0.5) to the ``keep`` columns; only text is judged.

    Null and empty texts get the score of a text without features; one row
    out for each row in, repeated rows included.
    """
    cols = list(keep)
    sparse = np.flatnonzero(model.weights)
    values, bias = model.weights[sparse], model.bias

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros(DIM)
        weights[sparse] = values
        of, own = Featurizer(), Model(weights, bias)
        for batch in portions(batches, len(cols)):
            s = np.array([own.score(of(t)) for t in batch.column(len(cols)).to_pylist()], dtype=float)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(cols))), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*cols, "score", "predicted"])

    base = docs.select(*cols, F.col("text").alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[:-1])
    return in_arrow(base, judge, fields + ", score double, predicted int")
