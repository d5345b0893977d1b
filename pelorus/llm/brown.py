"""Language-model scores from class-based bigrams with exchange clustering.

    P(word | word before) = P(class | class before) * P(word | class)

All counts cover the whole training corpus. The most frequent words (the core)
are put into classes by exchange clustering: each word in turn moves to the
class that raises the likelihood of the class bigrams most. All other words of
the head then join the class of the largest gain by their own followers and
leaders, which are counted over the whole corpus, and move again, all at once,
as long as the likelihood rises. Words beyond the head, unseen ones included,
are the class of rare words. Transitions are Witten-Bell interpolated with
class shares, and rare words' emissions leave one share to the unseen, so that
probabilities sum to one.

Counts of the head (``HEAD`` words) fit in every worker and are looked up
there. Counts of rare words are as many as the corpus has words; a document's
rare words meet them in a join. As hot words are all in the head, that join has
no hot keys.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelorus.llm.common import drop, in_arrow, portions, stage

#: Words with counts in every worker; of these, words that are clustered; classes of them; sweeps.
HEAD, CORE, CLASSES, SWEEPS = 65_536, 1500, 80, 3
#: Distinct words that a task counts before it hands them on; counts of pairs that it holds before it adds them up.
FLUSH, PAIRS = 300_000, 1_000_000
#: Tasks that move head words.
MOVERS = 24
END = b""


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _texts(batch: pa.RecordBatch, column: int) -> list[list[bytes]]:
    return [_words(t) for t in batch.column(column).to_pylist()]


def count_words(docs: DataFrame) -> DataFrame:
    """(w, c): how often each word occurs in ``docs`` (text); END once a document."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), type=pa.binary()), pa.array(list(seen.values()), type=pa.int64())], names=["w", "c"])

        for batch in portions(batches, 0):
            for words in _texts(batch, 0):
                seen.update(words)
            seen[END] += batch.num_rows
            if len(seen) > FLUSH:
                yield out()
                seen.clear()
        yield out()

    return in_arrow(docs.select("text"), count, "w binary, c long").groupBy("w").agg(F.sum("c").alias("c"))


def _plogp(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(bigrams: np.ndarray, words: int, classes: int, sweeps: int) -> np.ndarray:
    """Class of each symbol. The first ``words`` symbols are clustered, each other is a class of its own.

    ``bigrams``: counts of symbol pairs. Words start dealt to the classes by
    rank; a sweep takes them in order and ends the run if none has moved.
    """
    n = len(bigrams)
    classes = max(1, min(classes, words))
    of = np.concatenate([np.arange(words) % classes, classes + np.arange(n - words)]).astype(np.int64)
    total = classes + n - words
    by_class = np.zeros((n, total))
    np.add.at(by_class.T, of, bigrams.T)  # symbol -> class followers
    into = np.zeros((n, total))
    np.add.at(into.T, of, bigrams)  # class -> symbol, as seen by the symbol
    m = np.zeros((total, total))
    np.add.at(m, of, by_class)
    for _ in range(sweeps):
        moved = 0
        for w in range(words):
            a, own = of[w], bigrams[w, w]
            r, le = by_class[w].copy(), into[w].copy()
            r[a] -= own
            le[a] -= own
            m[a] -= r
            m[:, a] -= le
            m[a, a] -= own
            rows, cols = m[:classes], m[:, :classes]
            gain = (_plogp(rows + r) - _plogp(rows)).sum(axis=1) + (_plogp(cols + le[:, None]) - _plogp(cols)).sum(axis=0)
            d = np.arange(classes)
            diag = m[d, d]
            gain += _plogp(diag + r[:classes] + le[:classes] + own) - _plogp(diag + r[:classes]) - _plogp(diag + le[:classes]) + _plogp(diag)
            out, inn = rows.sum(axis=1), cols.sum(axis=0)
            gain -= _plogp(out + r.sum() + own) - _plogp(out) + _plogp(inn + le.sum() + own) - _plogp(inn)
            b = int(gain.argmax()) if gain.max() > gain[a] + 1e-9 else int(a)
            m[b] += r
            m[:, b] += le
            m[b, b] += own
            if b != a:
                moved += 1
                of[w] = b
                followers, leaders = bigrams[:, w], bigrams[w]
                by_class[:, a] -= followers
                by_class[:, b] += followers
                into[:, a] -= leaders
                into[:, b] += leaders
        if not moved:
            break
    return of


@dataclass
class Model:
    """What a worker needs to score texts, and the totals for rare words."""

    head: dict[bytes, int]
    count: np.ndarray  # of each head word
    klass: np.ndarray  # class of each head word; END is the head's number 0
    rare: int  # class of all other words
    transition: np.ndarray  # log10 P(class | class before)
    emission: np.ndarray  # log10 P(word | class) of each head word
    tokens: int
    types: int
    rare_tokens: int
    rare_types: int


def _sum(code: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each code once, and the sum of its times."""
    order = np.argsort(code, kind="stable")
    code = code[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(code)), dtype=bool), code[1:] != code[:-1]]))
    return code[first], np.add.reduceat(times[order], first) if len(first) else times


def _summed(batches: Iterator[pa.RecordBatch], key) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Codes that ``key`` makes of the rows (code, n), with their sums, about ``PAIRS`` rows at once."""
    codes, times, held = [], [], 0
    for batch in batches:
        code, n = key(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        codes.append(code)
        times.append(n)
        held += len(code)
        if held > PAIRS:
            code, n = _sum(np.concatenate(codes), np.concatenate(times))
            codes, times, held = [], [], 0
            yield code, n
    if held:
        yield _sum(np.concatenate(codes), np.concatenate(times))


def _square(pairs: DataFrame, of: np.ndarray, n: int) -> np.ndarray:
    """Counts (n x n) of pairs of groups; ``of``: group of each word."""
    width = len(of)
    shared = pairs.sparkSession.sparkContext.broadcast(of)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for code, times in _summed(batches, lambda c, t: (own[c // width] * n + own[c % width], t)):
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(times)], names=["code", "n"])

    table = pairs.mapInArrow(fold, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(n * n)
    out[table.column(0).to_numpy()] = table.column(1).to_numpy()
    return out.reshape(n, n)


def likelihood(m: np.ndarray) -> float:
    """Log-likelihood of the class bigrams ``m``, but for what no assignment changes."""
    return float(_plogp(m).sum() - _plogp(m.sum(axis=0)).sum() - _plogp(m.sum(axis=1)).sum())


def gains(m: np.ndarray, classes: int, a: np.ndarray, word: np.ndarray, k: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Gain of log-likelihood (word x class) when a word, taken out of its class ``a``, joins each of the first ``classes``.

    m: class bigrams. Entries: ``word`` has ``n`` followers of class k, leaders
    of class k - len(m), or pairs with itself (k = 2 len(m), in both others too).
    """
    size, width = len(a), len(m)
    dense = np.zeros((size, 2 * width + 1))
    dense[word, k] = n
    own, at = dense[:, -1].copy(), np.arange(size)
    dense[at, a] -= own
    dense[at, width + a] -= own
    r, le = dense[:, :width], dense[:, width:-1]
    mine = (a[:, None] == np.arange(classes)).astype(float)
    out = np.zeros((size, classes))
    for own_side, other, square in ((r, le, m), (le, r, m.T)):
        w, c = np.nonzero(own_side)
        for lo in range(0, len(w), 20_000):
            i, j = w[lo : lo + 20_000], c[lo : lo + 20_000]
            times = own_side[i, j][:, None]
            x = square[:classes, j].T - mine[i] * times
            x -= (j == a[i])[:, None] * (other[i][:, :classes] + mine[i] * own[i][:, None])
            first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
            out[i[first]] += np.add.reduceat(_plogp(x + times) - _plogp(x), first, axis=0)
        total = own_side.sum(axis=1) + own
        left = square.sum(axis=1)[:classes] - mine * total[:, None]
        out -= _plogp(left + total[:, None]) - _plogp(left)
    r, le = r[:, :classes], le[:, :classes]
    d = np.diag(m)[:classes] - mine * (r + le + own[:, None])
    return out + _plogp(d + r + le + own[:, None]) - _plogp(d + r) - _plogp(d + le) + _plogp(d)


def _moved(pairs: DataFrame, of: np.ndarray, m: np.ndarray, classes: int, lo: int, hi: int) -> np.ndarray:
    """Classes after each of the words lo..hi-1 has moved to the class of its largest gain, all others being where they are."""
    width, kinds = len(of), 2 * len(m) + 1
    shared = pairs.sparkSession.sparkContext.broadcast((of, m))

    def contexts(code: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own, square = shared.value
        x, y = code // width, code % width
        w = np.concatenate([x, y, x[x == y]])
        k = np.concatenate([own[y], len(square) + own[x], np.full(int((x == y).sum()), kinds - 1)])
        some = (w >= lo) & (w < hi)
        return w[some] * kinds + k[some], np.concatenate([times, times, times[x == y]])[some]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for code, times in _summed(batches, contexts):
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(times), pa.array(code // kinds)], names=["code", "n", "w"])

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, square = shared.value
        code, times = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        for c, t in _summed(batches, lambda c, t: (c, t)):
            code, times = _sum(np.concatenate([code, c]), np.concatenate([times, t]))
        words, word = np.unique(code // kinds, return_inverse=True)
        for start in range(0, len(words), 500):
            some = slice(*np.searchsorted(word, [start, start + 500]))
            a = own[words[start : start + 500]]
            gain = gains(square, classes, a, word[some] - start, code[some] % kinds, times[some])
            best, at = gain.argmax(axis=1), np.arange(len(a))
            stays = (a < classes) & (gain[at, best] <= gain[at, np.minimum(a, classes - 1)] + 1e-9)
            yield pa.RecordBatch.from_arrays([pa.array(words[start : start + 500]), pa.array(np.where(stays, a, best))], names=["w", "class"])

    table = pairs.mapInArrow(split, "code long, n long, w long").repartition(MOVERS, "w").select("code", "n").mapInArrow(move, "w long, class long").toArrow()
    out = of.copy()
    out[table.column(0).to_numpy()] = table.column(1).to_numpy()
    return out


def assign(pairs: DataFrame, of: np.ndarray, classes: int, lo: int, hi: int, sweeps: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all words, and the class bigrams, when the words lo..hi-1 have moved.

    pairs: (code, n), code = word * len(of) + next word. ``of``: first classes;
    words lo..hi-1 are in none of the first ``classes`` but the last of all.
    Sweeps end when the likelihood no longer rises.
    """
    n = int(of.max()) + 1
    m = _square(pairs, of, n)
    for turn in range(sweeps if hi > lo else 0):
        new = _moved(pairs, of, m, classes, lo, hi)
        if (new == of).all():
            break
        square = _square(pairs, new, n)
        if turn and likelihood(square) <= likelihood(m):
            break
        of, m = new, square
    return of, m


def train(docs: DataFrame, head: int = HEAD, core: int = CORE, classes: int = CLASSES, sweeps: int = SWEEPS) -> tuple[Model, DataFrame]:
    """The model and the stored table of all word counts. ``docs``: text."""
    spark = docs.sparkSession
    counts = stage(count_words(docs).where("c > 0"), "word-counts")
    sums = counts.agg(F.count("*").alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    top = counts.where(F.length("w") > 0).orderBy(F.desc("c"), "w").limit(head - 1).collect()
    ends = counts.where(F.length("w") == 0).collect()
    words = [END, *(bytes(r["w"]) for r in top)]
    count = np.array([ends[0]["c"] if ends else 0, *(r["c"] for r in top)], dtype=np.int64)
    number = {w: i for i, w in enumerate(words)}
    rare = len(words)
    width = rare + 1
    shared = spark.sparkContext.broadcast(number)

    def bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        for batch in portions(batches, 0):
            flat = [0]
            for ws in _texts(batch, 0):
                flat += [get(w, rare) for w in ws]
                flat.append(0)
            s = np.array(flat)
            code, times = np.unique(s[:-1] * width + s[1:], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(times)], names=["code", "n"])

    pairs = stage(in_arrow(docs.select("text"), bigrams, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")), "word-pairs")
    # symbols: the core's words, END, rare words, the head's other words
    core = min(core, len(words) - 1)
    symbol = np.concatenate([[core], np.arange(core), np.full(len(words) - 1 - core, core + 2), [core + 1]]).astype(np.int64)
    first = exchange(_square(pairs, symbol, core + 3), core, classes, sweeps)
    of, m = assign(pairs, first[symbol], max(1, min(classes, core)), core + 1, len(words), sweeps)
    drop(pairs)
    klass, rare_class = of[:rare], int(of[rare])
    k = rare_class + 1
    m = m[:k, :k]
    share = (m.sum(axis=0) + 1) / (m.sum() + k)
    kinds = (m > 0).sum(axis=1, keepdims=True)
    whole = m.sum(axis=1, keepdims=True)
    smooth = np.where(whole > 0, (m + kinds * share) / np.maximum(whole + kinds, 1), share)
    size = np.bincount(klass, weights=count, minlength=k)
    with np.errstate(divide="ignore"):
        emission = np.where(count > 0, np.log10(np.maximum(count, 1) / np.maximum(size[klass], 1)), 0.0)
    in_head = int(count.sum())
    model = Model(number, count, klass, rare_class, np.log10(smooth), emission, int(sums["n"]), int(sums["v"]), int(sums["n"]) - in_head, int(sums["v"]) - int((count > 0).sum()))
    return model, counts


def score(docs: DataFrame, model: Model, counts: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Add n_tokens, n_known, train_tokens, base_score and score to the ``keep`` columns.

    A text's tokens are its words, A-Z lower-cased, and one end. Null and
    empty texts are the end alone. base_score is the add-one unigram's log10
    probability, score the class model's. Repeated rows are scored each; an
    empty training set makes every base token certain (log10 1) and spreads the
    model's belief evenly over its classes. A row out for each row in.
    """
    cols = list(keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        get = own.head.get
        klass = np.append(own.klass, own.rare)
        emission, plus = np.append(own.emission, 0.0), np.append(np.log10(own.count + 1.0), 0.0)
        known = np.append(own.count > 0, False)
        for batch in portions(batches, len(cols)):
            at = len(cols)
            tokens, head_known, base, score_, tail, times, sizes = ([] for _ in range(7))
            for ws in _texts(batch, at):
                ids = np.array([get(w, -1) for w in ws] + [0])
                c = klass[np.concatenate([[0], ids])]
                tokens.append(len(ids))
                head_known.append(int(known[ids].sum()))
                base.append(float(plus[ids].sum()))
                score_.append(float(own.transition[c[:-1], c[1:]].sum() + emission[ids].sum()))
                rare = Counter([ws[i] for i in np.flatnonzero(ids < 0)])
                tail.extend(rare)
                times.extend(rare.values())
                sizes.append(len(rare))
            offsets = np.zeros(len(sizes) + 1, dtype=np.int32)
            np.cumsum(sizes, out=offsets[1:])
            entries = pa.StructArray.from_arrays([pa.array(tail, type=pa.binary()), pa.array(times, type=pa.int32())], names=["w", "n"])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(at)), batch.column(at + 1), pa.array(tokens, type=pa.int64()), pa.array(head_known, type=pa.int64()), pa.array(base, type=pa.float64()), pa.array(score_, type=pa.float64()), pa.ListArray.from_arrays(pa.array(offsets), entries)],
                names=[*cols, "uid", "n_tokens", "head_known", "base", "part", "rare"],
            )

    base = docs.select(*cols, F.col("text").alias("__text"), F.monotonically_increasing_id().alias("uid"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[: len(cols)])
    rows = stage(in_arrow(base, parts, fields + ", uid long, n_tokens long, head_known long, base double, part double, rare array<struct<w:binary,n:int>>"), "lm-parts")
    asked = rows.select("uid", F.explode("rare").alias("r")).select("uid", "r.w", "r.n")
    met = asked.hint("merge").join(counts, "w").groupBy("uid").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("plus"), F.sum("n").alias("seen"))
    n_rare = F.aggregate("rare", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    rows = rows.select(*cols, "uid", "n_tokens", "head_known", "base", "part", n_rare.alias("n_rare"))
    out = rows.hint("merge").join(met, "uid", "left")
    plus, seen = F.coalesce("plus", F.lit(0.0)), F.coalesce("seen", F.lit(0))
    all_, rare_all = float(np.log10(model.tokens + model.types + 1)), float(np.log10(model.rare_tokens + model.rare_types + 1))
    return out.select(
        *cols, "n_tokens", (F.col("head_known") + seen).cast("long").alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + plus - F.col("n_tokens") * all_).alias("base_score"), (F.col("part") + plus - F.col("n_rare") * rare_all).alias("score"),
    )
