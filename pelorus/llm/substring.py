"""Removal of word runs that occur more than once, by prefix-partitioned suffix trees.

A suffix here is the text from a word on, cut after ``window`` words: a run of
that length is repeated exactly when two suffixes share their whole path, that
is, when they hang below one internal node at full depth. A path is four
symbols, the hashes of consecutive runs of words (nine each for a window of
35), so that a tree needs 16 bytes a suffix instead of a text.

1. Anchors. Every window has one word run of ``ANCHOR`` words chosen by its
   content alone (the one with the least hash), so equal windows choose equal
   runs. Runs that occur once in the whole corpus rule out all windows which
   chose them. Only a tenth of the positions is an anchor, so this first count
   is small, and it leaves only suffixes that are likely to be repeated.
2. Each map task builds the tree of its own suffixes. Windows that are repeated
   there are settled at once, and one leaf stands for all of them from then
   on: no leaf of a very common window is sent more than once a batch.
3. Leaves are dealt to groups by a prefix of their path. Prefixes differ in
   length: the leaves below each are counted, and a prefix with too many is
   replaced by those that are a byte longer, again and again, so that groups fit
   in memory. At full length all leaves of a prefix are one window.
4. Each group builds its tree out of the sorted paths and their common prefix
   lengths. Leaves below an internal node at full depth are repeated; starts
   that follow each other make up a maximal repeat.

What is removed is the union of the repeated windows, judged on the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelorus.llm.common import KeyFilter, WordHashes, drop, in_arrow, mixed, portions, stage

#: Words in an anchor; symbols of a path; leaves of a group at most, about.
ANCHOR, SYMBOLS, GROUP_LEAVES = 16, 4, 200_000

_A, _B = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03
ASKS, STANDS_FOR_MANY = 1, 2
#: A leaf's row: its document's id and text hash, its start, its path (two symbols in ``high``, two in ``low``), and whether it asks.
LEAF = np.dtype([("k", "<i8"), ("t", "<i8"), ("start", "<i4"), ("high", "<u8"), ("low", "<u8"), ("kind", "u1")])


def runs(h: np.ndarray, k: int, base: int) -> np.ndarray:
    """Polynomial hash of the ``k`` numbers from each place on, put together from runs of powers of two."""
    n = max(0, len(h) - k + 1)
    out, done, part, size = np.zeros(n, dtype=np.uint64), 0, h, 1
    while size <= k:
        if k & size:
            out = out * np.uint64(pow(base, size, 1 << 64)) + part[done : done + n]
            done += size
        if 2 * size <= k:
            part = part[: len(part) - size] * np.uint64(pow(base, size, 1 << 64)) + part[size:]
        size *= 2
    return out


def sliding(x: np.ndarray, k: int, best: np.ufunc) -> np.ndarray:
    """``best`` (np.minimum or np.maximum) of the ``k`` numbers from each place on."""
    size = 1
    while 2 * size <= k:
        x = best(x[: len(x) - size], x[size:])
        size *= 2
    return best(x[: len(x) - (k - size)], x[k - size :]) if k > size else x


class Windows:
    """The windows of a run of texts laid end to end, with their anchors."""

    def __init__(self, texts: list[bytes], window: int, hashes: WordHashes):
        words = [t.split() for t in texts]
        self.window = window
        self.lengths = np.array([len(w) for w in words], dtype=np.int64)
        self.h = np.concatenate([hashes.of(w) for w in words]) if words else np.empty(0, dtype=np.uint64)
        self.row = np.repeat(np.arange(len(words)), self.lengths)
        ends = np.cumsum(self.lengths)
        self.first = ends - self.lengths
        anchor = min(ANCHOR, window)
        self.span = window - anchor + 1
        n = max(0, len(self.h) - window + 1)
        self.anchor = mixed(runs(self.h, anchor, _A)) if n else np.empty(0, dtype=np.uint64)
        self.inside = np.arange(n) + window <= ends[self.row[:n]]
        #: starts of windows that lie in one text
        self.at = np.flatnonzero(self.inside)
        self.least = sliding(self.anchor, self.span, np.minimum) if n else self.anchor

    def anchors(self) -> np.ndarray:
        """Hashes at the places that are least in some window."""
        if not len(self.at):
            return np.empty(0, dtype=np.int64)
        edge = np.zeros(self.span - 1, dtype=np.uint64)
        around = np.concatenate([edge, np.where(self.inside, self.least, np.uint64(0)), edge])
        return self.anchor[sliding(around, self.span, np.maximum) == self.anchor].view(np.int64)

    def paths(self, known: KeyFilter) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the windows whose anchor may be repeated, and their paths."""
        none = np.empty(0, dtype=np.uint64)
        if not len(self.at):
            return self.at, none, none
        at = self.at[known.has(self.least[self.at].view(np.int64))]
        h, size = mixed(self.h ^ np.uint64(_B)), -(-self.window // SYMBOLS)
        symbols: list[np.ndarray] = []
        whole = runs(h, size, _B)
        for i in range(SYMBOLS):
            n = min(size, max(0, self.window - i * size))  # a short window's last symbols are empty
            part = (whole if n == size else runs(h, n, _B))[at + i * size] if n else np.zeros(len(at), dtype=np.uint64)
            symbols.append(mixed(part + np.uint64(n)) >> np.uint64(32))
        return at, (symbols[0] << np.uint64(32)) | symbols[1], (symbols[2] << np.uint64(32)) | symbols[3]


class Tree:
    """Suffix tree of paths, as the order of its leaves and the symbols that neighbours share."""

    def __init__(self, high: np.ndarray, low: np.ndarray):
        self.order = np.lexsort((low, high))
        a, b = high[self.order], low[self.order]
        half = np.uint64(32)
        one, two = a[1:] >> half == a[:-1] >> half, a[1:] == a[:-1]
        three, four = two & (b[1:] >> half == b[:-1] >> half), two & (b[1:] == b[:-1])
        self.shared = np.sum([one, two, three, four], axis=0, dtype=np.int8) if len(a) else np.empty(0, dtype=np.int8)

    def nodes(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last leaf, as places in ``order``, below each internal node that has ``depth`` symbols on its path or more."""
        inside = np.concatenate([[False], self.shared >= depth, [False]])
        return np.flatnonzero(~inside[:-1] & inside[1:]), np.flatnonzero(inside[:-1] & ~inside[1:])

    def below(self, depth: int) -> np.ndarray:
        """Mask over ``order``: the leaf hangs below such a node."""
        first, last = self.nodes(depth)
        turn = np.zeros(len(self.order) + 1, dtype=np.int64)
        turn[first] += 1
        turn[last + 1] -= 1
        return np.cumsum(turn[:-1]) > 0


def path_bytes(leaves: np.ndarray) -> np.ndarray:
    """Paths as 16 bytes, in the order of the paths."""
    both = np.stack([leaves["high"], leaves["low"]], axis=1).astype(">u8")
    return np.ascontiguousarray(both).view("S16").ravel()


def packed(leaves: np.ndarray) -> bytes:
    """Leaves as bytes, field by field, which compresses better than row by row."""
    return b"".join(np.ascontiguousarray(leaves[f]).tobytes() for f in LEAF.names)


def unpacked(data: bytes) -> np.ndarray:
    n = len(data) // LEAF.itemsize
    out, at = np.empty(n, dtype=LEAF), 0
    for f in LEAF.names:
        size = LEAF[f].itemsize * n
        out[f] = np.frombuffer(data[at : at + size], dtype=LEAF[f])
        at += size
    return out


def new_run(*columns: np.ndarray) -> np.ndarray:
    """Places where a run of starts begins: another document, or a gap in the starts (the last column)."""
    if not len(columns[0]):
        return np.empty(0, dtype=np.int64)
    change = columns[-1][1:] > columns[-1][:-1] + 1
    for c in columns[:-1]:
        change |= c[1:] != c[:-1]
    return np.flatnonzero(np.concatenate([[True], change]))


def _bytes(batch: pa.RecordBatch) -> list[bytes]:
    """The texts (first column) as UTF-8; null is empty."""
    return [t or b"" for t in batch.column(0).cast(pa.binary()).to_pylist()]


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the row's key: the id (nulls as the least number) and a hash of the text."""
    return docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(2**63))).alias("k"), F.xxhash64("text").alias("t"))


def repeated_anchors(docs: DataFrame, window: int) -> KeyFilter:
    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in portions(batches, 0):
            keys, n = np.unique(Windows(_bytes(batch), window, hashes).anchors(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([keys, keys[n > 1]]))], names=["key"])

    counted = in_arrow(docs.select("text"), anchors, "key long").groupBy("key").agg(F.count("*").alias("n"))
    keys = stage(counted.where("n > 1").select("key"), "anchors")
    out = KeyFilter.build(keys)
    drop(keys)
    return out


def leaves(docs: DataFrame, window: int, known: KeyFilter) -> DataFrame:
    """All suffixes that may be repeated, after each task's own tree: (prefix, n, data).

    A row holds a block's leaves below one prefix of a byte. Runs of starts of
    windows which the block settles itself come with prefix -1, in the same
    form: start, and in ``low`` the run's length.
    """
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def local_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, filter_ = WordHashes(), shared.value
        for batch in portions(batches, 0):
            k, t = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            w = Windows(_bytes(batch), window, hashes)
            at, high, low = w.paths(filter_)
            tree = Tree(high, low)
            below = tree.below(SYMBOLS)
            alone, many, one = tree.order[~below], tree.order[below], tree.order[tree.nodes(SYMBOLS)[0]]
            sent = np.concatenate([alone, one])
            rows = np.empty(len(sent), dtype=LEAF)
            doc = w.row[at[sent]]
            rows["k"], rows["t"], rows["start"] = k[doc], t[doc], at[sent] - w.first[doc]
            rows["high"], rows["low"], rows["kind"] = high[sent], low[sent], np.repeat([ASKS, STANDS_FOR_MANY], [len(alone), len(one)])
            rows = rows[np.lexsort((rows["start"], rows["t"], rows["k"], rows["high"] >> np.uint64(56)))]
            prefix = rows["high"] >> np.uint64(56)
            cuts = np.append(np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]])) if len(rows) else np.empty(0, dtype=np.int64), len(rows))
            settled = np.sort(at[many])
            doc = w.row[settled]
            cut = new_run(doc, settled)
            own = np.zeros(len(cut), dtype=LEAF)
            own["k"], own["t"], own["start"] = k[doc[cut]], t[doc[cut]], settled[cut] - w.first[doc[cut]]
            own["low"] = np.diff(np.append(cut, len(settled)))
            parts = [rows[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)] + [own]
            names = [*(prefix[cuts[:-1]].tolist() if len(rows) else []), -1]
            yield pa.RecordBatch.from_arrays([pa.array(names, type=pa.int32()), pa.array([len(x) for x in parts], type=pa.int64()), pa.array([packed(x) for x in parts], type=pa.binary())], names=["prefix", "n", "data"])

    return in_arrow(_keyed(docs).select("text", "k", "t"), local_trees, "prefix int, n long, data binary")


def prefixes(found: DataFrame) -> list[bytes]:
    """Prefixes of paths, in order, that split the stored leaves into groups of ``GROUP_LEAVES`` at most.

    Starts from prefixes of a byte; those with more leaves are replaced by the
    next longer ones that occur, up to whole paths.
    """
    sizes = {bytes([r["prefix"]]): r["n"] for r in found.where("prefix >= 0").groupBy("prefix").agg(F.sum("n").alias("n")).collect()}
    done, length = [], 1
    while sizes:
        done += [p for p, n in sizes.items() if n <= GROUP_LEAVES or length == 16]
        full = {p for p, n in sizes.items() if n > GROUP_LEAVES and length < 16}
        if not full:
            break
        length += 1

        def longer(batches: Iterator[pa.RecordBatch], full: set[bytes] = full, length: int = length) -> Iterator[pa.RecordBatch]:
            known = np.array(sorted(full), dtype=f"S{length - 1}")
            for batch in batches:
                for d in batch.column(0).to_pylist():
                    paths = path_bytes(unpacked(d))
                    paths = paths[np.isin(paths.astype(f"S{length - 1}"), known)]
                    names, n = np.unique(paths.astype(f"S{length}"), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([x.ljust(length, b"\0") for x in names.tolist()], type=pa.binary()), pa.array(n.astype(np.int64))], names=["p", "n"])

        some = found.where(F.col("prefix").isin(sorted({p[0] for p in full}))).select("data")
        sizes = {bytes(r["p"]): r["n"] for r in in_arrow(some, longer, "p binary, n long").groupBy("p").agg(F.sum("n").alias("n")).collect()}
    return sorted(done)


def repeated(found: DataFrame) -> DataFrame:
    """(k, t, start, n): runs of starts of repeated windows, out of stored leaves."""
    names = prefixes(found)
    own = {p[0]: i for i, p in enumerate(names) if len(p) == 1}
    first = np.array([p.ljust(16, b"\0") for p in names], dtype="S16")

    def lengthen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups, data = [], []
            for prefix, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if prefix in own:
                    groups.append(own[prefix])
                    data.append(d)
                else:
                    rows = unpacked(d)
                    part = np.searchsorted(first, path_bytes(rows), side="right") - 1
                    for i in np.unique(part).tolist():
                        groups.append(i)
                        data.append(packed(rows[part == i]))
            yield pa.RecordBatch.from_arrays([pa.array(groups, type=pa.int64()), pa.array(data, type=pa.binary())], names=["grp", "data"])

    def tree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_group: dict[int, list[bytes]] = {}
        for batch in batches:
            for g, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_group.setdefault(g, []).append(d)
        for g in list(by_group):
            rows = np.concatenate([unpacked(d) for d in by_group.pop(g)])
            own_tree = Tree(rows["high"], rows["low"])
            hit = rows[own_tree.order[own_tree.below(SYMBOLS)]]
            hit = hit[hit["kind"] == ASKS]
            hit = hit[np.lexsort((hit["start"], hit["t"], hit["k"]))]
            cut = new_run(hit["k"], hit["t"], hit["start"])  # rows that repeat id and text have equal starts
            last = np.append(cut[1:], len(hit)) - 1 if len(cut) else cut
            n = hit["start"][last] - hit["start"][cut] + 1
            yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(hit[f][cut])) for f in ("k", "t", "start")), pa.array(n.astype(np.int32))], names=["k", "t", "start", "n"])

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d in batch.column(0).to_pylist():
                rows = unpacked(d)
                yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(rows[f])) for f in ("k", "t", "start")), pa.array(rows["low"].astype(np.int32))], names=["k", "t", "start", "n"])

    schema = "k long, t long, start int, n int"
    total = found.where("prefix >= 0").agg(F.sum("n")).first()[0] or 0
    asked = in_arrow(found.where("prefix >= 0").select("prefix", "data"), lengthen, "grp long, data binary")
    tasks = max(1, min(len(names), max(12, -(-total // GROUP_LEAVES))))
    answered = in_arrow(asked.repartition(tasks, "grp"), tree, schema)
    return answered.unionByName(in_arrow(found.where("prefix < 0").select("data"), settled, schema))


def dedup(docs: DataFrame, window: int = 35) -> DataFrame:
    """Per document: doc_id, n_words, n_removed and kept_text, the kept words joined by one space.

    Words are runs of anything but ASCII white space. A word goes if a window
    of ``window`` words that covers it starts anywhere else as well, in the
    same document or another. Null, empty and short texts lose nothing (null:
    0 words and an empty kept_text); repeated rows are documents of their own
    and repeat each other, and share one list of spans; very long texts are
    taken whole; an empty table gives no rows. Columns other than
    doc_id and text are not read.
    """
    docs = docs.select("doc_id", "text")
    found = stage(leaves(docs, window, repeated_anchors(docs, window)), "leaves")
    spans = stage(repeated(found).groupBy("k", "t").agg(F.collect_set(F.struct("start", "n")).alias("spans")), "spans")
    drop(found)
    joined = _keyed(docs).hint("merge").join(spans, ["k", "t"], "left").select("doc_id", "text", F.col("spans.start").alias("starts"), F.col("spans.n").alias("ns"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 1):
            total, gone, kept = [], [], []
            for text, starts, ns in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                total.append(len(words))
                if starts.is_valid:
                    turn = np.zeros(len(words) + 1, dtype=np.int64)
                    begin = starts.values.to_numpy()
                    np.add.at(turn, begin, 1)
                    np.add.at(turn, begin + ns.values.to_numpy() - 1 + window, -1)
                    stay = np.flatnonzero(np.cumsum(turn[:-1]) == 0)
                    words = [words[i] for i in stay]
                gone.append(total[-1] - len(words))
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, type=pa.int64()), pa.array(gone, type=pa.int64()), pa.array(kept, type=pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    return in_arrow(joined, cut, "doc_id long, n_words long, n_removed long, kept_text string")
