"""Near-duplicate documents by an exact Jaccard join of word n-gram sets.

Sets fall into bands by size; sets that may be similar lie in one band or in
neighbouring ones. Similar sets differ in few elements: at similarity t, sets
of a and b elements differ in (a + b)(1 - t)/(1 + t) at most. A band's hash
space is cut into more ranges than that by a slack, so two similar sets agree
on all elements of more ranges than the slack. A tile is the sets of a band
that agree on a range which holds elements: a set with no more empty ranges
than the slack agrees with any similar one on such a range. The slack is so
chosen that hardly a set has more; one that has names its empty ranges too,
which finds the similar sets that also have more. No pair outside the tiles can
be similar, and most sets are alone in all of theirs.

Within tiles, every set carries a hashed bitmap. Elements of one set whose
bits the other lacks are certainly not shared, so bit counts bound the overlap
from above, and only pairs whose bound reaches the threshold are verified by
intersecting the sorted hash arrays.

Copies are one set. Large tiles are mostly copies with small changes, all like
each other. They are not paired out: tiles are cut into blocks, and every set is
verified against the pivot of its block first, which joins most. After that one
set of each component is verified against a pivot. Only sets that lie in different
components then are compared, in pairs of blocks: first the best pair of each set is
verified, twice, which joins nearly all that can be; the sets that may be similar to
one of another component still are then verified where they meet. No step gives
more pairs than it has sets.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pelorus.llm.common import KeyFilter, WordHashes, array_column, drop, in_arrow, mixed, portions, release, stage
from pelorus.llm.graph import components

#: Rounds of pivots and of best pairs before the rest is compared in blocks; sets that share a pivot in a tile, about.
PIVOT_ROUNDS, BEST_ROUNDS, PIVOT_SETS = 2, 2, 1024
#: Sets in a side of a block and their bytes, at most about.
BLOCK_SETS, BLOCK_BYTES = 1024, 4_000_000
#: Bytes of a bin of blocks, on average.
BIN_BYTES = 8_000_000
#: Bits of an element in the bitmaps that screen all tiles, and in those of the sets that are left.
FEW_BITS, MANY_BITS = 1, 8
#: Standard deviations by which a band's slack exceeds the expected number of empty ranges of its smallest sets; where few are expected, the chance that it is exceeded.
SLACK_SIGMAS, SLACK_CHANCE = 4.5, 1e-6

SIGNATURES = "doc_id long, t long, n_shingles long, cls binary, keys array<long>, hashes binary"


class Bands:
    """Size bands and their hash ranges for a similarity of ``num / den`` or more."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.edges = [1]
        while self.edges[-1] < 1 << 40:
            e = self.edges[-1]
            self.edges.append(max(e + 1, -(-e * den * den // (num * num))))

    def apart(self, band: int) -> int:
        """The most elements by which similar sets of the band differ."""
        top = self.edges[band + 1] - 1
        return (self.den - self.num) * (top + top * self.den // self.num) // (self.den + self.num)

    @lru_cache(maxsize=256)  # noqa: B019
    def slack(self, band: int) -> int:
        """Empty ranges that next to no set of the band exceeds, when it has ``apart + 1 + slack`` ranges."""
        n, least = self.edges[band], self.apart(band) + 1

        def enough(s: int) -> bool:
            m = least + s
            one, two = (1 - 1 / m) ** n, (1 - 2 / m) ** n if m > 1 else 0.0
            mean, spread = m * one, m * (m - 1) * two + m * one - (m * one) ** 2
            if mean > 20:
                return mean + SLACK_SIGMAS * max(0.0, spread) ** 0.5 < s + 1
            # few empty ranges are spread as rare events are, at most
            return mean == 0 or (mean < s + 1 and s + 1 - mean + (s + 1) * math.log(mean / (s + 1)) < math.log(SLACK_CHANCE))

        if enough(0):
            return 0
        low, high = 0, 1
        while not enough(high) and high < 64 * n:
            low, high = high, 2 * high
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (low, mid) if enough(mid) else (mid, high)
        return high

    def ranges(self, band: int) -> int:
        return self.apart(band) + 1 + self.slack(band)

    @lru_cache(maxsize=100_000)  # noqa: B019
    def of(self, n: int) -> tuple[tuple[int, int], ...]:
        """(band, ranges) of the bands in which a set of n elements has partners: its own and perhaps the one below."""
        band = int(np.searchsorted(self.edges, n, side="right")) - 1
        out = [(band, self.ranges(band))]
        if band and n * self.num <= (self.edges[band] - 1) * self.den:
            out.append((band - 1, self.ranges(band - 1)))
        return tuple(out)


def shingle_sets(texts: list[bytes], width: int, hashes: WordHashes) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of ``width`` words; of the whole text if it has fewer."""
    words = [t.lower().split() for t in texts]
    lengths = [len(w) for w in words]
    h = np.concatenate([hashes.of(w) for w in words]) if words else np.empty(0, dtype=np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15)
    runs = np.zeros(max(0, len(h) - width + 1), dtype=np.uint64)
    for k in range(width):
        runs = runs * base + h[k : k + len(runs)]
    runs = mixed(runs + np.uint64(width))
    at = 0
    for n in lengths:
        if n >= width:
            yield np.unique(runs[at : at + n - width + 1])
        elif n:
            whole = np.zeros(1, dtype=np.uint64)
            for x in h[at : at + n]:
                whole = whole * base + x
            yield mixed(whole + np.uint64(n))
        else:
            yield np.empty(0, dtype=np.uint64)
        at += n


def tile_keys(s: np.ndarray, bands: Bands) -> np.ndarray:
    """A key for each hash range of each band of the set: equal ranges have equal keys. Empty ranges have none unless they exceed the slack."""
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mixed(s))])
    out = []
    for band, m in bands.of(len(s)):
        cuts = np.append(np.searchsorted(s, (np.arange(m, dtype=np.uint64) * np.uint64(((1 << 64) - 1) // m))), len(s))
        sizes = np.diff(cuts)
        named = np.flatnonzero(sizes)
        if m - len(named) > bands.slack(band):
            named = np.arange(m)
        part = sums[cuts[named + 1]] - sums[cuts[named]]
        tag = named.astype(np.uint64) + np.uint64(band << 40)
        out.append(mixed(part ^ mixed(tag * np.uint64(0x9E3779B97F4A7C15) + sizes[named].astype(np.uint64))))
    return np.concatenate(out).view(np.int64)


def bitmap(s: np.ndarray, bands: Bands, per: int) -> bytes:
    """Hashed bitmap of the set, ``per`` bits an element or some more; lengths are powers of two."""
    size = 64
    while size < per * bands.edges[bands.of(len(s))[0][0] + 1]:
        size *= 2
    return _bits(s, size).tobytes()


def _bits(s: np.ndarray, size: int) -> np.ndarray:
    flags = np.zeros(size, dtype=bool)
    flags[((s >> np.uint64(16)) & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little")


def packed(s: np.ndarray) -> bytes:
    """The upper 48 bits of sorted hashes; two elements of a pair of sets collide once in 10^9 pairs."""
    return s.view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    """Hashes of ``packed``, their lower 16 bits 0."""
    raw = np.frombuffer(data, dtype=np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), dtype=np.uint8)
    out[:, 2:] = raw
    return out.view(np.uint64).ravel()


def class_key(cls: bytes) -> int:
    """A class's name as a 64-bit key for filters."""
    return int.from_bytes(cls[:8], "big", signed=True)


def folded(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bring two bitmaps (lengths are powers of two) to the shorter length by or-ing halves."""
    while len(a) > len(b):
        a = a[: len(a) // 2] | a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] | b[len(b) // 2 :]
    return a, b


def similar(overlap: int, a: int, b: int, num: int, den: int) -> bool:
    return den * overlap >= num * (a + b - overlap)


def signatures(docs: DataFrame, width: int, bands: Bands, known: KeyFilter | None) -> DataFrame:
    """Per document its set's size and, if a key is in ``known``, the set with its keys.

    Without ``known``: the keys alone, a row for each. Copies within a batch
    give their keys twice and their set once.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(known) if known is not None else None

    def sets(batch: pa.RecordBatch, hashes: WordHashes) -> Iterator[np.ndarray]:
        return shingle_sets([t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()], width, hashes)

    def keys_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in portions(batches, 1):
            seen, out = Counter(), [np.empty(0, dtype=np.int64)]
            for s in sets(batch, hashes):
                name = s.tobytes()
                seen[name] += 1
                if len(s) and seen[name] <= 2:  # twice says that it has a copy
                    out.append(tile_keys(s, bands))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out))], names=["key"])

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes, filter_ = WordHashes(), shared.value
        for batch in portions(batches, 1):
            n, cls, arrays, keys, lengths, seen = [], [], [], [], [], set()
            for s in sets(batch, hashes):
                n.append(len(s))
                name = array = None
                own = np.empty(0, dtype=np.int64)
                if len(s):
                    k = tile_keys(s, bands)
                    k = k[filter_.has(k)]
                    if len(k):
                        name = xxhash.xxh3_128_digest(s.tobytes())
                        if name not in seen:
                            seen.add(name)
                            own, array = k, packed(s)
                cls.append(name)
                arrays.append(array)
                keys.append(own)
                lengths.append(len(own))
            flat = np.concatenate(keys) if keys else np.empty(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, type=pa.int64()), pa.array(cls, type=pa.binary()), array_column(flat, np.array(lengths, dtype=np.int64)), pa.array(arrays, type=pa.binary())],
                names=["doc_id", "t", "n_shingles", "cls", "keys", "hashes"],
            )

    base = docs.select("doc_id", "text", F.xxhash64("text").alias("t"))
    return in_arrow(base, keys_only, "key long") if known is None else in_arrow(base, full, SIGNATURES)


def sets_of(rows: DataFrame, classes: DataFrame, bands: Bands, whole: bool) -> DataFrame:
    """(cls, bits) or, if ``whole``, (cls, more bits, hashes) of the classes named in ``classes`` (a stored table).

    A Bloom filter of the names goes over the stored signatures first, so that
    next to nothing else is moved.
    """
    keys = stage(classes.select(F.expr("cast(conv(hex(substring(cls, 1, 8)), 16, -10) as bigint)").alias("key")), "class-keys")
    known = KeyFilter.build(keys)
    drop(keys)
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = shared.value
        for batch in batches:
            names, data = batch.column(0).to_pylist(), batch.column(1)
            hit = np.flatnonzero(filter_.has(np.array([class_key(c) for c in names], dtype=np.int64))) if names else []
            own = [data[int(i)].as_py() for i in hit]
            columns = [pa.array([names[i] for i in hit], type=pa.binary()), pa.array([bitmap(unpacked(d), bands, MANY_BITS if whole else FEW_BITS) for d in own], type=pa.binary())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(own, type=pa.binary())] * whole, names=["cls", "bits", "hashes"][: 2 + whole])

    found = in_arrow(rows.where("hashes is not null").select("cls", "hashes"), pick, "cls binary, bits binary" + ", hashes binary" * whole)
    return found.groupBy("cls").agg(*[F.first(c).alias(c) for c in ("bits", "hashes")[: 1 + whole]])


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Elements that two sorted arrays share."""
    z = np.concatenate([a, b])
    z.sort(kind="stable")
    return int((z[1:] == z[:-1]).sum())


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar: bit counts first, then the sorted arrays."""
    left = sets.select(F.col("cls").alias("a"), F.col("hashes").alias("ha"), F.col("bits").alias("ba"))
    right = sets.select(F.col("cls").alias("b"), F.col("hashes").alias("hb"), F.col("bits").alias("bb"))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            names = batch.schema.names
            ha, ba, hb, bb = (batch.column(names.index(c)) for c in ("ha", "ba", "hb", "bb"))
            for i in range(batch.num_rows):
                p, q = folded(*(np.frombuffer(c[i].as_buffer(), dtype=np.uint8) for c in (ba, bb)))
                m, n = len(ha[i].as_buffer()) // 6, len(hb[i].as_buffer()) // 6
                most = min(m - int(np.bitwise_count(p & ~q).sum()), n - int(np.bitwise_count(q & ~p).sum()))
                if similar(most, m, n, num, den) and similar(overlap(unpacked(ha[i].as_buffer()), unpacked(hb[i].as_buffer())), m, n, num, den):
                    keep.append(i)
            at = pa.array(keep, type=pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(names.index(c)).take(at) for c in ("a", "b")], names=["a", "b"])

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "ha", "ba", "hb", "bb")
    return in_arrow(joined, test, "a binary, b binary")


def placed(members: DataFrame, per: float) -> DataFrame:
    """Rows of ``members`` (key, cls, n, root) for each pair of blocks they are in: bin, key, lo, hi, part, cls, n, root.

    A tile is cut into blocks of about ``BLOCK_BYTES`` (``per``: bytes of a set
    over its elements) by a hash of the set, the sets of its most frequent root
    apart from the others, as they need not meet each other: their blocks meet
    only those of the others. Every two blocks that have to meet do so once;
    many small pairs share a bin.
    """
    by_root = members.groupBy("key", "root").agg(F.count("*").alias("c"), F.max("n").alias("wide"))
    sizes = by_root.groupBy("key").agg(F.sum("c").alias("size"), F.max("wide").alias("wide"), F.max(F.struct("c", "root")).alias("main"))
    set_bytes = F.col("wide") * per + 100
    block = F.greatest(F.lit(2), F.least(F.lit(BLOCK_SETS), F.floor(F.lit(BLOCK_BYTES) / set_bytes)))
    same = F.when(F.col("main.c") > 1, F.col("main.c")).otherwise(F.lit(0))
    sizes = sizes.select("key", F.col("main.root").alias("main"), same.alias("same"), (F.col("size") - same).alias("rest"), F.ceil(same / block).cast("int").alias("mains"), F.ceil((F.col("size") - same) / block).cast("int").alias("others"), set_bytes.alias("bytes"))
    held = sizes.agg(F.sum((F.col("same") * F.col("others") + F.col("rest") * (F.col("mains") + F.col("others"))) * F.col("bytes"))).first()[0] or 0
    bins = max(1, -(-int(held) // BIN_BYTES))
    # parts 0..mains-1 hold the main root's sets, the rest the others'
    is_main = (F.col("root") == F.col("main")) & (F.col("mains") > 0)
    own = F.xxhash64("cls")
    part = F.when(is_main, F.pmod(own, F.greatest("mains", F.lit(1)))).otherwise(F.col("mains") + F.pmod(own, F.greatest("others", F.lit(1)))).cast("int")
    every = F.sequence(F.when(is_main, F.col("mains")).otherwise(F.lit(0)), F.col("mains") + F.col("others") - 1)
    rows = members.join(sizes.select("key", "main", "mains", "others"), "key").where("others > 0").withColumn("part", part).withColumn("other", F.explode(every))
    rows = rows.select("key", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "cls", "n", "root")
    return rows.withColumn("bin", F.pmod(F.xxhash64("key", "lo", "hi"), F.lit(bins)))


def partners(n: np.ndarray, part: np.ndarray, i: int, num: int, den: int) -> np.ndarray:
    """Sets after ``i``, in rising size, whose size may go with it; of the other block alone if there are two."""
    j = np.arange(i + 1, int(np.searchsorted(n, n[i] * den // num, side="right")))
    return j if part[0] == part[-1] and (part == part[0]).all() else j[part[j] != part[i]]


def bounded(maps: np.ndarray, n: np.ndarray, i: int, j: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Those of the sets ``j`` which, by bit counts, may be similar to set ``i``, and by how much their bound exceeds what they need."""
    most = np.minimum(n[i] - np.bitwise_count(maps[i] & ~maps[j]).sum(axis=1), n[j] - np.bitwise_count(maps[j] & ~maps[i]).sum(axis=1))
    lead = den * most - num * (n[i] + n[j] - most)
    return j[lead >= 0], lead[lead >= 0]


def bitmaps(column: pd.Series) -> np.ndarray:
    """Bitmaps of one length, a row each."""
    least = min(len(b) for b in column)
    maps = np.stack([folded(np.frombuffer(b, dtype=np.uint8), np.zeros(least, dtype=np.uint8))[0] for b in column])
    return np.pad(maps, ((0, 0), (0, -maps.shape[1] % 8))).view(np.uint64)


def screened(members: DataFrame, bits: DataFrame, num: int, den: int) -> DataFrame:
    """cls of the sets that may be similar to another of a tile, by bit counts. members: key, cls, n, root; bits: cls, bits."""

    def screen(pdf: pd.DataFrame) -> pd.DataFrame:
        found: set[bytes] = set()
        for _, g in pdf.groupby(["key", "lo", "hi"], sort=False):
            if len(g) < 2:
                continue
            g = g.sort_values("n", kind="stable")
            n, part, cls, maps = g["n"].to_numpy(), g["part"].to_numpy(), g["cls"].to_numpy(), bitmaps(g["bits"])
            hit = np.array([c in found for c in cls])
            for i in range(len(g) - 1):
                j = partners(n, part, i, num, den)
                if hit[i]:  # it would tell nothing about those that are known
                    j = j[~hit[j]]
                if len(j):
                    fit, _ = bounded(maps, n, i, j, num, den)
                    hit[fit] = True
                    hit[i] |= bool(len(fit))
            found.update(cls[hit])
        return pd.DataFrame({"cls": list(found)})

    rows = placed(members, FEW_BITS / 8).select("bin", "key", "lo", "hi", "part", "cls", "n")
    return rows.join(bits, "cls").groupBy("bin").applyInPandas(screen, "cls binary").distinct()


def best_pairs(members: DataFrame, bits: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of sets of a tile in different components that may be similar, by bit counts: of a set the one with the best bound.

    members: key, cls, n, root; bits: cls, bits. A task gives a pair for each
    set at most. Sets that are in none have no such partner left.
    """

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        best: dict[bytes, tuple[float, bytes]] = {}
        for _, g in pdf.groupby(["key", "lo", "hi"], sort=False):
            if len(g) < 2 or g["root"].nunique() < 2:
                continue
            g = g.sort_values("n", kind="stable")
            n, part, cls, maps = g["n"].to_numpy(), g["part"].to_numpy(), g["cls"].to_numpy(), bitmaps(g["bits"])
            root = np.unique(g["root"].to_numpy(), return_inverse=True)[1]
            lead, to = np.full(len(g), -1.0), np.zeros(len(g), dtype=np.int64)
            for i in range(len(g) - 1):
                j = partners(n, part, i, num, den)
                j, by = bounded(maps, n, i, j[root[j] != root[i]], num, den)
                if len(j):
                    by = by / (n[i] + n[j])
                    k = int(by.argmax())
                    if by[k] > lead[i]:
                        lead[i], to[i] = by[k], j[k]
                    more = by > lead[j]
                    lead[j[more]], to[j[more]] = by[more], i
            for i in np.flatnonzero(lead >= 0):
                best[cls[i]] = max(best.get(cls[i], (-1.0, b"")), (float(lead[i]), cls[to[i]]))
        return pd.DataFrame([(min(a, b), max(a, b)) for a, (_, b) in best.items()], columns=["a", "b"])

    rows = placed(members, MANY_BITS / 8)
    return rows.join(bits, "cls").groupBy("bin").applyInPandas(compare, "a binary, b binary").distinct()


def block_links(members: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) that join all similar sets of a tile which lie in different components.

    members: key, cls, n, root; sets: cls, bits, hashes. Pairs are screened by
    bit counts and then verified where they meet; sets that a task has joined
    already are not compared again, so that it hands on fewer links than sets.
    """

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        joined: dict[bytes, bytes] = {}

        def top(x: bytes) -> bytes:
            while joined.get(x, x) != x:
                joined[x] = joined.get(joined[x], joined[x])
                x = joined[x]
            return x

        for _, g in pdf.groupby(["key", "lo", "hi"], sort=False):
            if len(g) < 2 or g["root"].nunique() < 2:
                continue
            g = g.sort_values("n", kind="stable")
            n, part, cls, data, maps = g["n"].to_numpy(), g["part"].to_numpy(), g["cls"].to_numpy(), g["hashes"].to_numpy(), bitmaps(g["bits"])
            names = g["root"].to_numpy()
            root = np.unique(np.array([top(r) for r in names], dtype=object), return_inverse=True)[1]
            for i in range(len(g) - 1):
                j = partners(n, part, i, num, den)
                j, _ = bounded(maps, n, i, j[root[j] != root[i]], num, den)
                mine = unpacked(data[i]) if len(j) else None
                for k in j:
                    if root[k] != root[i] and similar(overlap(mine, unpacked(data[k])), int(n[i]), int(n[k]), num, den):
                        out.append((cls[i], cls[k]))
                        joined[top(names[k])] = top(names[i])
                        root[root == root[k]] = root[i]
        return pd.DataFrame(out, columns=["a", "b"])

    rows = placed(members, MANY_BITS / 8 + 6)
    return rows.join(sets, "cls").groupBy("bin").applyInPandas(link, "a binary, b binary")


def pivot_pairs(tiles: DataFrame, turn: int, num: int, den: int) -> DataFrame:
    """(a, b): one set of each component of a tile and the pivot of its block there, each a once. tiles: key, cls, n, root.

    In the first turn every set is a component. A pivot is the least of its
    block by a hash; of its pivots a set takes the least.
    """
    rank = F.struct(F.xxhash64("cls", F.lit(turn)).alias("h"), F.col("cls").alias("p"), F.col("n").alias("pn"), F.col("root").alias("pr"))
    if turn:
        tiles = tiles.groupBy("key", "root").agg(F.min(rank).alias("r")).select("key", "root", F.col("r.p").alias("cls"), F.col("r.pn").alias("n"))
    sizes = tiles.groupBy("key").agg(F.ceil(F.count("*") / PIVOT_SETS).cast("int").alias("parts"))
    rows = tiles.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("cls", F.lit(turn), F.lit(1)), F.col("parts")))
    pivots = rows.groupBy("key", "block").agg(F.min(rank).alias("pivot")).select("key", "block", "pivot.*")
    to = rows.join(pivots, ["key", "block"]).where((F.col("root") != F.col("pr")) & (F.greatest("n", "pn") * num <= F.least("n", "pn") * den))
    return to.groupBy("cls").agg(F.min(F.struct("h", "p")).alias("to")).select(F.col("cls").alias("a"), F.col("to.p").alias("b"))


def rooted(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Give each set its component's root, itself if it has no link."""
    if roots is None:
        return members.withColumn("root", F.col("cls"))
    return members.join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))


def open_tiles(tiles: DataFrame) -> DataFrame:
    """Rows of the tiles that hold more than one component."""
    mixed_ = tiles.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    return tiles.join(mixed_, "key", "left_semi")


def grouped(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Stored (doc_id, t, n_shingles, root) of every document; root names its component, null if it links with nothing."""
    bands = Bands(num, den)
    shared = stage(signatures(docs, width, bands, None).groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "tile-keys")
    known = KeyFilter.build(shared)
    drop(shared)
    rows = stage(signatures(docs, width, bands, known), "signatures")
    classes = stage(
        rows.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.max(F.when(F.size("keys") > 0, F.col("keys"))).alias("keys")).withColumn("cid", F.monotonically_increasing_id()), "classes"
    )
    release(docs.sparkSession)
    # numbers in place of names while all tiles move
    numbered = one_of_equal_tiles(classes.select("cid", F.explode("keys").alias("key")), "cid")
    tiles = stage(numbered.join(classes.select("cid", "cls", "n"), "cid").select("cls", "n", "key"), "tiles")
    drop(numbered)
    live = stage(tiles.select("cls").distinct(), "live")
    bits = stage(sets_of(rows, live, bands, False), "bits")
    release(docs.sparkSession)
    near = stage(screened(tiles.withColumn("root", F.col("cls")), bits, num, den), "near")
    release(docs.sparkSession)
    sets = stage(sets_of(rows, near, bands, True), "sets")
    drop(live, bits)
    every, tiles = tiles, one_of_equal_tiles(tiles.join(near, "cls", "left_semi"), "cls")
    drop(every)
    edges, roots, many = None, None, sets.select("cls", "bits")
    for turn in range(PIVOT_ROUNDS + BEST_ROUNDS + 1):
        left = stage(open_tiles(rooted(tiles, roots)), "open-tiles")
        if left.isEmpty():
            break
        if turn < PIVOT_ROUNDS:
            new = verified(pivot_pairs(left, turn, num, den), sets, num, den)
        else:
            pairs = stage(best_pairs(left, many, num, den), "best-pairs")
            if pairs.isEmpty():  # no set may be similar to one of another component
                break
            if turn < PIVOT_ROUNDS + BEST_ROUNDS:
                new = verified(pairs, sets, num, den)
            else:
                # the sets that still may be, and no others, are verified where they meet
                some = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
                new = block_links(open_tiles(left.join(some, "cls", "left_semi")), sets.join(some, "cls", "left_semi"), num, den)
        new = stage(new, "links")
        edges = new if edges is None else edges.unionByName(new)
        roots = components(edges)
    named = rooted(classes.select("cls"), roots)
    out = stage(rows.select("doc_id", "t", "n_shingles", "cls").hint("merge").join(named, "cls", "left").select("doc_id", "t", "n_shingles", "root"), "grouped")
    drop(rows, classes, tiles, near, sets)
    return out


def one_of_equal_tiles(tiles: DataFrame, name: str) -> DataFrame:
    """Rows of one tile out of those that hold the same sets, stored.

    Similar sets agree on most ranges, so most tiles repeat each other. Tiles
    are told apart by their size, their least set and a sum of hashes of the
    column ``name``. The chosen keys are stored first, so that the sums'
    shuffle is gone when the rows move.
    """
    per_tile = tiles.groupBy("key").agg(F.count("*").alias("size"), F.min(name).alias("least"), F.bit_xor(F.xxhash64(name)).alias("sum")).where("size > 1")
    chosen = stage(per_tile.groupBy("size", "least", "sum").agg(F.min("key").alias("key")).select("key"), "tiles-chosen")
    release(tiles.sparkSession)
    out = stage(tiles.join(chosen, "key", "left_semi"), "tiles")
    drop(chosen)
    return out


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id of every document.

    Two documents link when the Jaccard similarity of their sets of distinct
    ``width``-word shingles is ``num / den`` or more (words are runs of anything
    but ASCII white space, A-Z lower-cased); component_id is the smallest
    doc_id reachable over links, the document's own included. Null, empty and
    blank texts have an empty set and link with nothing. Repeated rows are
    copies of each other. A row without doc_id links like any other but names no
    component; alone, its component_id is null. Texts of any length are
    compared whole: blocks and bins of long ones hold fewer sets. An empty
    table gives no rows; columns other than doc_id and text are not read.
    """
    rows = grouped(docs, width, num, den)
    least = rows.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rows.hint("merge").join(least, "root", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def deduplicate(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one document of each group of near duplicates, the one with the smallest doc_id.

    Documents that link with nothing stay, empty ones among them; of rows that
    repeat id and text one stays, unless the text is blank.
    """
    rows = grouped(docs, width, num, den)
    k = F.coalesce("doc_id", F.lit(-(2**63)))
    one = rows.where("root is not null").groupBy("root").agg(F.min(F.struct(k.alias("k"), "t")).alias("one"), F.min("n_shingles").alias("n"))
    one = one.select("one.k", "one.t", F.lit(True).alias("single"))
    free = rows.where("root is null").select(k.alias("k"), "t", F.lit(False).alias("single")).distinct()
    keep = stage(one.unionByName(free), "kept")
    twice = rows.where("root is not null").select(k.alias("k"), "t").groupBy("k", "t").agg(F.count("*").alias("n")).where("n > 1")
    out = docs.withColumn("__k", k).withColumn("__t", F.xxhash64("text")).hint("merge").join(keep.select(F.col("k").alias("__k"), F.col("t").alias("__t"), F.col("single").alias("__single")), ["__k", "__t"])
    if not twice.isEmpty():
        turn = F.row_number().over(Window.partitionBy("__k", "__t").orderBy("__k"))
        out = out.withColumn("__turn", turn).where("not __single or __turn = 1")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
