"""Mixing sources to target weights, by blocks drawn from each source.

The words of a source are laid end to end, documents in a pseudorandom order,
and cut into blocks of fixed length. Every output shard draws how many blocks
it takes from each source: a multinomial draw with the shares of what is left of
the totals that the targets ask for, so that sampling noise moves blocks between
shards but never a source's share. A shard's slots
continue the source's slot numbers, and a slot is mapped to a block by the
source's own pseudorandom permutation of block numbers, one permutation for
each time the source is gone through. Within a shard, the slots of all sources
are put into one pseudorandom order. Blocks and slots meet in an equi-join on
(source, block).

Positions in the laid-out words need running sums over a source, which may
hold a third of all rows. They are taken in two steps: within hash buckets of
bounded size, and over the buckets' sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pelorus.llm.common import in_arrow, portions, ranges, stage

WORD = r"[^\x20\x09-\x0D]+"
#: Words in a block.
BLOCK_WORDS = 64
#: Output shards at least, and words of a shard at most, about.
LEAST_SHARDS, SHARD_WORDS = 64, 50_000_000
#: Sources at most: a row of each is collected.
MOST_SOURCES = 100_000
#: Documents in a bucket, on average.
BUCKET_DOCS = 2000
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_REPEATS = 2.0


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0))


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: float = MOST_REPEATS) -> dict[str | None, float]:
    """Target of each source: shares by weight, none above ``repeats`` times its size.

    What a capped source cannot take is shared among the others by weight, again and
    again until none is above. Sources come in code-point order, null last.
    """
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(names)}
    left, open_ = share * sum(sizes.values()), list(names)
    out: dict[str | None, float] = {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > repeats * sizes[s]]
        if not full:
            return out | {s: left * weight[s] / total for s in open_}
        for s in full:
            out[s] = repeats * sizes[s]
        left -= sum(out[s] for s in full)
        open_ = [s for s in open_ if s not in out]
    return out


def draws(totals: list[int], shards: int, seed: int) -> np.ndarray:
    """Blocks that each shard (row) draws from each source (column); columns sum to ``totals``.

    A shard's counts are a multinomial draw with the shares of what the shards
    before it have left; what a source lacks is drawn again from the others.
    """
    rng = np.random.default_rng(seed)
    left = np.array(totals, dtype=np.int64)
    out = np.zeros((shards, len(totals)), dtype=np.int64)
    for k in range(shards):
        n = int(left.sum()) // (shards - k)
        while n:
            drawn = np.minimum(rng.multinomial(n, left / left.sum()), left)
            out[k] += drawn
            left -= drawn
            n -= int(drawn.sum())
    return out


#: Slots of one source that are mapped to blocks at once, and slots of a task.
SLOT_CHUNK, TASK_SLOTS = 1_000_000, 100_000


def permute(slots: np.ndarray, n: int, key: str) -> np.ndarray:
    """Blocks 0..n-1 of slots: pass ``slot // n`` goes through all blocks once, in an order of its own.

    A four-round Feistel network over the next even number of bits, keyed by
    ``key`` and the pass, walked until it lands below n.
    """
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out = np.empty(len(slots), dtype=np.int64)
    for turn in np.unique(slots // n):
        at = np.flatnonzero(slots // n == turn)
        digest = hashlib.blake2b(f"{key}/{turn}".encode(), digest_size=32).digest()
        keys = np.frombuffer(digest, dtype=np.uint64)
        x = (slots[at] % n).astype(np.uint64)
        todo = np.arange(len(at))
        while len(todo):
            left, right = x[todo] >> np.uint64(half), x[todo] & mask
            for k in keys:
                h = (right + k) * np.uint64(0x9E3779B97F4A7C15)
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                left, right = right, left ^ ((h >> np.uint64(32)) & mask)
            x[todo] = (left << np.uint64(half)) | right
            todo = todo[x[todo] >= n]
        out[at] = x
    return out


def lay_out(sized: DataFrame, seed: int) -> DataFrame:
    """Add ``off``, the place of a document's first word among its source's words.

    The order follows id and text alone, however the table is read; rows that
    repeat both are alike.
    """
    buckets = max(1, -(-sized.count() // BUCKET_DOCS))
    keyed = sized.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "t", F.lit(seed)), F.lit(buckets)))
    within = Window.partitionBy("src", "bucket").orderBy(F.xxhash64("doc_id", "t", F.lit(seed), F.lit(1)), "doc_id", "t", "uid")
    placed = keyed.withColumn("inside", F.sum("size").over(within) - F.col("size"))
    before = Window.partitionBy("src").orderBy("bucket")
    sums = keyed.groupBy("src", "bucket").agg(F.sum("size").alias("total"))
    sums = sums.select("src", "bucket", (F.sum("total").over(before) - F.col("total")).alias("base"))
    return placed.hint("merge").join(sums, ["src", "bucket"]).select("uid", "src", "size", (F.col("base") + F.col("inside")).alias("off"))


def drawn_blocks(spark, plan: list[tuple[int, int, int]], seed: int, shards: int) -> DataFrame:
    """Rows (src, block, shard, slot): the block that each slot of each shard takes. plan: (src, blocks, blocks to take)."""
    counts = draws([t for _, _, t in plan], shards, seed)
    firsts = np.cumsum(counts, axis=0) - counts
    places = np.cumsum(counts, axis=1) - counts
    chunks = [
        (src, n, int(lo), int(min(lo + SLOT_CHUNK, firsts[k, j] + counts[k, j])), k, int(places[k, j] + lo - firsts[k, j]), int(counts[k].sum()))
        for j, (src, n, _) in enumerate(plan)
        for k in range(shards)
        for lo in range(int(firsts[k, j]), int(firsts[k, j] + counts[k, j]), SLOT_CHUNK)
    ]

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for src, n, lo, hi, shard, place, total in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                block = permute(ranges(np.array([lo]), np.array([hi - lo])), n, f"{seed}/{src}")
                slot = permute(ranges(np.array([place]), np.array([hi - lo])), total, f"{seed}/shard/{shard}")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(hi - lo, src), type=pa.int64()), pa.array(block), pa.array(np.full(hi - lo, shard), type=pa.int64()), pa.array(slot)], names=["src", "block", "shard", "slot"])

    table = spark.createDataFrame(chunks, "src long, n long, lo long, hi long, shard long, place long, total long").repartition(max(1, min(len(chunks), -(-sum(t for _, _, t in plan) // TASK_SLOTS))))
    return table.mapInArrow(expand, "src long, block long, shard long, slot long")


def block_uses(docs: DataFrame, seed: int = 17, block: int = BLOCK_WORDS, shards: int | None = None, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: float = MOST_REPEATS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mix of ``docs`` (uid, doc_id, t, source, size): sized rows, pieces of documents in blocks, slots of the shards.

    Sized rows gain src, source_size, target. Pieces: uid, src, block, off
    (place among the source's words), first (place in the document of the
    piece's first word), words. Slots: src, block, shard, slot.
    """
    spark = docs.sparkSession
    found = docs.groupBy("source").agg(F.sum("size").alias("words")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources: they are collected to share out the words")
    sizes = {r["source"]: (r["words"] or 0) for r in found}
    goals = targets(sizes, weights, share, repeats)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    number = {s: i for i, s in enumerate(names)}
    sources = spark.createDataFrame([(s, i, int(sizes[s]), float(goals[s])) for s, i in number.items()], "source string, src long, source_size long, target double")
    sized = docs.join(F.broadcast(sources), docs["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    plan = []
    for s, i in number.items():
        if sizes[s]:
            n = -(-sizes[s] // block)
            plan.append((i, n, round(goals[s] * n / sizes[s])))
    uses = drawn_blocks(spark, plan, seed, shards or max(LEAST_SHARDS, round(sum(goals.values()) / SHARD_WORDS)))
    placed = lay_out(sized, seed).where("size > 0")
    last = F.floor((F.col("off") + F.col("size") - 1) / block).cast("long")
    pieces = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("off") / block).cast("long"), last)))
    start, stop = F.greatest("off", F.col("block") * block), F.least(F.col("off") + F.col("size"), (F.col("block") + 1) * block)
    return sized, pieces.select("uid", "src", "block", "off", (start - F.col("off")).alias("first"), (stop - start).alias("words")), uses


def sized_rows(docs: DataFrame) -> DataFrame:
    """Stage (uid, doc_id, t, source, size) of every row; uid tells rows apart, t is a hash of the text."""
    return stage(docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.xxhash64("text").alias("t"), "source", n_words(F.col("text")).alias("size")), "sized")


def mix(docs: DataFrame, seed: int = 17, block: int = BLOCK_WORDS, shards: int | None = None, **shares) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target (its source's), taken (words, repeats counted).

    Null and empty texts have size 0 and are taken 0 times; a null source is a
    source of its own, the last; repeated rows are documents of their own; an
    empty table gives no rows. Other columns are not read. The same table
    gives the same mix. What is collected is a row per source.
    """
    sized, pieces, uses = block_uses(sized_rows(docs), seed, block, shards, **shares)
    taken = pieces.hint("merge").join(uses, ["src", "block"]).groupBy("uid").agg(F.sum("words").alias("taken"))
    out = sized.hint("merge").join(taken, "uid", "left")
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_blocks(docs: DataFrame, seed: int = 17, block: int = BLOCK_WORDS, shards: int | None = None, **shares) -> DataFrame:
    """The mix in its order: shard, slot, source, text of each block taken, a shard's rows together and by slot.

    A block's text is its documents' stretches, joined by a line break. Slots
    of a shard are 0, 1, 2, ...; ``mix`` counts the same rows by document.
    """
    rows = stage(docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.xxhash64("text").alias("t"), "source", n_words(F.col("text")).alias("size"), "text"), "mix-texts")
    sized, pieces, uses = block_uses(rows.drop("text"), seed, block, shards, **shares)
    wanted = pieces.join(uses.select("src", "block").distinct(), ["src", "block"]).groupBy("uid", "src").agg(F.collect_list(F.struct("block", "off", "first", "words")).alias("parts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        word = re.compile(WORD)
        for batch in portions(batches, 2):
            out = []
            for src, parts, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                spans = [m.span() for m in word.finditer(text)]
                out += [(src, p["block"], p["off"], text[spans[p["first"]][0] : spans[p["first"] + p["words"] - 1][1]]) for p in parts]
            columns = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, type=pa.int64()) for c in columns[:3]), pa.array(columns[3], type=pa.string())], names=["src", "block", "off", "text"])

    cuts = in_arrow(wanted.hint("merge").join(rows.select("uid", "text"), "uid").select("src", "parts", "text"), cut, "src long, block long, off long, text string")
    texts = cuts.groupBy("src", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("off", "text"))), lambda x: x["text"]), "\n").alias("text"))
    names = F.broadcast(sized.select("src", "source").distinct())
    out = uses.hint("merge").join(texts, ["src", "block"]).join(names, "src").select("shard", "slot", "source", "text")
    return out.repartition("shard").sortWithinPartitions("shard", "slot")


def mixed_texts(docs: DataFrame, seed: int = 17, block: int = BLOCK_WORDS, shards: int | None = None, **shares) -> DataFrame:
    """The mix as documents: a row for each pass over a document that takes words of it.

    A pass that takes all words gives the text as it is; any other gives the
    taken stretches of the text, joined by a line break. The columns are those
    of ``docs``, n_chars (if there) being the new text's length. Rows that
    repeat id, text and source are served one after the other.
    """
    sized, pieces, uses = block_uses(sized_rows(docs), seed, block, shards, **shares)
    pieces = pieces.hint("merge").join(uses.groupBy("src", "block").agg(F.count("*").alias("n")), ["src", "block"])
    runs = pieces.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("first", "words", "n"))).alias("runs"))
    key = [F.coalesce("doc_id", F.lit(-(2**63))).alias("__k"), "src"]
    runs = sized.hint("merge").join(runs, "uid").select(*key, F.col("t").alias("__t"), "uid", "runs")
    runs = runs.groupBy("__k", "__t", F.col("src").alias("__src")).agg(F.array_sort(F.collect_list(F.struct("uid", "runs"))).alias("__all"))
    names = docs.columns
    sources = F.broadcast(sized.select(F.col("source").alias("__source"), F.col("src").alias("__src")).distinct())
    rows = docs.select(*[F.col(f"`{c}`") for c in names], key[0], F.xxhash64("text").alias("__t")).join(sources, F.col("source").eqNullSafe(F.col("__source")))
    turn = F.row_number().over(Window.partitionBy("__k", "__t", "__src").orderBy("__k"))
    joined = rows.withColumn("__turn", turn).hint("merge").join(runs, ["__k", "__t", "__src"])
    joined = joined.where(F.col("__turn") <= F.size("__all")).withColumn("__runs", F.element_at("__all", F.col("__turn"))["runs"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        word = re.compile(WORD)
        for batch in portions(batches, names.index("text")):
            texts, runs = batch.column(names.index("text")).to_pylist(), batch.column(len(names)).to_pylist()
            rows, out = [], []
            for i, (text, parts) in enumerate(zip(texts, runs, strict=True)):
                spans = [m.span() for m in word.finditer(text)]
                for turn in range(max(p["n"] for p in parts)):
                    stretches: list[list[int]] = []
                    for p in parts:
                        if p["n"] > turn:
                            if stretches and stretches[-1][1] == p["first"]:
                                stretches[-1][1] += p["words"]
                            else:
                                stretches.append([p["first"], p["first"] + p["words"]])
                    rows.append(i)
                    out.append(text if stretches == [[0, len(spans)]] else "\n".join(text[spans[a][0] : spans[b - 1][1]] for a, b in stretches))
            taken = batch.take(pa.array(rows, type=pa.int64()))
            columns = [taken.column(j) for j in range(len(names))]
            columns[names.index("text")] = pa.array(out, type=pa.string())
            if "n_chars" in names:
                columns[names.index("n_chars")] = pa.array([len(t) for t in out], type=pa.int64()).cast(columns[names.index("n_chars")].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return in_arrow(joined.select(*[F.col(f"`{c}`") for c in names], "__runs"), cut, docs.schema)
