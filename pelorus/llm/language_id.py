"""Language identification by rank-order profiles of character n-grams.

A profile is the list of a language's most frequent n-grams (1 to 3 letters,
word borders count as a character), by rank. A document's own most frequent
n-grams are ranked the same way; the out-of-place distance to a language is
the sum of the rank differences, with the greatest difference for an n-gram
which the profile lacks. The nearest profile wins.

Counting is done on whole texts by sorting integer codes of n-grams, many
documents at a time; long documents are counted in parts that are added up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pelorus.llm.common import blocks, in_arrow, portions

PROFILE_SIZE = 300
#: Letters handled at once.
BLOCK_CHARS = 1_000_000
#: Distances (0..1) are turned into shares of belief by exp(-SHARPNESS * distance).
SHARPNESS = 20.0
UNKNOWN = "und"

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point its lower-case letter, or 0 if it is no letter."""
    global _letters
    if _letters is None:
        table = np.zeros(0x110000, dtype=np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _letters = table
    return _letters


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _counted(points: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, n-gram code, count), sorted by doc and code, of letters with 0 between words.

    A code holds three code points of 21 bits; a shorter n-gram has the value
    2**21 - 1, which is no code point, in the places before it.
    """
    alphabet, small = np.unique(points, return_inverse=True)
    bits = int(len(alphabet)).bit_length()
    none = np.int64(len(alphabet))
    p = small.astype(np.int64)
    # documents begin and end with 0, so no n-gram with a letter in the middle crosses a border
    one, two = p, (none << (2 * bits)) | (p[:-1] << bits) | p[1:]
    three = (p[:-2] << (2 * bits)) | (p[1:-1] << bits) | p[2:]
    is_letter = points != 0
    unigram = (none << (2 * bits)) | (none << bits) | one
    keep2 = (is_letter[:-1] | is_letter[1:]) & (doc[:-1] == doc[1:])
    keep3 = is_letter[1:-1] & (doc[:-2] == doc[2:])
    codes = np.concatenate([unigram[is_letter], two[keep2], three[keep3]])
    docs = np.concatenate([doc[is_letter], doc[:-1][keep2], doc[1:-1][keep3]])
    width = 3 * bits
    base = int(docs.min()) if len(docs) else 0
    span = int(docs.max()) - base + 1 if len(docs) else 1
    if width + span.bit_length() <= 62:
        key = ((docs - base) << width) | codes
        key.sort()
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, dtype=np.int64)
        counts = np.diff(np.append(cut, len(key)))
        docs, codes = (key[cut] >> width) + base, key[cut] & ((1 << width) - 1)
    else:
        order = np.lexsort((codes, docs))
        docs, codes = docs[order], codes[order]
        cut = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]) | (docs[1:] != docs[:-1])])) if len(codes) else np.empty(0, dtype=np.int64)
        counts = np.diff(np.append(cut, len(codes)))
        docs, codes = docs[cut], codes[cut]
    # back to code points
    mask = (1 << bits) - 1
    wide = np.append(alphabet.astype(np.int64), (1 << 21) - 1)
    full = (wide[codes >> (2 * bits)] << 42) | (wide[(codes >> bits) & mask] << 21) | wide[codes & mask]
    return docs, full, counts


def count_ngrams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, n-gram code, count) for runs of whole texts."""
    table = letters()
    sizes = np.array([len(t) if t else 0 for t in texts], dtype=np.int64)
    for start, stop in blocks(sizes, BLOCK_CHARS):
        if stop - start == 1 and sizes[start] > 2 * BLOCK_CHARS:
            yield _long(texts[start], start)
            continue
        joined = "\0" + "\0\0".join(t or "" for t in texts[start:stop]) + "\0"
        points = table[_points(joined)]
        doc = np.repeat(np.arange(start, stop, dtype=np.int64), sizes[start:stop] + 2)
        # of several separators in a row the first and, at a document's start, the first of the document stay
        stays = np.ones(len(points), dtype=bool)
        stays[1:] = (points[1:] != 0) | (points[:-1] != 0) | (doc[1:] != doc[:-1])
        yield _counted(points[stays], doc[stays])


def _long(text: str, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of one very long text, part by part; parts end between words where possible."""
    codes, counts = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    table, at = letters(), 0
    while at < len(text):
        stop = min(len(text), at + BLOCK_CHARS)
        while at < stop < len(text) and stop < at + BLOCK_CHARS + 10_000 and table[ord(text[stop])]:
            stop += 1
        points = table[_points("\0" + text[at:stop] + "\0")]
        stays = np.ones(len(points), dtype=bool)
        stays[1:] = (points[1:] != 0) | (points[:-1] != 0)
        _, c, n = _counted(points[stays], np.zeros(int(stays.sum()), dtype=np.int64))
        codes, back = np.unique(np.concatenate([codes, c]), return_inverse=True)
        counts = np.bincount(back, weights=np.concatenate([counts, n]).astype(float), minlength=len(codes)).astype(np.int64)
        at = stop
    return np.full(len(codes), row, dtype=np.int64), codes, counts


def ranked(docs: np.ndarray, codes: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, code, rank from 0) of each document's ``size`` most frequent n-grams, ties to the smaller code."""
    # rows come sorted by (doc, code); a stable sort by falling count keeps that order among ties
    if len(docs) and (int(docs[-1] - docs[0]) + 1).bit_length() + int(counts.max()).bit_length() <= 62:
        top = int(counts.max())
        order = np.argsort((docs - docs[0]) * (top + 1) + (top - counts), kind="stable")
    else:
        order = np.lexsort((-counts, docs))
    docs, codes = docs[order], codes[order]
    first = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]])) if len(docs) else np.empty(0, dtype=np.int64)
    rank = np.arange(len(docs)) - np.repeat(first, np.diff(np.append(first, len(docs))))
    keep = rank < size
    return docs[keep], codes[keep], rank[keep]


def train(docs: DataFrame, per_language: int = 3000, size: int = PROFILE_SIZE) -> dict[str, list[int]]:
    """Profiles (n-gram codes by rank) of the languages in ``docs`` (doc_id, text, lang).

    Profiles are fitted on about ``per_language`` documents of each language,
    taken by a hash of the id; rows whose lang is null teach nothing.
    """
    known = docs.where("lang is not null")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return {}
    share = F.element_at(F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, per_language / n)))]), F.col("lang"))
    taken = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.ceil(share * 1_000_000))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 0):
            langs, back = np.unique(np.array(batch.column(1).to_pylist(), dtype=object).astype(str), return_inverse=True)
            for row, code, n in count_ngrams(batch.column(0).to_pylist()):
                which = back[row]
                for k in np.unique(which):
                    c, at = np.unique(code[which == k], return_inverse=True)
                    total = np.bincount(at, weights=n[which == k].astype(float)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([str(langs[k])] * len(c)), pa.array(c), pa.array(total)], names=["lang", "code", "n"])

    total = in_arrow(taken.select("text", "lang"), counts, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    by = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    rows = total.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= size).select("lang", "rank", "code").collect()
    profiles: dict[str, list[int]] = {}
    for r in sorted(rows):
        profiles.setdefault(r["lang"], []).append(r["code"])
    return profiles


class Profiles:
    """Rank matrix of all profiles' n-grams, for distances of many documents at once."""

    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE_SIZE):
        self.langs, self.size = sorted(profiles), size
        self.codes = np.unique(np.array([c for p in profiles.values() for c in p], dtype=np.int64))
        self.ranks = np.full((len(self.codes) + 1, len(self.langs)), -1, dtype=np.int64)
        for k, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.codes, profiles[lang]), k] = np.arange(len(profiles[lang]))

    def distances(self, texts: list[str | None]) -> np.ndarray:
        """Distance 0..1 of each text to each language; nan for a text without letters."""
        out = np.full((len(texts), len(self.langs)), np.nan)
        if not self.langs:
            return out
        for docs, codes, counts in count_ngrams(texts):
            doc, code, rank = ranked(docs, codes, counts, self.size)
            if not len(doc):
                continue
            at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            at[self.codes[at] != code] = len(self.codes)
            found = self.ranks[at]
            apart = np.where(found < 0, self.size, np.abs(found - rank[:, None]))
            first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            n = np.diff(np.append(first, len(doc)))
            out[doc[first]] = np.add.reduceat(apart, first, axis=0) / (n * self.size)[:, None]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and distance of each text; ties go to the first language by name."""
        far = self.distances(texts)
        none = np.isnan(far).all(axis=1) if far.shape[1] else np.ones(len(texts), dtype=bool)
        far = np.where(none[:, None], 1.0, far) if far.shape[1] else np.ones((len(texts), 1))
        best = far.argmin(axis=1)
        belief = np.exp(-SHARPNESS * (far - far.min(axis=1, keepdims=True)))
        score = np.where(none, 0.0, 1.0 / belief.sum(axis=1))
        langs = [UNKNOWN if none[i] else self.langs[best[i]] for i in range(len(texts))]
        return langs, score, np.where(none, 1.0, far[np.arange(len(far)), best])


def identify(docs: DataFrame, profiles: dict[str, list[int]], size: int = PROFILE_SIZE, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Add lang_pred, score and distance to the ``keep`` columns of ``docs``; only text is judged.

    Null texts and texts without a letter get ``und``, score 0, distance 1;
    so does every text when no language was learned. One row out for each
    row in, repeated rows included.
    """
    cols = list(keep)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Profiles(profiles, size)
        for batch in portions(batches, len(cols)):
            at = len(cols)
            langs, score, far = judge.predict(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(cols))), pa.array(langs, type=pa.string()), pa.array(score, type=pa.float64()), pa.array(far, type=pa.float64())], names=[*cols, "lang_pred", "score", "distance"])

    base = docs.select(*cols, F.col("text").alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[:-1])
    return in_arrow(base, predict, fields + ", lang_pred string, score double, distance double")


def keep_known(docs: DataFrame, profiles: dict[str, list[int]], farthest: float = 0.9, size: int = PROFILE_SIZE) -> DataFrame:
    """Rows of ``docs`` whose text is in a known language, with all their columns.

    Texts without a letter go, and so do texts farther than ``farthest`` from
    every profile, which share next to no n-gram with any. If no language was
    learned, no text can be told to be foreign and only those without letters go.
    """
    names = docs.columns
    text = names.index("text")

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge, table = Profiles(profiles, size), letters()
        for batch in portions(batches, text):
            texts = batch.column(text).to_pylist()
            if judge.langs:
                _, _, far = judge.predict(texts)
                keep = far <= farthest
            else:
                keep = np.array([bool(t) and bool((table[_points(t)] != 0).any()) for t in texts], dtype=bool)
            yield batch.filter(pa.array(keep, type=pa.bool_()))

    return in_arrow(docs, sift, docs.schema)
