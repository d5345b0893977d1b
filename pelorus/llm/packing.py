"""Packing documents into fixed windows by best-fit decreasing.

Documents are tokenised once, where they lie. Documents longer than a window
are cut into full windows, each of which is a sequence of its own; only the
rests (at most one a document) need fitting. The rests are dealt to shards by
a hash, and each shard is packed by best-fit decreasing: rests in falling
length, each put into the tightest open window that holds it. The open windows
hang in a segment tree over the remaining capacity 0..window, so that the
tightest fit is found in log2(window) steps.

What moves between executors is a row of numbers per piece, never the tokens.
A shard holds ``shard_docs`` rests on average whatever the input's size, and
the loss against packing everything at once is below a thousandth.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelorus.llm.common import in_arrow, portions, stage

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: Word encodings a worker remembers; beyond it the memory starts anew.
REMEMBERED_WORDS = 150_000

_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a vocabulary; it outlives a task, and so does what it remembers."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


# Letters and numbers below U+0250, and the pieces the vocabulary's splitter makes of
# a lower-case word: contractions, runs of letters, single numbers, runs of anything else.
_LETTERS, _NUMBERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe"
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_LETTERS}{_NUMBERS}]+")
#: Characters that Python counts as white space and the vocabulary may not.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary.

    Printable bytes stand for themselves, the others for the characters from 256 on.
    """
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Encoded(dict):
    """Word -> bytes of its ids; unseen words are encoded as they are asked for.

    Words of the Latin alphabet are put together from their pieces, which many
    words share and which the bare model encodes; others go to the tokenizer.
    When it has grown full, it starts anew and takes over what is asked again.
    """

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.model, self.old, self.pieces = tokenizer, tokenizer.model, {}, {}
        self.characters = byte_characters()

    def _piece(self, piece: str) -> bytes:
        mapped = piece if piece.isascii() and piece.isalnum() else "".join([self.characters[b] for b in piece.encode()])
        ids = [t.id for t in self.model.tokenize(mapped)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, word: str) -> bytes:
        out = self.old.get(word)
        if out is None:
            low = word.lower()
            if low.isascii() or max(low) < "\u0250":
                parts = []
                for p in _PIECES.findall(low):
                    e = self.pieces.get(p)
                    if e is None:
                        e = self.pieces[p] = self._piece(p)
                    parts.append(e)
                out = b"".join(parts)
            else:
                ids = self.tokenizer.encode(word, add_special_tokens=False).ids
                out = struct.pack(f"<{len(ids)}I", *ids)
        self[word] = out
        return out

    def trim(self) -> None:
        if len(self) > REMEMBERED_WORDS:
            self.old = dict(self)
            self.clear()
        if len(self.pieces) > REMEMBERED_WORDS:
            self.pieces.clear()


class WordEncoder:
    """Token ids of a text as little-endian unsigned 32-bit bytes.

    The vocabulary is one whose pieces never cross white space, so each word
    is encoded once and remembered. Texts that may hold a special token's
    string, or white space on which Python and the vocabulary may differ, go
    to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memory = _Encoded(self.tokenizer)

    def __call__(self, text: str) -> bytes:
        odd = any(c in text for c in "\x1c\x1d\x1e\x1f") if text.isascii() else _ODD_SPACE.search(text)
        if odd or any(s in text for s in self.special):
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        self.memory.trim()
        return b"".join(map(self.memory.__getitem__, text.split()))


def tokenize(docs: DataFrame, vocabulary: str, window: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of each document: full windows and the rest, with a checksum of their ids.

    A null or empty text is the end id alone.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        end = np.asarray([end_id], dtype="<u4").tobytes()
        for batch in portions(batches, 1):
            rows: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text or "") + end
                total = len(ids) // 4
                for start in range(0, total, window):
                    part = ids[4 * start : 4 * (start + window)]
                    for column, value in zip(rows, (doc_id, start, len(part) // 4, zlib.crc32(part), total), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in rows], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return in_arrow(docs.select("doc_id", "text"), pieces, PIECES)


class OpenWindows:
    """Segment tree over remaining capacities; a leaf is the stack of windows with that much room."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.open = [0] * (2 * self.leaves)  # how many windows below each node
        self.stacks: list[list[int]] = [[] for _ in range(window + 1)]

    def _count(self, capacity: int, change: int) -> None:
        node = capacity + self.leaves
        while node:
            self.open[node] += change
            node >>= 1

    def push(self, capacity: int, name: int) -> None:
        stack = self.stacks[capacity]
        stack.append(name)
        if len(stack) == 1:
            self._count(capacity, 1)

    def pop_tightest(self, least: int) -> tuple[int, int] | None:
        """A window with the smallest capacity >= least, taken out; None if there is none."""
        node = least + self.leaves
        if not self.open[node]:
            # up to the first subtree on the right that has a window, then down its left edge
            while node > 1 and (node & 1 or not self.open[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.open[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        stack = self.stacks[capacity]
        name = stack.pop()
        if not stack:
            self._count(capacity, -1)
        return capacity, name


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset for each length (1..window)."""
    places, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    tree, made = OpenWindows(window), 0
    for i in np.argsort(-lengths, kind="stable"):
        need = int(lengths[i])
        found = tree.pop_tightest(need)
        if found is None:
            capacity, name, made = window, made, made + 1
        else:
            capacity, name = found
        places[i], offsets[i] = name, window - capacity
        if capacity > need:
            tree.push(capacity - need, name)
    return places, offsets


#: Sequences that are one full window are numbered from here on.
FULL_FROM = 1 << 62


def pack_pieces(pieces: DataFrame, shards: int, window: int = 2048) -> DataFrame:
    """Add sequence_id and offset to stored pieces.

    A full window is a sequence of its own. The others are dealt to shards and
    each shard is packed. Sequence ids are unique over all. Repeated rows are
    packed as often as they occur, and dealt to different shards; ties are
    broken by id, start and checksum.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["shard"].iloc[0])
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        places, offsets = best_fit_decreasing(pdf["length"].to_numpy(), window)
        return pdf.drop(columns="shard").assign(sequence_id=places * shards + shard, offset=offsets)

    numbered = pieces.withColumn("uid", F.monotonically_increasing_id())
    dealt = numbered.where(F.col("length") < window).withColumn("shard", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "uid"), F.lit(shards)).cast("int")).drop("uid")
    full = numbered.where(F.col("length") >= window).withColumn("sequence_id", F.lit(FULL_FROM) + F.col("uid")).withColumn("offset", F.lit(0).cast("long")).drop("uid")
    return dealt.groupBy("shard").applyInPandas(fit, PIECES + ", sequence_id long, offset long").unionByName(full)


def pack(docs: DataFrame, vocabulary: str, window: int = 2048, end_id: int = 1, shard_docs: int = 20_000) -> DataFrame:
    """Pack every document of ``docs`` (doc_id, text) into windows.

    Null and empty texts become one piece with the end id; very long texts
    become full windows and a rest; an empty table gives no rows; a null
    doc_id stays null. Only doc_id and text are read, so that other columns
    may have any name.
    """
    pieces = stage(tokenize(docs, vocabulary, window, end_id), "pieces")
    rests = pieces.where(F.col("length") < window).count()
    return pack_pieces(pieces, max(1, -(-rests // shard_docs)), window)
