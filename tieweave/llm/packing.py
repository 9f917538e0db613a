"""Packing: documents as token pieces in sequences of fixed length, with little padding.

Documents are tokenised and cut into pieces of at most ``length`` tokens; only the pieces'
measures are shuffled, never their tokens. Pieces fall into random groups of a bounded mean
size; within each, pieces in falling order of length go to the first open sequence with room,
found by a tournament tree over the free room of all sequences of the group.

Null and empty texts are the end token alone. Repeated rows are packed once each. The groups
depend on content and on the place in the input, so a repeated row meets no fixed group.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tieweave.llm import text as tx
from tieweave.session import cut

LENGTH = 2048
END_ID = 1
GROUP_PIECES = 8192
#: Distinct words a task remembers the ids of; beyond it the memory starts anew.
CACHED_WORDS = 2_000_000

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, spread long"


_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_STOP = np.zeros(256, bool)
_STOP[[0x2C, 0x2E]] = True


def _parted(texts: pa.Array) -> pa.Array:
    """Texts with a blank between a Latin letter and a comma or full stop after it.

    The tokenizer always parts them there, so the ids stay; far fewer words are distinct.
    """
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    first, last = int(offsets[0]), int(offsets[-1])
    if last - first < 2:
        return texts
    data = np.frombuffer(texts.buffers()[2], np.uint8)[first:last]
    letter = _LETTER[data]
    # Two bytes from 0xC3 are the letters U+00C0 to U+00FF, but for the signs times and divide.
    letter[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    at = np.flatnonzero(letter[:-1] & _STOP[data[1:]]) + 1
    ends = offsets - first
    # A break that is also a text's end would belong to the next text: it is no pair of one text.
    at = at[~np.isin(at, ends)]
    moved = (ends + np.searchsorted(at, ends)).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer(moved), pa.py_buffer(np.insert(data, at, tx.SPACE).tobytes())])


def _byte_letters() -> dict[int, int]:
    """Character that stands for each byte in byte-level vocabularies: itself if printable, else the next from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {**{b: b for b in shown}, **{b: 256 + k for k, b in enumerate(rest)}}


class WordTokens:
    """Ids of whole texts from the ids of their blank-separated words.

    Valid for tokenizers that drop white space, never join across it, lower-case, and part
    letters from other signs. Each distinct word is encoded once as long as the memory holds
    it. A word of Latin letters is one unit of the model and goes to it directly, without the
    normaliser; every other word takes the tokenizer's whole way.
    """

    def __init__(self, path: str, cached: int = CACHED_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer, self.cached = Tokenizer.from_file(path), cached
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self._clear()

    def _clear(self) -> None:
        self.known = pa.array([], pa.string())
        self.starts, self.ends, self.store = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _ids(self, word: str) -> list[int]:
        if word.isalpha() and max(word) < "\u0250" and (low := word.lower()).isalpha():
            return [t.id for t in self.model.tokenize(low if low.isascii() else low.encode().decode("latin-1").translate(self.letters))]
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def _learn(self, new: pa.Array) -> None:
        found = [self._ids(w) for w in new.to_pylist()]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        ends = len(self.store) + np.cumsum(counts)
        self.known = pa.concat_arrays([self.known, new])
        self.starts = np.concatenate([self.starts, ends - counts])
        self.ends = np.concatenate([self.ends, ends])
        self.store = np.concatenate([self.store, np.fromiter((i for ids in found for i in ids), np.uint32, int(counts.sum()))])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids and bounds: text i has ids bounds[i]:bounds[i + 1]."""
        words, bounds = tx.words(_parted(texts), tx.BLANK_SEPARATED)
        codes, distinct = tx.coded(words)
        if len(self.known) + len(distinct) > self.cached:
            self._clear()
        place = pc.index_in(distinct, value_set=self.known)
        if place.null_count:
            missing = pc.is_null(place)
            first = len(self.known)
            self._learn(distinct.filter(missing))
            place = pc.fill_null(place, -1).to_numpy(zero_copy_only=False).astype(np.int64)
            place[place < 0] = np.arange(first, len(self.known))
        else:
            place = place.to_numpy(zero_copy_only=False).astype(np.int64)
        at = place[codes]
        starts, lengths = self.starts[at], (self.ends - self.starts)[at]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        take = np.repeat(starts - (ends - lengths), lengths) + np.arange(total)
        return self.store[take], np.concatenate([[0], ends])[bounds]


@functools.lru_cache(maxsize=1)
def word_tokens(path: str) -> WordTokens:
    """One per Python worker, so that its memory serves all tasks the worker runs."""
    return WordTokens(path)


def token_pieces(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents; ``spread`` is an even hash that also separates repeated rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_tokens(tokenizer_path)
        row = 0
        task = TaskContext.get().partitionId()
        for batch, texts in tx.slices(batches, "text", 16 << 20):
            ids, bounds = encoder.encode(texts)
            out: list[tuple] = []
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                own = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                for start in range(0, len(own), length):
                    piece = own[start : start + length]
                    out.append((doc, start, len(piece), zlib.crc32(piece), len(own), row))
                    row += 1
            cols = list(zip(*out, strict=True))
            spread = tx.mixed(np.asarray(cols[5], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(cols[3], np.uint64) + (np.uint64(task) << np.uint64(40)))
            arrays = [pa.array(c, pa.int64()) for c in cols[:5]] + [pa.array((spread >> np.uint64(1)).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "spread"])

    return docs.select("doc_id", "text").mapInArrow(run, _PIECES)


class FirstFit:
    """Tournament tree: every inner node has the larger free room of its two children."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [room] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """Leftmost bin with room for ``size``, which it takes."""
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < size:
                at += 1
        room[at] -= size
        found = at - self.leaves
        while at > 1:
            at //= 2
            room[at] = max(room[2 * at], room[2 * at + 1])
        return found


def first_fit_decreasing(sizes: list[int], room: int) -> list[int]:
    """Bin of every size, for sizes in falling order."""
    tree = FirstFit(len(sizes), room)
    return [tree.place(s) for s in sizes]


def pack(pieces: DataFrame, length: int = LENGTH, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces with ``length`` and ``spread``."""
    pieces = cut(pieces)
    groups = max(1, -(-pieces.count() // group_pieces))
    names = [c for c in pieces.columns if c != "spread"]
    schema = ", ".join([*(f"{c} long" for c in names), "sequence_id long, offset long"])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        key = int(group["_group"].iloc[0])
        group = group.sort_values(["length", "doc_id", "start", "ids_crc32", "spread"], ascending=[False, True, True, True, True], kind="stable")
        bins = np.asarray(first_fit_decreasing(group["length"].tolist(), length))
        order = np.argsort(bins, kind="stable")
        group, bins = group.iloc[order], bins[order]
        size = group["length"].to_numpy()
        before = np.cumsum(size) - size
        first = np.searchsorted(bins, bins, side="left")
        out = group[names].copy()
        out["sequence_id"] = (key << 32) | bins
        out["offset"] = before - before[first]
        return out

    return pieces.withColumn("_group", F.pmod("spread", F.lit(groups))).groupBy("_group").applyInPandas(run, schema)


def packed_documents(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, end_id: int = END_ID, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """One row per piece: its document, tokens ``start`` .. ``start + length``, sequence and offset there."""
    return pack(token_pieces(docs, tokenizer_path, length, end_id), length, group_pieces)


def sequence_tokens(docs: DataFrame, packed: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Token rows of the sequences: sequence_id, offset, ids, for documents with distinct ``doc_id``.

    One row per piece; a sequence's rows in the order of ``offset`` are its content.
    """
    at = packed.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "length", "sequence_id", "offset"))).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_tokens(tokenizer_path)
        for batch, texts in tx.slices(batches, "text", 16 << 20):
            ids, bounds = encoder.encode(texts)
            rows = []
            for k, pieces in enumerate(batch.column("at").to_pylist()):
                own = np.append(ids[bounds[k] : bounds[k + 1]], np.uint32(end_id))
                rows += [(p["sequence_id"], p["offset"], own[p["start"] : p["start"] + p["length"]].astype(np.int32)) for p in pieces]
            seq, off, tokens = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(seq, pa.int64()), pa.array(off, pa.int64()), pa.array(list(tokens), pa.list_(pa.int32()))], names=["sequence_id", "offset", "ids"])

    return docs.select("doc_id", "text").join(at, "doc_id").select("text", "at").mapInArrow(run, "sequence_id long, offset long, ids array<int>")
