"""Word streams of whole Arrow columns, for operators that work inside Python tasks.

A text column is turned into one array of words plus the bounds of each text, without a
Python object per word. Null texts have no words. Work is cut into slices of bounded bytes,
so memory does not follow the batch; one text is never cut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 8 << 20
SPACE = 32


def byte_table(is_word: Callable[[int], bool], fold: bool) -> bytes:
    """Byte map for UTF-8: separators become a space, A-Z fold if asked; lengths stay."""
    return bytes((b + 32 if fold and 65 <= b <= 90 else b) if is_word(b) else SPACE for b in range(256))


def _is_space(b: int) -> bool:
    return b == SPACE or 0x09 <= b <= 0x0D


#: Words are runs without ASCII white space.
BLANK_SEPARATED = byte_table(lambda b: not _is_space(b), fold=False)
BLANK_SEPARATED_FOLDED = byte_table(lambda b: not _is_space(b), fold=True)
#: Words are runs of ASCII letters and digits and of everything beyond ASCII, folded.
ALPHANUMERIC_FOLDED = byte_table(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128, fold=True)


def as_strings(column: pa.Array) -> pa.Array:
    """Plain 32-bit string array without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.string()), "")


def translated(texts: pa.Array, table: bytes) -> pa.Array:
    """Texts with every byte mapped by ``table`` (which keeps UTF-8 well-formed)."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    first, last = int(offsets[0]), int(offsets[-1])
    data = raw.slice(first, last - first).to_pybytes().translate(table) if raw is not None and last > first else b""
    return pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer((offsets - first).astype(np.int32)), pa.py_buffer(data)])


def parts(texts: pa.Array, separator: str) -> tuple[pa.Array, np.ndarray]:
    """Non-empty parts of all texts and ``bounds``: text i has parts bounds[i]:bounds[i + 1]."""
    split = pc.split_pattern(texts, separator)
    flat = split.flatten()
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    ends = np.concatenate([[0], np.cumsum(full)])
    starts = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))]).astype(np.int64)
    return flat.filter(pa.array(full)), ends[starts]


def words(texts: pa.Array, table: bytes) -> tuple[pa.Array, np.ndarray]:
    return parts(translated(texts, table), " ")


def coded(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Whole-number code of every value, and the distinct values by code."""
    if not len(values):
        return np.zeros(0, np.int64), pa.array([], values.type)
    found = values.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Runs of rows whose texts have at most ``most`` bytes (a longer text comes alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = as_strings(batch.column(column))
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(at, to - at), texts.slice(at, to - at)
            at = to


def owners(bounds: np.ndarray) -> np.ndarray:
    """Text index of every word."""
    return np.repeat(np.arange(len(bounds) - 1, dtype=np.int64), np.diff(bounds))


def ids(values: np.ndarray) -> tuple[np.ndarray, int]:
    """Dense exact numbering of whole numbers, and how many there are."""
    if not len(values):
        return values.astype(np.int64), 0
    order = np.argsort(values, kind="stable")
    new = np.concatenate([[True], np.diff(values[order]) != 0])
    out = np.empty(len(values), np.int64)
    out[order] = np.cumsum(new) - 1
    return out, int(new.sum())


def mixed(values: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    z = values.astype(np.uint64, copy=True)
    z ^= z >> np.uint64(30)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(27)
    z *= np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return z


def word_hashes(distinct: pa.Array) -> np.ndarray:
    """Stable 64-bit hash of every string."""
    from pandas.util import hash_array

    if not len(distinct):
        return np.zeros(0, np.uint64)
    return mixed(hash_array(distinct.to_numpy(zero_copy_only=False).astype(object), categorize=False))
