"""Spelling variants: words one edit apart, found by Gram matrices of letter counts.

One inserted, deleted or replaced code point moves the letter-count vector of a word by a squared
distance of 1 or 2. Words are laid out in blocks by how many of their letters fall into each of a
few letter groups (so all words of a block have one length); one edit leads into the same block, into
one with a letter more in one group, or into one with a letter moved between two groups. For every
such pair of blocks one matrix product gives all squared distances; pairs at two or less are
verified letter by letter. There are as many letter groups as keep blocks small, and blocks are cut
into parts of bounded size, so every product is bounded and no block is one task. Each word sums up
its own near words before anything is shuffled by word.

Words are runs of A-Z, a-z and U+00C0 to U+00FF, so a code point is one byte of Latin-1. Null and
empty texts have no words. Rows count by themselves: a repeated row counts again. A missing doc_id is
written as nothing. A word without near words has no form and is its own root. Words of any length
are compared whole. No rows give no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tieweave.session import cut

LEAST_LENGTH = 7
LEAST_COUNT = 2
#: One of so many distinct (document, run) pairs loses a code point.
DELETE_ONE_OF = 31
#: A form is at least so many times as frequent as its variant.
FORM_FACTOR = 10
#: Words and bytes of a block part.
PART_WORDS, PART_BYTES = 2048, 1 << 20
#: The words of a block are to be no more than this, if letter groups can do it.
BLOCK_WORDS = 1024
GROUPS = (4, 6, 8, 11, 15, 20, 26)
LETTERS = 256


def counted_words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n (its occurrences over all texts, after the deletions)."""
    # A maximal run that is long enough; shorter ones can be no word, with or without a deletion.
    found = docs.select(F.col("doc_id").cast("string").alias("id"), F.explode(F.regexp_extract_all("text", F.lit(f"([A-Za-z\\u00C0-\\u00FF]{{{least_length},}})"), F.lit(1))).alias("found"))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    run = found.select("id", F.when(F.col("found").rlike("[A-Z]"), F.translate("found", upper, lower)).otherwise(F.col("found")).alias("run"))
    hashed = run.withColumn("h", F.crc32(F.concat(F.coalesce("id", F.lit("")), F.lit(":"), F.col("run")).cast("binary")))
    at = F.pmod("h", F.length("run")).cast("int")
    shorter = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    word = F.when(F.col("h") % DELETE_ONE_OF == 0, shorter).otherwise(F.col("run"))
    return (
        hashed.select(word.alias("word")).filter(F.length("word") >= least_length)
        .groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)
    )


def letter_groups(counts: np.ndarray, n_groups: int) -> np.ndarray:
    """Group of every letter: the most frequent first, each into the group with the fewest letters so far."""
    load, out = np.zeros(n_groups), np.zeros(LETTERS, np.int64)
    for letter in np.argsort(-counts, kind="stable"):
        out[letter] = int(np.argmin(load))
        load[out[letter]] += counts[letter] + 1e-9
    return out


def _encoded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Latin-1 bytes of all words one after another, and where each begins and the last ends."""
    raw = [w.encode("latin-1") for w in column.to_pylist()]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in raw], dtype=np.int64)])


def _group_counts(column: pa.Array, groups: np.ndarray, n_groups: int) -> np.ndarray:
    letters, bounds = _encoded(column)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    return np.bincount(owner * n_groups + groups[letters], minlength=(len(bounds) - 1) * n_groups).reshape(-1, n_groups)


def _letter_counts(words: DataFrame) -> np.ndarray:
    """How often each of the 256 letters occurs in the words; that many numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LETTERS, np.int64)
        for batch in batches:
            total += np.bincount(_encoded(batch.column("word"))[0], minlength=LETTERS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(LETTERS)), pa.array(total)], names=["letter", "n"])

    found = words.select("word").mapInArrow(run, "letter long, n long").groupBy("letter").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(LETTERS, np.int64)
    out[found.column("letter").to_numpy()] = found.column("n").to_numpy()
    return out


def _keyed(words: DataFrame, groups: np.ndarray, n_groups: int) -> DataFrame:
    """words with ``block``: the number of letters in each group, as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                counts = _group_counts(batch.column("word"), groups, n_groups).astype(np.int32)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(0, counts.size + 1, n_groups), pa.int32()), pa.array(counts.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), keys], names=["word", "n", "block"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, block array<int>")


def in_blocks(words: DataFrame) -> DataFrame:
    """words with their block, under the fewest letter groups that keep the largest block at ``BLOCK_WORDS``."""
    letters = _letter_counts(words)
    for n_groups in GROUPS:
        keyed = _keyed(words, letter_groups(letters, n_groups), n_groups)
        if n_groups == GROUPS[-1] or (keyed.groupBy("block").count().agg(F.max("count")).first()[0] or 0) <= BLOCK_WORDS:
            return keyed


def parts(keyed: DataFrame) -> DataFrame:
    """block, part, letters, ns: the words of a block, all of one length, in parts of about ``PART_WORDS`` words or ``PART_BYTES`` bytes at most."""
    length = F.aggregate("block", F.lit(0), lambda a, x: a + x)
    sizes = keyed.groupBy("block").agg(F.count(F.lit(1)).alias("n_words"))
    n_parts = F.ceil(F.greatest(F.col("n_words") / PART_WORDS, F.col("n_words") * length / PART_BYTES)).cast("long")
    dealt = keyed.join(sizes.select(F.col("block").alias("_block"), n_parts.alias("n_parts")), F.col("block") == F.col("_block")).drop("_block")
    # A hashed share exceeds its mean a little, never by much.
    part = F.pmod(F.xxhash64("word"), F.col("n_parts"))
    held = dealt.groupBy("block", part.alias("part")).agg(F.collect_list(F.struct("word", "n")).alias("members"))
    return held.select("block", "part", F.encode(F.array_join("members.word", ""), "ISO-8859-1").alias("letters"), F.col("members.n").alias("ns"))


def _next_blocks(n: str) -> str:
    """SQL array of the block itself and of those one edit leads to, each unordered pair once."""
    more = f"transform(sequence(0, {n} - 1), i -> transform(block, (c, k) -> c + int(k = i)))"
    moved = (
        f"flatten(transform(sequence(0, {n} - 1), i -> transform(filter(sequence(0, {n} - 1), j -> j > i AND block[j] > 0), "
        f"j -> transform(block, (c, k) -> c + int(k = i) - int(k = j)))))"
    )
    return f"concat(array(block), {more}, {moved})"


def _counts(words: np.ndarray, used: np.ndarray) -> np.ndarray:
    """Letter counts of words of one length, for the letters that are used."""
    place = np.cumsum(used) - 1
    n = np.bincount((np.arange(len(words))[:, None] * int(used.sum()) + place[words]).ravel(), minlength=len(words) * int(used.sum()))
    # Products of whole numbers are exact below 2**24 in the short form, 2**53 in the long.
    return n.reshape(len(words), -1).astype(np.float32 if words.shape[1] < 2000 else np.float64)


def near_words(x: np.ndarray, y: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (of x, of y) of all pairs one edit apart; ``same``: both are one list, pairs come once.

    Words are rows of letters; those of y have as many as those of x, or one more.
    """
    used = (np.bincount(x.ravel(), minlength=LETTERS) + np.bincount(y.ravel(), minlength=LETTERS)) > 0
    cx, cy = _counts(x, used), _counts(y, used)
    # |p - q|^2 <= 2 as a bound on the product.
    least = ((cx * cx).sum(axis=1)[:, None] + (cy * cy).sum(axis=1)[None, :] - 2) / 2
    i, j = np.nonzero(cx @ cy.T >= least)
    if same:
        i, j = i[i < j], j[i < j]
    near = np.zeros(len(i), bool)
    step = max(1, (1 << 22) // max(1, y.shape[1]))
    for at in range(0, len(i), step):
        p, q = x[i[at : at + step]], y[j[at : at + step]]
        if p.shape[1] == q.shape[1]:
            near[at : at + step] = (p != q).sum(axis=1) == 1
        else:
            # One letter more: what is equal from the left and from the right covers the shorter word.
            left = np.cumprod(p == q[:, :-1], axis=1, dtype=np.uint8).sum(axis=1, dtype=np.int64)
            right = np.cumprod((p == q[:, 1:])[:, ::-1], axis=1, dtype=np.uint8).sum(axis=1, dtype=np.int64)
            near[at : at + step] = left + right >= p.shape[1]
    return i[near], j[near]


def _texts(words: np.ndarray, at: np.ndarray) -> list[str]:
    return [w.tobytes().decode("latin-1") for w in words[at]]


def _sums(words: np.ndarray, at: np.ndarray, other: np.ndarray, other_ns: np.ndarray, other_at: np.ndarray) -> pa.RecordBatch:
    """For every word that occurs in ``at``: how many near words, and the most frequent, of equals the least."""
    used, place = np.unique(other_at, return_inverse=True)
    rank = np.unique(np.ascontiguousarray(other[used]).view(f"V{other.shape[1]}").ravel(), return_inverse=True)[1][place]
    order = np.lexsort((rank, -other_ns[other_at], at))
    firsts = np.flatnonzero(np.diff(at[order], prepend=-1))
    best = other_at[order[firsts]]
    columns = [pa.array(_texts(words, at[order[firsts]]), pa.string()), pa.array(np.diff(np.append(firsts, len(at)))), pa.array(other_ns[best]), pa.array(_texts(other, best), pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["word", "n_near", "best_n", "best"])


def _stacks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]]:
    """Letters and counts of both sides: all parts of a batch that meet one part and have one length make one product."""
    keys = batch.column("met").to_numpy(), batch.column("len_a").to_numpy(), batch.column("itself").to_numpy(zero_copy_only=False)
    order = np.lexsort(keys[::-1])
    held, size = [], 0
    for place, k in enumerate(order.tolist()):
        letters = np.frombuffer(batch.column("a")[k].as_buffer(), np.uint8).reshape(-1, int(keys[1][k]))
        held.append((letters, batch.column("ns_a")[k].values.to_numpy()))
        size += len(letters)
        following = order[place + 1] if place + 1 < len(order) else None
        if following is None or size >= PART_WORDS or any(x[k] != x[following] for x in keys):
            other = np.frombuffer(batch.column("b")[k].as_buffer(), np.uint8).reshape(-1, int(batch.column("len_b")[k].as_py()))
            yield np.concatenate([x for x, _ in held]), np.concatenate([n for _, n in held]), other, batch.column("ns_b")[k].values.to_numpy(), bool(keys[2][k])
            held, size = [], 0


def near_summary(keyed: DataFrame) -> DataFrame:
    """word, n_near, best_n, best: number of near words and the most frequent of them (ties: the least), of words that have any."""
    blocks = cut(parts(keyed)).withColumn("len", F.aggregate("block", F.lit(0), lambda a, x: a + x))
    left = blocks.select("block", "part", F.col("letters").alias("a"), F.col("ns").alias("ns_a"), F.col("len").alias("len_a"), F.explode(F.expr(_next_blocks("size(block)"))).alias("next"))
    right = blocks.select(F.col("block").alias("_block"), F.col("part").alias("_part"), F.col("letters").alias("b"), F.col("ns").alias("ns_b"), F.col("len").alias("len_b"))
    same = F.col("block") == F.col("_block")
    # Parts of one block meet once.
    met = left.join(right, (F.col("next") == F.col("_block")) & (~same | (F.col("part") <= F.col("_part"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, nx, y, ny, itself in _stacks(batch):
                i, j = near_words(x, y, itself)
                if len(i):
                    yield _sums(x, i, y, ny, j)
                    yield _sums(y, j, x, nx, i)

    one = F.struct("_block", "_part")
    sides = met.select("a", "ns_a", "len_a", "b", "ns_b", "len_b", F.xxhash64(one).alias("met"), (same & (F.col("part") == F.col("_part"))).alias("itself"))
    each = sides.mapInArrow(run, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    return each.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of every row of (word, form): the end of the chain of forms.

    Each step at least multiplies the count by ``FORM_FACTOR``, so a chain is short and its length is
    halved each round.
    """
    at = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        further = at.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        moved = at.join(further, F.col("root") == F.col("_word"), "left").select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved"))
        moved = cut(moved)
        at = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            return at


def variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, factor: int = FORM_FACTOR) -> DataFrame:
    """Per word: word, n, n_near, form, form_n, root."""
    words = cut(counted_words(docs, least_length, least_count))
    near = cut(near_summary(in_blocks(words)))
    joined = words.join(near, "word", "left")
    has_form = F.col("best_n") >= factor * F.col("n")
    all_words = joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has_form, F.col("best")).alias("form"), F.when(has_form, F.col("best_n")).alias("form_n"))
    ends = roots(all_words.filter("form IS NOT NULL"))
    return all_words.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
