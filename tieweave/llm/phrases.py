"""Phrase collocations from depth-truncated suffix trees that are built group by group.

The suffixes of all word sequences are cut at ``DEPTH`` words. They are dealt out vertically: by the
word they begin with, or, where more suffixes begin so than a group may hold, by their first two or
three words. Ranges of these prefixes that stay within the memory budget form groups. Each group is
sorted by itself and read as a tree: a node is a run of suffixes with the same first words, and its
count is the sum over the leaves below. No group needs another one, and a lost group is built again.

Suffixes end where a word is surely rare (a Bloom filter of frequent words decides; what it lets
through by mistake only costs room). Equal suffixes of a task are summed before they are sent, so a
passage repeated everywhere is one row of each task. Words are 64-bit hashes of language and word;
should two words share one, all hashes are drawn anew.

Null and empty texts have no words, a missing language is ``und``. Repeated rows count again. Very
long texts are read as one. No rows give no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from tieweave.llm import text as tx
from tieweave.session import cut

DEPTH = 4
LEAST_COUNT = 30
#: A candidate goes if a longer one around it has at least this share of its count, in per cent.
CONTAINED_PERCENT = 80
SCORE_FACTOR = 2_000_000
TOP = 2000
#: Suffixes of a group; 1 << 20 are about 100 MB while a group is sorted.
GROUP_SUFFIXES = 1 << 20
#: Suffixes that a task holds before it sums and sends them (16 bytes each); each group gets the words of its share once.
TASK_SUFFIXES = 1 << 20
SUFFIXES_AT_ONCE = 1 << 17
SLICE_BYTES = 4 << 20
#: Bits of the filter for each frequent word, and of the whole filter at most (32 MB).
FILTER_BITS_A_WORD, MOST_FILTER_BITS = 16, 1 << 28
#: Salts under which the best of a language are taken first.
SALTS = 64

BREAK, BLANK = 0x0A, 0x20
#: Piece ends become a line feed, blanks a space; A-Z fold.
_TABLE = bytes(BREAK if b in b".,;:!?\x0a\x0b\x0c\x0d" else BLANK if b in b" \t" else b + 32 if 65 <= b <= 90 else b for b in range(256))
NODE = "w1 long, w2 long, w3 long, w4 long"
KEY = ["w1", "w2", "w3", "w4"]


def pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words, the text of each, and a number that differs between words of different pieces."""
    mapped = tx.translated(texts, _TABLE)
    if not len(mapped) or mapped.buffers()[2] is None:
        return pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    offsets = np.frombuffer(mapped.buffers()[1], np.int32)[: len(mapped) + 1].astype(np.int64)
    data = np.frombuffer(mapped.buffers()[2], np.uint8)[: offsets[-1]]
    inside = (data != BREAK) & (data != BLANK)
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    starts[edges] = inside[edges]
    at = np.flatnonzero(starts)
    kept = np.concatenate([np.zeros(1, np.int32), np.cumsum(inside, dtype=np.int32)])
    words = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(np.append(kept[at], kept[-1])), pa.py_buffer(data[inside].tobytes())])
    owner = np.searchsorted(offsets, at, side="right") - 1
    return words, owner, np.cumsum(data == BREAK, dtype=np.int32)[at] + owner


def _languages(batch: pa.RecordBatch) -> tuple[np.ndarray, list[str]]:
    codes, distinct = tx.coded(batch.column("lang"))
    return codes, distinct.to_pylist()


def _hashes(codes: np.ndarray, distinct: pa.Array, lang_codes: np.ndarray, langs: list[str], seed: int) -> np.ndarray:
    """Hash of language and word, never zero."""
    # Mixed once more: the sum must not tell a word of a language from the same two the other way round.
    salt = tx.mixed(tx.word_hashes(pa.array(langs, pa.string())) + np.uint64(seed + 1))
    out = tx.mixed(tx.word_hashes(distinct)[codes] + salt[lang_codes])
    return np.where(out == 0, np.uint64(1), out)


def _read(batches: Iterator[pa.RecordBatch], seed: int):
    """Per slice of texts: hash of every word, whether the next word is in the same piece, and the parts they came from."""
    for batch, texts in tx.slices(batches, "text", SLICE_BYTES):
        words, owner, piece = pieces(texts)
        if not len(words):
            continue
        codes, distinct = tx.coded(words)
        lang_of, langs = _languages(batch)
        yield _hashes(codes, distinct, lang_of[owner], langs, seed), np.append(piece[1:] == piece[:-1], False), (codes, distinct, lang_of[owner], langs)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")


def word_counts(docs: DataFrame, seed: int) -> DataFrame:
    """h, lang, word, n of every distinct word of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hashes, _, (codes, distinct, lang_codes, langs) in _read(batches, seed):
            number, at, n = np.unique(lang_codes * len(distinct) + codes, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes[at].view(np.int64)), pa.array(langs, pa.string()).take(pa.array(number // len(distinct))), distinct.take(pa.array(number % len(distinct))), pa.array(n)],
                names=["h", "lang", "word", "n"],
            )

    return _texts(docs).mapInArrow(run, "h long, lang string, word string, n long").groupBy("h", "lang", "word").agg(F.sum("n").alias("n"))


def hashed_words(docs: DataFrame) -> tuple[DataFrame, int]:
    """``word_counts`` under the first seed that gives no two words one hash, and that seed."""
    seed = 0
    while True:
        words = cut(word_counts(docs, seed))
        if words.groupBy("h").agg(F.count(F.lit(1)).alias("n_words")).filter("n_words > 1").isEmpty():
            return words, seed
        seed += 1


class WordFilter:
    """Bloom filter with three bits a word: never misses a member."""

    def __init__(self, bits: int, lanes: np.ndarray):
        self.bits, self.lanes = bits, lanes

    @staticmethod
    def places(bits: int) -> list[Column]:
        return [F.shiftrightunsigned("h", s).bitwiseAND(F.lit(bits - 1)) for s in (0, 18, 36)]

    @classmethod
    def of(cls, words: DataFrame) -> WordFilter:
        n = words.count()
        bits = min(MOST_FILTER_BITS, 1 << max(16, (FILTER_BITS_A_WORD * n).bit_length()))
        place = words.select(F.explode(F.array(*cls.places(bits))).alias("p"))
        lane = place.select(F.shiftright("p", 6).alias("lane"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("bit"))
        found = lane.groupBy("lane").agg(F.bit_or("bit").alias("bits")).toArrow()
        lanes = np.zeros(bits >> 6, np.uint64)
        lanes[found.column("lane").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
        return cls(bits, lanes)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for shift in (0, 18, 36):
            place = (hashes >> np.uint64(shift)) & np.uint64(self.bits - 1)
            out &= (self.lanes[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) != 0
        return out


def suffixes(hashes: np.ndarray, joined: np.ndarray, known: np.ndarray) -> np.ndarray:
    """[suffix, DEPTH] of the suffixes that begin with two known words: cut at the end of the piece and before an unknown word (0)."""
    padded = np.concatenate([hashes, np.zeros(DEPTH, np.uint64)])
    go = np.concatenate([joined[:-1] & known[1:], np.zeros(DEPTH + 1, bool)]) if len(hashes) else np.zeros(DEPTH, bool)
    at = np.flatnonzero(known & go[: len(hashes)])
    out = np.zeros((len(at), DEPTH), np.uint64)
    alive = np.ones(len(at), bool)
    for d in range(DEPTH):
        if d:
            alive = alive & go[at + d - 1]
        out[:, d] = np.where(alive, padded[at + d], 0)
    return out


def prefix_hash(suffix: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Hash of the first ``depth`` words of every suffix."""
    out = np.zeros(len(suffix), np.uint64)
    for d in range(suffix.shape[1]):
        out = np.where(depth > d, tx.mixed(out + suffix[:, d] + np.uint64(d + 1)), out)
    return out


class Vertical:
    """Which group a suffix goes to: prefixes too frequent for a group, and where ranges of the others end."""

    def __init__(self, heavy: list[np.ndarray], bucket_bits: int, group_of_bucket: np.ndarray):
        self.heavy, self.bucket_bits, self.group_of_bucket = heavy, bucket_bits, group_of_bucket

    def depth(self, suffix: np.ndarray) -> np.ndarray:
        """Words of the shortest prefix that fits into a group, DEPTH if none does."""
        out = np.ones(len(suffix), np.int8)
        for d, heavy in enumerate(self.heavy, 1):
            at = np.flatnonzero(out == d)
            if len(heavy) and len(at):
                out[at[np.isin(prefix_hash(suffix[at], np.full(len(at), d)), heavy)]] += 1
        return out

    def groups(self, suffix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Group, and depth of the prefix, of every suffix."""
        depth = self.depth(suffix)
        return self.group_of_bucket[(prefix_hash(suffix, depth) >> np.uint64(64 - self.bucket_bits)).astype(np.int64)], depth


def _prefix_counts(docs: DataFrame, seed: int, known, heavy: list[np.ndarray]) -> DataFrame:
    """w1..w4, p, n: prefixes one word longer than the heavy ones of the last level, and their frequency."""
    d = len(heavy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hashes, joined, _ in _read(batches, seed):
            suffix = suffixes(hashes, joined, known.value.holds(hashes))
            suffix = suffix[np.isin(prefix_hash(suffix, np.full(len(suffix), d)), heavy[-1])]
            suffix = suffix[suffix[:, d] != 0]
            suffix[:, d + 1 :] = 0
            p, at, n = np.unique(prefix_hash(suffix, np.full(len(suffix), d + 1)), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([*[pa.array(suffix[at, k].view(np.int64)) for k in range(DEPTH)], pa.array(p.view(np.int64)), pa.array(n)], names=[*KEY, "p", "n"])

    return _texts(docs).mapInArrow(run, f"{NODE}, p long, n long").groupBy(*KEY, "p").agg(F.sum("n").alias("n"))


def _packed(load: np.ndarray, most: int) -> np.ndarray:
    """Group of every bucket: consecutive ones as far as they stay within ``most``."""
    out, group, held = np.zeros(len(load), np.int32), 0, 0
    for i, x in enumerate(load.tolist()):
        if held and held + x > most:
            group, held = group + 1, 0
        out[i], held = group, held + x
    return out


def vertical_partition(docs: DataFrame, frequent: DataFrame, seed: int, known, group_suffixes: int) -> tuple[Vertical, DataFrame]:
    """The groups, and the counts of the heavy prefixes of two words and more, whose nodes no group holds whole.

    A level has at most (words of the corpus / ``group_suffixes``) heavy prefixes, and there are 16
    buckets for each group: that many numbers reach the driver.
    """
    spark = docs.sparkSession

    def first_prefix(batches):
        for batch in batches:
            h = batch.column("h").to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(prefix_hash(h[:, None], np.ones(len(h), np.int8)).view(np.int64)), batch.column("n")], names=["p", "n"])

    level = cut(frequent.select("h", "n").mapInArrow(first_prefix, "p long, n long"))
    total = level.agg(F.sum("n")).first()[0] or 0
    bucket_bits = max(4, int(16 * total / group_suffixes).bit_length())
    load, heavy, counted = np.zeros(1 << bucket_bits, np.int64), [], None
    while True:
        bucket = F.shiftrightunsigned("p", 64 - bucket_bits)
        last = len(heavy) == DEPTH - 1
        light = level if last else level.filter(F.col("n") <= group_suffixes)
        found = light.groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("n")).toArrow()
        load[found.column("bucket").to_numpy()] += found.column("n").to_numpy()
        if last:
            break
        over = level.filter(F.col("n") > group_suffixes)
        if heavy:
            counted = over if counted is None else counted.unionByName(over)
        heavy.append(np.sort(over.select("p").toArrow().column("p").to_numpy().view(np.uint64)))
        if not len(heavy[-1]):
            break
        level = cut(_prefix_counts(docs, seed, known, heavy))
    # Whole suffixes of DEPTH words, summed by each task, are few rows however frequent they are.
    load = np.minimum(load, group_suffixes)
    if counted is None:
        counted = spark.createDataFrame([], f"{NODE}, p long, n long")
    return Vertical(heavy, bucket_bits, _packed(load, group_suffixes)), counted.select(*KEY, F.col("n").alias("a"))


def _order(suffix: np.ndarray) -> np.ndarray:
    """Lexicographic order of rows of four numbers, sorted as two."""
    pair = lambda a, b: (suffix[:, a].astype(np.int64) << 32) | suffix[:, b].astype(np.int64)
    return np.lexsort((pair(2, 3), pair(0, 1)))


def _summed(suffix: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct suffixes in order, and how often each occurs."""
    order = _order(suffix)
    suffix, n = suffix[order], n[order]
    new = np.ones(len(suffix), bool)
    new[1:] = (suffix[1:] != suffix[:-1]).any(axis=1)
    return suffix[new], np.add.reduceat(n, np.flatnonzero(new)) if len(n) else n


def squeezed(numbers: np.ndarray) -> list[bytes]:
    """Whole numbers as one compressed string for each of their bytes: those of equal place are alike."""
    places = numbers.astype(numbers.dtype.newbyteorder("<")).view(np.uint8).reshape(-1, numbers.dtype.itemsize)
    return [pa.compress(np.ascontiguousarray(place), codec="zstd", asbytes=True) for place in places.T]


def spread(parts: list[bytes], count: int) -> np.ndarray:
    """The ``count`` numbers that ``squeezed`` took."""
    places = np.empty((count, len(parts)), np.uint8)
    for k, part in enumerate(parts):
        places[:, k] = np.frombuffer(pa.decompress(part, decompressed_size=count, codec="zstd", asbytes=True), np.uint8)
    return places.view(f"<u{len(parts)}").ravel()


SENT = "grp int, n_words int, words array<binary>, n_rows int, codes array<binary>, depth array<binary>, n array<binary>"


def _plain_row(group: int, words: np.ndarray, codes: np.ndarray, depth: np.ndarray, n: np.ndarray) -> tuple:
    return group, words.tobytes(), np.asfortranarray(codes).tobytes(order="F"), depth.tobytes(), n.tobytes()


def _squeezed_row(group: int, words: np.ndarray, codes: np.ndarray, depth: np.ndarray, n: np.ndarray) -> tuple:
    """``words`` as distances of the sorted words, ``codes`` one column of numbers after the other."""
    columns = [part for column in codes.T for part in squeezed(np.ascontiguousarray(column))]
    return group, len(words), squeezed(np.diff(words, prepend=np.uint64(0))), len(codes), columns, squeezed(depth.astype(np.uint8)), squeezed(n.astype(np.uint64))


def sent_suffixes(docs: DataFrame, seed: int, known, vertical, squeeze: bool = False) -> DataFrame:
    """grp, words, codes, depth, n: the distinct suffixes of a task that go to a group, as numbers of its own word list.

    With ``squeeze`` the rows are those of ``SENT``, compressed for the shuffle.
    """
    schema = SENT if squeeze else "grp int, words binary, codes binary, depth binary, n binary"
    row_of, names = _squeezed_row if squeeze else _plain_row, [field.split()[0] for field in schema.split(", ")]

    def packed(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        words = np.unique(np.concatenate([w for w, _ in held]))
        suffix = np.concatenate([np.searchsorted(words, w).astype(np.int32)[codes] for w, codes in held])
        held.clear()
        suffix, n = _summed(suffix, np.ones(len(suffix), np.int64))
        dealt = [vertical.value.groups(words[suffix[at : at + SUFFIXES_AT_ONCE]]) for at in range(0, len(suffix), SUFFIXES_AT_ONCE)]
        group, depth = (np.concatenate(x) for x in zip(*dealt, strict=True))
        order = np.argsort(group, kind="stable")
        ends = np.flatnonzero(np.diff(group[order], append=-1)) + 1
        for first, last in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            at = order[first:last]
            used, own = np.unique(suffix[at], return_inverse=True)
            own = own.reshape(len(at), DEPTH).astype("<u2" if len(used) <= 1 << 16 else "<u4")
            row = row_of(int(group[order[first]]), words[used].astype("<u8"), own, depth[at].astype("<i1"), n[at].astype("<i8"))
            kinds = [pa.int32() if isinstance(x, int) else pa.list_(pa.binary()) if isinstance(x, list) else pa.binary() for x in row]
            yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for hashes, joined, _ in _read(batches, seed):
            suffix = suffixes(hashes, joined, known.value.holds(hashes))
            words, codes = np.unique(suffix, return_inverse=True)
            if len(words):
                held.append((words, codes.reshape(suffix.shape).astype(np.int32)))
            size += len(suffix)
            if size >= TASK_SUFFIXES:
                yield from packed(held)
                size = 0
        if held:
            yield from packed(held)

    return _texts(docs).mapInArrow(run, schema)


def tree_nodes(suffix: np.ndarray, depth: np.ndarray, n: np.ndarray, least: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(words, count) of the nodes of 2 to DEPTH words that are whole here: sorted suffixes are the leaves, a node sums its run of them."""
    order = _order(suffix)
    suffix, depth, n = suffix[order], depth[order], n[order]
    out, differs = [], np.zeros(len(suffix), bool)
    differs[:1] = True
    totals = np.concatenate([[0], np.cumsum(n)])
    for d in range(1, DEPTH + 1):
        differs[1:] |= suffix[1:, d - 1] != suffix[:-1, d - 1]
        firsts = np.flatnonzero(differs)
        count = totals[np.append(firsts[1:], len(suffix))] - totals[firsts]
        # Nodes above the prefix of a group are spread over groups.
        keep = (count >= least) & (suffix[firsts, d - 1] != 0) & (depth[firsts] <= d)
        if d > 1 and keep.any():
            words = suffix[firsts[keep]].copy()
            words[:, d:] = 0
            out.append((words, count[keep]))
    return out


def _group_nodes(least: int):
    def build(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        lists = [np.cumsum(spread(row["words"], row["n_words"]), dtype=np.uint64) for row in rows]
        # Code 0 stays the end of a suffix.
        words = np.unique(np.concatenate([np.zeros(1, np.uint64), *lists]))
        size = sum(row["n_rows"] for row in rows)
        suffix, depth, n = np.empty((size, DEPTH), np.int32), np.empty(size, np.int8), np.empty(size, np.int64)
        at = 0
        for own, row in zip(lists, rows, strict=True):
            to, code, width = at + row["n_rows"], np.searchsorted(words, own).astype(np.int32), len(row["codes"]) // DEPTH
            for k in range(DEPTH):
                suffix[at:to, k] = code[spread(row["codes"][k * width : (k + 1) * width], row["n_rows"])]
            depth[at:to], n[at:to] = spread(row["depth"], row["n_rows"]), spread(row["n"], row["n_rows"])
            at = to
        nodes = tree_nodes(suffix, depth, n, least)
        found = np.concatenate([w for w, _ in nodes]) if nodes else np.zeros((0, DEPTH), np.int32)
        count = np.concatenate([c for _, c in nodes]) if nodes else np.zeros(0, np.int64)
        return pa.table([*[pa.array(words[found[:, k]].view(np.int64)) for k in range(DEPTH)], pa.array(count, pa.int64())], names=[*KEY, "a"])

    return build


def phrase_counts(docs: DataFrame, frequent: DataFrame, seed: int, least: int, group_suffixes: int = GROUP_SUFFIXES) -> DataFrame:
    """w1..w4 (0 beyond the end), a: every phrase of 2 to DEPTH words that occurs ``least`` times or more within pieces."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(WordFilter.of(frequent))
    vertical, heavy = vertical_partition(docs, frequent, seed, known, group_suffixes)
    sent = sent_suffixes(docs, seed, known, spark.sparkContext.broadcast(vertical), squeeze=True)
    return sent.groupBy("grp").applyInArrow(_group_nodes(least), f"{NODE}, a long").unionByName(heavy.filter(F.col("a") >= least))


def _key(*words) -> Column:
    """Struct of up to DEPTH words, zeros beyond."""
    return F.struct(*[(words[k] if k < len(words) else F.lit(0).cast("long")).alias(c) for k, c in enumerate(KEY)])


def _by_length(make) -> Column:
    """``make(words)`` for phrases of 2, 3 and 4 words."""
    w = [F.col(c) for c in KEY]
    return F.when(F.col("w4") != 0, make(w)).when(F.col("w3") != 0, make(w[:3])).otherwise(make(w[:2]))


def scored(counts: DataFrame, frequent: DataFrame) -> DataFrame:
    """w1..w4, a, l, r, score of every candidate that no longer one contains."""
    words = frequent.select(_key(F.col("h")).alias("part"), F.col("n").alias("f"))
    parts = words.unionByName(counts.select(_key(*[F.col(c) for c in KEY]).alias("part"), F.col("a").alias("f")))
    cuts = _by_length(lambda w: F.array(*[F.struct(F.lit(k).alias("k"), _key(*w[:k]).alias("first"), _key(*w[k:]).alias("rest")) for k in range(1, len(w))]))
    each = counts.select(*KEY, "a", F.explode(cuts).alias("cut")).select(*KEY, "a", "cut.k", "cut.first", "cut.rest")
    lr = (
        each.join(parts.select(F.col("part").alias("first"), F.col("f").alias("l")), "first")
        .join(parts.select(F.col("part").alias("rest"), F.col("f").alias("r")), "rest")
    )
    exact = F.expr(f"(cast({SCORE_FACTOR} as decimal(10, 0)) * cast(a as decimal(19, 0))) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0)))")
    lowest = lr.withColumn("score", exact).groupBy(*KEY, "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = F.when(F.col("w4") != 0, F.array(*[_key(*[F.col(c) for c in KEY[i : i + n]]) for n in (2, 3) for i in range(DEPTH - n + 1)])).otherwise(
        F.array(_key(F.col("w1"), F.col("w2")), _key(F.col("w2"), F.col("w3")))
    )
    around = counts.filter("w3 <> 0").select(F.explode(inner).alias("part"), "a").groupBy("part").agg(F.max("a").alias("around"))
    held = lowest.withColumn("part", _key(*[F.col(c) for c in KEY])).join(around, "part", "left")
    percent = F.lit(CONTAINED_PERCENT).cast("decimal(10, 0)")
    free = F.col("around").isNull() | (F.col("around").cast("decimal(19, 0)") * 100 < F.col("a").cast("decimal(19, 0)") * percent)
    return held.filter(free).select(*KEY, "a", "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, least: int = LEAST_COUNT, top: int = TOP, group_suffixes: int = GROUP_SUFFIXES) -> DataFrame:
    """Per language the best phrases: lang, rank, phrase, a, l, r, n, score."""
    words, seed = hashed_words(docs)
    frequent = cut(words.filter(F.col("n") >= least))
    counts = cut(phrase_counts(docs, frequent, seed, least, group_suffixes))
    found = scored(counts, frequent)
    named = found
    for k, c in enumerate(KEY):
        held = frequent.select(F.col("h").alias(c), F.col("word").alias(f"t{k}"), *([F.col("lang")] if not k else []))
        named = named.join(held, c, "inner" if k < 2 else "left")
    phrase = named.withColumn("phrase", F.concat_ws(" ", *[f"t{k}" for k in range(DEPTH)]))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    first = phrase.withColumn("place", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*order))).filter(F.col("place") <= top)
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
