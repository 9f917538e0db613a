"""N-gram Jaccard join: texts linked by the share of word n-grams they have in common.

Texts with equal word sequences are one class from the start. Each class orders its n-grams
from rare to frequent, by a count sketch of the whole corpus, and lists the prefix that any
partner must share one n-gram with. Entries meet on the n-gram; length and positional bounds
and a parity bitmap of the n-grams (a lower bound on their difference, as a suffix filter
gives) drop pairs that cannot reach the threshold, and each pair left is verified once.

Only connectivity is asked for, so an entry is first linked to the one before it and to the
first one on its n-gram, which is the text with the fewest n-grams of its own. Pairs inside one
component are then never looked at, and every pair across components that passes the bounds is
verified: no link between components is lost, and large groups of near copies need few pairs.

N-grams are 64-bit hashes; two different n-grams of one pair share a hash with a probability
near 1e-13. Null and empty texts have no n-grams and stay alone. Shorter texts than ``n`` words
are one n-gram. Repeated rows share a class.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tieweave.llm import text as tx
from tieweave.llm.components import components
from tieweave.llm.names import unused
from tieweave.session import broadcast_if_small, cut

WORDS = 4
#: Least Jaccard share in per cent.
PERCENT = 85
SKETCH_BITS = 16
#: Slots of the parity map that goes with an entry.
COARSE_BITS = 512
#: An entry knows so many n-grams that stand before it.
EARLIER = 16
#: So many classes (an id, a digest and a number each) are sent to the tasks at most; more are joined by shuffle.
WANTED_ROWS = 500_000

_FACTORS = tx.mixed(np.arange(1, 65, dtype=np.uint64))


def shingle_sets(texts: pa.Array, n: int) -> tuple[list[np.ndarray], list[bytes | None]]:
    """Sorted distinct n-gram hashes of each text, and a digest of its word sequence."""
    words, bounds = tx.words(texts, tx.BLANK_SEPARATED_FOLDED)
    codes, distinct = tx.coded(words)
    hashes = tx.word_hashes(distinct)[codes]
    owner, count = tx.owners(bounds), len(hashes)
    starts = np.flatnonzero(owner[: max(0, count - n + 1)] == owner[n - 1 :])
    total = np.zeros(len(starts), np.uint64)
    for k in range(n):
        total += hashes[starts + k] * (_FACTORS[k] | np.uint64(1))
    grams = tx.mixed(total)
    at = np.searchsorted(owner[starts], np.arange(len(bounds)))
    sets, keys = [], []
    for i in range(len(bounds) - 1):
        own = hashes[bounds[i] : bounds[i + 1]]
        if not len(own):
            sets.append(np.zeros(0, np.uint64))
            keys.append(None)
            continue
        keys.append(hashlib.md5(own.tobytes()).digest())
        if len(own) < n:
            sets.append(tx.mixed(np.array([(own * _FACTORS[len(_FACTORS) // 2 : len(_FACTORS) // 2 + len(own)]).sum() + np.uint64(len(own))], np.uint64)))
        else:
            sets.append(np.unique(grams[at[i] : at[i + 1]]))
    return sets, keys


def _bucket(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def parity_bitmap(grams: np.ndarray) -> bytes:
    """Bit i: whether an odd number of n-grams fall into slot i, of at least two slots an n-gram."""
    slots = 1 << max(6, int(2 * len(grams) - 1).bit_length())
    return np.packbits(np.bincount((grams & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1, bitorder="little").tobytes()


def coarse_bitmap(grams: np.ndarray) -> np.ndarray:
    """Parity map of fixed size, for the join condition."""
    return np.packbits(np.bincount((grams & np.uint64(COARSE_BITS - 1)).astype(np.int64), minlength=COARSE_BITS) & 1, bitorder="little").view(np.int64)


def least_difference(a: bytes, b: bytes) -> int:
    """Lower bound on the number of n-grams that are in one of two sets only."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    # Slots are the hash modulo a power of two, so a map folds onto half its size.
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _enough(common: Column, percent: int, size_a: Column, size_b: Column) -> Column:
    return (100 + percent) * common >= percent * (size_a + size_b)


def raw_key() -> Column:
    """Hash of the text as it is; with the id it tells rows apart."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def corpus_scan(docs: DataFrame, n: int) -> DataFrame:
    """Rows (doc_id, raw_key, text_key, n_shingles) of all documents, and one row per task with its sketch ``counts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "raw_key", "text_key", "n_shingles", "counts"]
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch, texts in tx.slices(batches, "text"):
            sets, keys = shingle_sets(texts, n)
            total += np.bincount(_bucket(np.concatenate(sets)), minlength=len(total))
            m = len(sets)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("raw_key"), pa.array(keys, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.nulls(m, pa.list_(pa.int64()))], names=names
            )
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.array([total], pa.list_(pa.int64()))], names=names)

    return docs.select("doc_id", "text", raw_key().alias("raw_key")).mapInArrow(run, "doc_id long, raw_key long, text_key binary, n_shingles long, counts array<long>")


def _classes(docs: DataFrame, sketch, n: int, percent: int) -> DataFrame:
    """One row per distinct word sequence: its prefix n-grams from rare to frequent, size, bitmap, least doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        for batch, texts in tx.slices(batches, "text"):
            sets, keys = shingle_sets(texts, n)
            rows = [i for i, s in enumerate(sets) if len(s)]
            prefixes = []
            for i in rows:
                own = sets[i]
                order = np.lexsort((own, counts[_bucket(own)]))
                prefixes.append(own[order[: len(own) - -(-percent * len(own) // 100) + 1]].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array([keys[i] for i in rows], pa.binary()), pa.array([len(sets[i]) for i in rows], pa.int64()),
                    pa.array(prefixes, pa.list_(pa.int64())), pa.array([parity_bitmap(sets[i]) for i in rows], pa.binary()), pa.array([coarse_bitmap(sets[i]) for i in rows], pa.list_(pa.int64())),
                ],
                names=["doc_id", "text_key", "size", "prefix", "bitmap", "coarse"],
            )

    each = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, text_key binary, size long, prefix array<long>, bitmap binary, coarse array<long>")
    return cut(
        each.groupBy("text_key").agg(F.min("doc_id").alias("first_id"), F.any_value("size").alias("size"), F.any_value("prefix").alias("prefix"), F.any_value("bitmap").alias("bitmap"), F.any_value("coarse").alias("coarse"))
        .withColumn("node", F.monotonically_increasing_id())
    )


def _shared_entries(classes: DataFrame, percent: int) -> DataFrame:
    """Prefix entries whose n-gram another class of fitting size lists too.

    ``before``: how many of the class's shared entries stand before this one, ``lone``: how many
    of its entries nobody shares. Sizes on either side of an entry are the nearest there are: if
    neither fits, none does.
    """
    entries = classes.select("node", F.col("size").cast("int").alias("size"), F.size("prefix").alias("listed"), F.posexplode("prefix").alias("pos", "gram"))
    w = Window.partitionBy("gram").orderBy("size", "node")
    near = entries.withColumns({"_less": F.lag("size").over(w), "_more": F.lead("size").over(w)})
    shared = near.filter((100 * F.col("_less") >= percent * F.col("size")) | (100 * F.col("size") >= percent * F.col("_more")))
    own = Window.partitionBy("node")
    return cut(
        shared.withColumns({"before": F.row_number().over(own.orderBy("pos")) - 1, "lone": F.col("listed") - F.count(F.lit(1)).over(own).cast("int")})
        .select("node", "size", "pos", "before", "lone", "gram")
    )


def _possible(a: str, b: str, percent: int) -> Column:
    """Length and positional bounds for two entries (struct columns) on one n-gram.

    Before the n-gram, the two have at most those entries in common that anybody shares; after
    it, at most all that is left of the shorter rest.
    """
    size_a, size_b = F.col(f"{a}.size"), F.col(f"{b}.size")
    most = F.least(f"{a}.before", f"{b}.before") + F.least(size_a - F.col(f"{a}.pos"), size_b - F.col(f"{b}.pos"))
    return (100 * size_b >= percent * size_a) & (100 * size_a >= percent * size_b) & _enough(most, percent, size_a, size_b)


def _pairs(met: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) with sizes, of entries x and y (struct columns) that no shared n-gram rules out."""
    every = met.select(
        F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"), F.col("x.size").alias("size_a"), F.col("y.size").alias("size_b"),
        _possible("x", "y", percent).alias("fits"),
    )
    # The two sizes only enter by their sum and ratio, so their order is free.
    return every.groupBy("a", "b").agg(F.min("fits").alias("fits"), F.any_value("size_a").alias("size_a"), F.any_value("size_b").alias("size_b")).filter("fits").drop("fits")


def _first_pairs(shared: DataFrame, percent: int) -> DataFrame:
    """Every entry with the one before it and the first one of its n-gram; classes with the fewest lone entries come first."""
    entry = F.struct("node", "size", "pos", "before")
    w = Window.partitionBy("gram").orderBy("lone", "size", "node")
    met = shared.select(entry.alias("x"), F.array_compact(F.array(F.lag(entry).over(w), F.first(entry).over(w))).alias("ys"))
    return _pairs(met.select("x", F.explode(F.array_distinct("ys")).alias("y")).filter(F.col("x.node") != F.col("y.node")), percent)


def _coarsely_near(x: str, y: str, percent: int) -> Column:
    """Whether the coarse maps of two entries leave the threshold in reach."""
    apart = sum((F.bit_count(F.col(f"{x}.coarse")[k].bitwiseXOR(F.col(f"{y}.coarse")[k])) for k in range(1, COARSE_BITS // 64)), F.bit_count(F.col(f"{x}.coarse")[0].bitwiseXOR(F.col(f"{y}.coarse")[0])))
    sizes = F.col(f"{x}.size") + F.col(f"{y}.size")
    return (100 + percent) * (sizes - apart) >= 2 * percent * sizes


def _met_across(shared: DataFrame, classes: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """Entries x and y of all pairs that no bound rules out between different components of ``links``.

    N-grams have one order, so a pair that shares an earlier one meets there as well. It is left
    to that one where both entries know of it, and no pair is left out at the first one it shares.
    """
    named = shared.join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    # N-grams of two classes are settled by the first pairs.
    mixed = named.groupBy("gram").agg(F.min("component").alias("_low"), F.max("component").alias("_high"), F.count(F.lit(1)).alias("_n")).filter("_low <> _high AND _n > 2").select("gram")
    last = Window.partitionBy("node").orderBy("pos").rowsBetween(-EARLIER, -1)
    held = named.join(mixed, "gram", "left_semi").withColumn("earlier", F.collect_list("gram").over(last))
    left = held.join(classes.select("node", "coarse"), "node").select("gram", "component", F.struct("node", "size", "pos", "before", "coarse", "earlier").alias("x"))
    right = left.select(F.col("gram").alias("_gram"), F.col("component").alias("_component"), F.col("x").alias("y"))
    first = ~F.arrays_overlap("x.earlier", "y.earlier")
    met = left.join(right, (F.col("gram") == F.col("_gram")) & (F.col("component") < F.col("_component")) & _possible("x", "y", percent) & _coarsely_near("x", "y", percent) & first)
    return met.select("x", "y")


def _pairs_across(shared: DataFrame, classes: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    return _pairs(_met_across(shared, classes, links, percent), percent)


def _near_bitmaps(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    maps = classes.select("node", "bitmap")
    held = (
        pairs.join(maps.select(F.col("node").alias("a"), F.col("bitmap").alias("bits_a")), "a")
        .join(maps.select(F.col("node").alias("b"), F.col("bitmap").alias("bits_b")), "b")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size_a").to_numpy().astype(np.int64) + batch.column("size_b").to_numpy().astype(np.int64)
            apart = np.array([least_difference(x, y) for x, y in zip(batch.column("bits_a").to_pylist(), batch.column("bits_b").to_pylist(), strict=True)], np.int64)
            # common = (sizes - difference) / 2
            keep = (100 + percent) * (sizes - apart) >= 2 * percent * sizes
            yield batch.select(["a", "b", "size_a", "size_b"]).filter(pa.array(keep, pa.bool_()))

    return held.mapInArrow(run, "a long, b long, size_a int, size_b int")


def _class_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """node and n-gram set of the ``wanted`` classes (node, text_key, first_id), from their texts."""
    held = broadcast_if_small(wanted, WANTED_ROWS).join(docs.select("doc_id", "text"), F.col("first_id").eqNullSafe(F.col("doc_id"))).select("node", "text_key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch, texts in tx.slices(batches, "text"):
            sets, keys = shingle_sets(texts, n)
            rows = []
            for i, (node, key) in enumerate(zip(batch.column("node").to_pylist(), batch.column("text_key").to_pylist(), strict=True)):
                # Another text may have the same id, and a row may come again.
                if keys[i] == key and node != last:
                    rows.append(i)
                    last = node
            yield pa.RecordBatch.from_arrays(
                [batch.column("node").take(pa.array(rows, pa.int64())), pa.array([sets[i].view(np.int64) for i in rows], pa.list_(pa.int64()))], names=["node", "grams"]
            )

    return cut(held.mapInArrow(run, "node long, grams array<long>"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    held = (
        pairs.join(sets.select(F.col("node").alias("b"), F.col("grams").alias("grams_b")), "b")
        .join(sets.select(F.col("node").alias("a"), F.col("grams").alias("grams_a")), "a")
    )
    return held.filter(_enough(F.size(F.array_intersect("grams_a", "grams_b")), percent, F.size("grams_a"), F.size("grams_b"))).select("a", "b")


def text_components(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Per document: doc_id, raw_key, n_shingles, component (null without words), component_id."""
    spark = docs.sparkSession
    scan = cut(corpus_scan(docs, n))
    sketch = np.zeros(1 << SKETCH_BITS, np.int64)
    counted = scan.filter("counts IS NOT NULL").select(F.posexplode("counts").alias("bucket", "count")).groupBy("bucket").agg(F.sum("count").alias("count")).toArrow()
    sketch[counted.column("bucket").to_numpy()] = counted.column("count").to_numpy()
    classes = _classes(docs, spark.sparkContext.broadcast(sketch), n, percent)
    shared = _shared_entries(classes, percent)

    pairs = cut(_near_bitmaps(_first_pairs(shared, percent), classes, percent))
    # Were all these pairs links, pairs across would be fewer: classes in neither have no partner,
    # or are joined to a component, and so are in ``pairs``.
    likely = _near_bitmaps(_pairs_across(shared, classes, pairs, percent), classes, percent)
    nodes = pairs.unionByName(likely).select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = _class_sets(docs, cut(classes.select("node", "text_key", "first_id").join(nodes, "node", "left_semi")), n)

    links = cut(_verified(pairs, sets, percent))
    fresh = _pairs_across(shared, classes, links, percent).join(pairs.select("a", "b"), ["a", "b"], "left_anti")
    more = _verified(_near_bitmaps(fresh, classes, percent), sets, percent)

    found = components(links.unionByName(more))
    named = classes.select("text_key", "node", "first_id").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    members = named.join(least, "component").select("text_key", "component", "component_id")
    return (
        scan.filter("counts IS NULL").join(members, "text_key", "left")
        .select("doc_id", "raw_key", "n_shingles", "component", F.coalesce("component_id", "doc_id").alias("component_id"))
    )


def near_copies(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (least doc_id that links reach)."""
    return text_components(docs, n, percent).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """One document of every component, the one of least id, with all its columns; texts without words all stay."""
    id_name, key_name = unused(docs, "_id", "_key")
    found = cut(text_components(docs, n, percent).filter("component IS NOT NULL").select(F.col("doc_id").alias(id_name), F.col("raw_key").alias(key_name), "component"))
    row = F.struct(id_name, key_name)
    first = found.groupBy("component").agg(F.min(row).alias("first"))
    gone = found.join(first, "component").filter(~row.eqNullSafe(F.col("first"))).select(id_name, key_name).distinct()
    same_row = F.col("doc_id").eqNullSafe(F.col(id_name)) & (raw_key() == F.col(key_name))
    kept = docs.join(broadcast_if_small(cut(gone), WANTED_ROWS), same_row, "left_anti")
    twice = cut(found.groupBy(id_name, key_name).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1").drop("n_rows"))
    if twice.isEmpty():
        return kept
    # Rows equal in id and text are one document: only they are gathered by key.
    return kept.join(twice, same_row, "left_anti").unionByName(kept.join(twice, same_row, "left_semi").dropDuplicates(["doc_id", "text"]))
