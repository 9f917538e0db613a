"""SimHash near-duplicates by a generalised pigeonhole over groups of correlated bits.

A fingerprint has a bit set where more than half of the XXH64 values of the text's word shingles
have it set (a repeated shingle counts again). Two fingerprints link at ``BITS`` or fewer differing
bits. The 64 bits are dealt into ``m`` partitions, correlated bits together. If thresholds t_1..t_m
(-1 skips a partition) sum up to BITS - m + 1, every fingerprint within BITS bits of a query is within
t_i of it in some partition i. Each fingerprint chooses its own thresholds by dynamic programming
over the estimated cost of a partition: the values it probes, and the candidates it will meet there,
from histograms of all fingerprints. Probes and stored values meet in an equi-join that verifies the
whole distance in its condition.

Only components are asked for. Neighbours in value order are linked first, wherever a range of the
order ends; after that a fingerprint looks only for fingerprints outside its own component, and one
of the component that holds most of a value does not meet that component there again. So no link
between components is lost, and a dense group of near copies does not meet itself pair by pair.

Equal fingerprints are one node from the start. Null, empty and blank texts have fingerprint zero and
link like any other. Fewer words than a shingle: the whole sequence is one. Repeated rows give
repeated rows. Rows without an id get the component of their fingerprint, and have no say in its
``component_id``. No rows give no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tieweave.llm import text as tx
from tieweave.llm.components import components
from tieweave.session import cut

WORDS = 4
BITS = 4
SEED = 42
#: A shuffled probe costs as much as so many comparisons.
PROBE_COST = 32
#: Shingles whose bits are spread out at a time.
SHINGLES_AT_ONCE = 1 << 17


def shingle_hashes(texts: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(text index, XXH64 of some of its shingles), in text order; every shingle comes once, texts without words never."""
    from xxhash import xxh64_intdigest

    words, bounds = tx.words(texts, tx.BLANK_SEPARATED_FOLDED)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), words), " ")
    offsets = np.frombuffer(joined.buffers()[1], np.int32)[: len(joined) + 1].astype(np.int64)
    data = joined.buffers()[2].to_pybytes() if len(words) else b""
    lengths = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    for i in range(len(bounds) - 1):
        own = lengths[bounds[i] : bounds[i + 1]]
        if not len(own):
            continue
        ends = offsets[i] + np.cumsum(own) + np.arange(len(own))
        starts, k = ends - own, min(n, len(own))
        firsts, lasts = starts[: len(own) - k + 1], ends[k - 1 :]
        for at in range(0, len(firsts), SHINGLES_AT_ONCE):
            pairs = zip(firsts[at : at + SHINGLES_AT_ONCE].tolist(), lasts[at : at + SHINGLES_AT_ONCE].tolist(), strict=True)
            yield i, np.array([xxh64_intdigest(data[a:b], SEED) for a, b in pairs], np.uint64)


def _bits(values: np.ndarray) -> np.ndarray:
    """Rows of 64 zeros and ones, lowest bit first."""
    return np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def fingerprints(texts: pa.Array, n: int = WORDS) -> np.ndarray:
    """Fingerprint of every text, as unsigned numbers."""
    ones, count = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    for i, hashes in shingle_hashes(texts, n):
        ones[i] += _bits(hashes).sum(axis=0, dtype=np.int64)
        count[i] += len(hashes)
    return np.packbits(2 * ones > count[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprinted(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed number) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in tx.slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fingerprints(texts, n).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _summed(fps: DataFrame, size: int, count) -> np.ndarray:
    """Sum of ``count(values)``, an array of ``size`` numbers, over all fingerprints; only ``size`` numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += count(batch.column("fp").to_numpy().view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.int64()))], names=["counts"])

    each = fps.select("fp").mapInArrow(run, "counts array<long>").select(F.posexplode("counts").alias("at", "n"))
    found = each.groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[found.column("at").to_numpy()] = found.column("n").to_numpy()
    return out


def _pair_counts(values: np.ndarray) -> np.ndarray:
    ones = _bits(values).astype(np.float64)
    return np.rint(ones.T @ ones).astype(np.int64).ravel()


def bit_groups(together: np.ndarray, n: int, m: int) -> list[list[int]]:
    """The 64 bits in ``m`` groups of like size, each grown from its strongest pair by mean absolute correlation.

    ``together``: how often bits are set together; ``n``: number of fingerprints.
    """
    p = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    strength = np.abs(together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(strength, 0)
    left, groups = list(range(64)), []
    for k in range(m):
        size = 64 // m + (k < 64 % m)
        within = strength[np.ix_(left, left)]
        group = [left[int(np.argmax(within.max(axis=1)))]]
        while len(group) < size:
            rest = [b for b in left if b not in group]
            group.append(rest[int(np.argmax(strength[np.ix_(rest, group)].mean(axis=1)))])
        left = [b for b in left if b not in group]
        groups.append(sorted(group))
    return groups


def gathered(values: np.ndarray, bits: list[int]) -> np.ndarray:
    """The given bits of every value, put together as a number."""
    out = np.zeros(len(values), np.uint64)
    for k, b in enumerate(bits):
        out |= ((values >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out


def _halves(groups: list[list[int]]) -> list[list[list[int]]]:
    """Each group cut into pieces of at most 11 bits, whose values are counted."""
    return [[list(x) for x in np.array_split(g, max(1, -(-len(g) // 11)))] for g in groups]


def _near_shares(counts: np.ndarray, width: int, most: int) -> np.ndarray:
    """[d, v]: share of all fingerprints whose piece differs from v in exactly d bits."""
    # Walsh-Hadamard: convolution under exclusive or with the indicator of each weight.
    def transform(x):
        x = x.astype(np.float64).copy()
        h = 1
        while h < len(x):
            x = x.reshape(-1, 2, h)
            x = np.stack([x[:, 0] + x[:, 1], x[:, 0] - x[:, 1]], axis=1).reshape(-1)
            h *= 2
        return x

    weight = np.bitwise_count(np.arange(1 << width, dtype=np.uint32))
    spectrum = transform(counts)
    near = [transform(spectrum * transform(weight == d)) / (1 << width) for d in range(min(most, width) + 1)]
    return np.maximum(np.stack(near + [np.zeros(1 << width)] * (most + 1 - len(near))), 0) / max(counts.sum(), 1)


def expected_cost(m: int, n: int, bits: int = BITS) -> float:
    """Cost of one query if bits were even: equal thresholds as far as they go."""
    spare, width, cost = bits - m + 1, 64 / m, 0.0
    if spare < 0:
        return float("inf")
    for k in range(m):
        t = spare // m + (k < spare % m)
        probes = sum(comb(int(width), d) for d in range(t + 1))
        cost += probes * (PROBE_COST + n / 2.0**width)
    return cost


class Pigeonhole:
    """Partitions of the bits and what a query costs in each."""

    def __init__(self, groups: list[list[int]], counts: np.ndarray, n: int, bits: int = BITS):
        self.groups, self.n, self.bits, self.shares = groups, n, bits, []
        at = 0
        for pieces in _halves(groups):
            own = []
            for piece in pieces:
                own.append(_near_shares(counts[at : at + (1 << len(piece))], len(piece), bits))
                at += 1 << len(piece)
            self.shares.append(own)

    @staticmethod
    def sizes(groups: list[list[int]]) -> int:
        return sum(1 << len(piece) for pieces in _halves(groups) for piece in pieces)

    @staticmethod
    def counted(groups: list[list[int]], values: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(gathered(values, piece).astype(np.int64), minlength=1 << len(piece)) for pieces in _halves(groups) for piece in pieces])

    def costs(self, values: np.ndarray) -> np.ndarray:
        """[partition, t + 1, value] for t from -1 to ``bits``: probes and candidates estimated from independent pieces."""
        out = np.zeros((len(self.groups), self.bits + 2, len(values)))
        for i, (group, pieces) in enumerate(zip(self.groups, _halves(self.groups), strict=True)):
            exact = np.zeros((self.bits + 1, len(values)))
            exact[0] = 1
            for piece, share in zip(pieces, self.shares[i], strict=True):
                own = share[:, gathered(values, piece).astype(np.int64)]
                exact = np.stack([sum(exact[a] * own[d - a] for a in range(d + 1)) for d in range(self.bits + 1)])
            for t in range(self.bits + 1):
                probes = sum(comb(len(group), d) for d in range(t + 1))
                out[i, t + 1] = PROBE_COST * probes + self.n * exact[: t + 1].sum(axis=0)
        return out

    def thresholds(self, values: np.ndarray) -> np.ndarray:
        """[value, partition]: thresholds of least estimated cost that sum up to bits - m + 1."""
        cost, m = self.costs(values), len(self.groups)
        # In steps of t + 1, each 0 or more, the sum is bits + 1.
        best = np.full((self.bits + 2, len(values)), np.inf)
        best[0] = 0
        chosen = np.zeros((m, self.bits + 2, len(values)), np.int8)
        for i in range(m):
            ways = np.full((self.bits + 2, self.bits + 2, len(values)), np.inf)
            for total in range(self.bits + 2):
                for step in range(total + 1):
                    ways[total, step] = best[total - step] + cost[i, step]
            chosen[i] = ways.argmin(axis=1)
            best = ways.min(axis=1)
        out, left = np.zeros((len(values), m), np.int8), np.full(len(values), self.bits + 1)
        for i in range(m - 1, -1, -1):
            step = chosen[i, left, np.arange(len(values))]
            out[:, i] = step - 1
            left = left - step
        return out

    def stored(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row number and slot (partition and value in one number) of everything the index holds."""
        slots = [gathered(values, g) | np.uint64(i << 56) for i, g in enumerate(self.groups)]
        return np.tile(np.arange(len(values)), len(slots)), np.concatenate(slots).view(np.int64)

    def probes(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row number and slot of everything the values look for."""
        chosen, rows, slots = self.thresholds(values), [], []
        for i, g in enumerate(self.groups):
            own = gathered(values, g)
            for t in np.unique(chosen[:, i]):
                if t < 0:
                    continue
                masks = np.array([sum(1 << b for b in bits) for d in range(t + 1) for bits in combinations(range(len(g)), d)], np.uint64)
                at = np.flatnonzero(chosen[:, i] == t)
                rows.append(np.repeat(at, len(masks)))
                slots.append(((own[at, None] ^ masks[None, :]) | np.uint64(i << 56)).ravel())
        return np.concatenate(rows), np.concatenate(slots).view(np.int64)


def _listed(fps: DataFrame, lists, *carried: str) -> DataFrame:
    """fp, slot and the ``carried`` columns for every slot that ``lists`` names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 8192):
                batch = whole.slice(at, 8192)
                rows, slots = lists(batch.column("fp").to_numpy().view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(slots), *[batch.column(c).take(pa.array(rows)) for c in ("fp", *carried)]], names=["slot", "fp", *carried])

    return fps.select("fp", *carried).mapInArrow(run, ", ".join(["slot long", "fp long", *[f"{c} long" for c in carried]]))


def _neighbours(index: DataFrame, bits: int) -> DataFrame:
    """Links between entries that follow each other on a slot, in ranges of (slot, fp): a slot may lie in many ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.zeros((2, 0), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            slot, fp = (np.concatenate([x, batch.column(c).to_numpy()]) for x, c in zip(last, ("slot", "fp"), strict=True))
            near = (slot[1:] == slot[:-1]) & (np.bitwise_count((fp[1:] ^ fp[:-1]).view(np.uint64)) <= bits)
            yield pa.RecordBatch.from_arrays([pa.array(fp[1:][near]), pa.array(fp[:-1][near])], names=["a", "b"])
            last = np.stack([slot[-1:], fp[-1:]])

    return index.repartitionByRange("slot", "fp").sortWithinPartitions("slot", "fp").mapInArrow(run, "a long, b long")


def links_across(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """Links (a, b) of distinct fingerprints, enough to join whatever links join."""
    n = fps.count()
    m = min(range(2, bits + 2), key=lambda k: expected_cost(k, n, bits))
    groups = bit_groups(_summed(fps, 64 * 64, _pair_counts).reshape(64, 64), n, m)
    holes = Pigeonhole(groups, _summed(fps, Pigeonhole.sizes(groups), lambda v: Pigeonhole.counted(groups, v)), n, bits)

    first = cut(_neighbours(_listed(fps, holes.stored), bits).distinct())
    found = components(first)
    named = cut(fps.join(found, fps["fp"] == found["node"], "left").select("fp", F.coalesce("component", "fp").alias("component")))

    index = _listed(named, holes.stored, "component")
    # The component with most entries of a slot.
    most = index.groupBy("slot", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("slot").agg(
        F.max(F.struct("n", "component"))["component"].alias("major"), F.count(F.lit(1)).alias("n_components")
    )
    entries = index.join(most, "slot").select("slot", F.col("fp").alias("x"), F.col("component").alias("component_x"), (F.col("component") == F.col("major")).alias("in_major"))
    probes = _listed(named, holes.probes, "component").join(most, "slot").filter("n_components > 1 OR major <> component")
    # Members of the major component look at the others only, everybody else at both kinds.
    asked = probes.select("slot", F.col("fp").alias("q"), F.col("component").alias("component_q"), F.explode(F.when(F.col("component") == F.col("major"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))).alias("in_major"))
    near = (F.col("x") < F.col("q")) & (F.col("component_x") != F.col("component_q")) & (F.bit_count(F.col("x").bitwiseXOR(F.col("q"))) <= bits)
    met = asked.join(entries.withColumnsRenamed({"slot": "_slot", "in_major": "_in_major"}), (F.col("slot") == F.col("_slot")) & (F.col("in_major") == F.col("_in_major")) & near)
    return first.unionByName(met.select(F.col("q").alias("a"), F.col("x").alias("b")))


def near_duplicates(docs: DataFrame, n: int = WORDS, bits: int = BITS) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id (least doc_id that links reach)."""
    each = cut(fingerprinted(docs, n))
    fps = cut(each.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    found = components(links_across(fps, bits))
    named = fps.join(found, fps["fp"] == found["node"], "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    members = named.join(least, "component").select("fp", "component_id")
    return each.join(members, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
