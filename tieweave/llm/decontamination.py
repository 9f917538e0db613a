"""Benchmark decontamination over a distributed positional inverted index.

The index is cut by documents: each segment holds, for every term, the ascending addresses of
its occurrences among the segment's words, and is stored before it is searched. Test windows
travel to the segments in blocks of bounded bytes. A window's address lists are intersected
from its globally rarest term on, each shifted by the term's offset, so common terms are only
looked up at the few places that are left. ``slop`` above 0 finds windows whose terms lie
within that many words of their places.

Null and empty texts have no words and no hits. Repeated documents are judged each; repeated
items count once. Items without words are never found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tieweave.llm import text as tx
from tieweave.llm.names import unused
from tieweave.session import broadcast_if_small, cut

WINDOW = 10
#: Text bytes of one index segment, and of the test items that are sent around at once.
SEGMENT_BYTES = 8 << 20
BLOCK_BYTES = 32 << 20
#: So many documents with hits (an id and a digest each) are sent to the tasks at most; more are joined by shuffle.
BAD_ROWS = 500_000

_SEGMENT = "doc_ids array<long>, text_keys array<string>, firsts array<int>, terms array<int>, counts array<long>, postings array<binary>"
_HITS = "doc_id long, text_key string, n_words long, spans array<struct<s:int,e:int>>, items array<string>"


@dataclass
class Windows:
    """Distinct windows of a block of items, and the block's vocabulary."""

    vocabulary: pa.Array
    terms: list[tuple[int, ...]]
    items: list[list[str | None]]


def compile_windows(rows: list[tuple], window: int = WINDOW) -> Windows:
    """rows: (item_id, text). An item of fewer words than a window is one window."""
    codes, bounds, vocabulary = np.zeros(0, np.int64), np.zeros(1, np.int64), pa.array([], pa.string())
    if rows:
        found, bounds = tx.words(tx.as_strings(pa.array([t for _, t in rows], pa.string())), tx.ALPHANUMERIC_FOLDED)
        codes, vocabulary = tx.coded(found)
    owners: dict[tuple[int, ...], dict] = {}
    for k, (item, _) in enumerate(rows):
        own = codes[bounds[k] : bounds[k + 1]].tolist()
        for at in range(max(1, len(own) - window + 1) if own else 0):
            owners.setdefault(tuple(own[at : at + window]), {})[None if item is None else str(item)] = None
    return Windows(vocabulary, list(owners), [list(v) for v in owners.values()])


def text_key() -> Column:
    return F.md5(F.coalesce(F.col("text"), F.lit("")))


def build_index(docs: DataFrame, vocabulary) -> DataFrame:
    """Segments with postings of the terms in the broadcast ``vocabulary``; ``firsts`` are the documents' first addresses and the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = vocabulary.value
        for batch, texts in tx.slices(batches, "text", SEGMENT_BYTES):
            words, bounds = tx.words(texts, tx.ALPHANUMERIC_FOLDED)
            code = pc.fill_null(pc.index_in(words, value_set=terms), -1).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(code >= 0).astype(np.int32)
            order = at[np.argsort(code[at], kind="stable")]
            held, start = np.unique(code[order], return_index=True)
            lists = np.split(order, start[1:]) if len(held) else []
            row = [
                batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist(), bounds.astype(np.int32), held.astype(np.int32),
                [len(x) for x in lists], [_pack(x) for x in lists],
            ]
            types = [pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=["doc_ids", "text_keys", "firsts", "terms", "counts", "postings"])

    return docs.select("doc_id", "text", text_key().alias("text_key")).mapInArrow(run, _SEGMENT)


def _pack(addresses: np.ndarray) -> bytes:
    """First address, then gaps; two bytes a gap where all of them fit, marked by the first byte."""
    gaps = np.diff(addresses)
    short = len(gaps) == 0 or int(gaps.max()) < 1 << 16
    return bytes([short]) + addresses[:1].astype("<i4").tobytes() + gaps.astype("<u2" if short else "<u4").tobytes()


def _unpack(stored: bytes) -> np.ndarray:
    gaps = np.frombuffer(stored, "<u2" if stored[0] else "<u4", offset=5)
    first = np.frombuffer(stored, "<i4", 1, offset=1).astype(np.int64)
    return np.concatenate([first, first[0] + np.cumsum(gaps, dtype=np.int64)])


def term_counts(index: DataFrame) -> dict[int, int]:
    """Occurrences of every term in the whole corpus; one number for each word of the test block."""
    pairs = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x"))
    return {r["t"]: r["n"] for r in pairs.groupBy(F.col("x.terms").alias("t")).agg(F.sum("x.counts").alias("n")).collect()}


def _near(sorted_addresses: np.ndarray, wanted: np.ndarray, slop: int) -> np.ndarray:
    at = np.searchsorted(sorted_addresses, wanted - slop)
    return (at < len(sorted_addresses)) & (sorted_addresses[np.minimum(at, len(sorted_addresses) - 1)] <= wanted + slop)


def segment_matches(postings: dict[int, bytes], firsts: np.ndarray, orders: list[list[tuple[int, int]]], slop: int = 0) -> Iterator[tuple[int, np.ndarray]]:
    """(window, start addresses) of a segment; ``orders`` has each window's (offset, term) from the rarest on."""
    lists: dict[int, np.ndarray] = {}

    def addresses(term: int) -> np.ndarray:
        if term not in lists:
            lists[term] = _unpack(postings[term])
        return lists[term]

    for w, order in enumerate(orders):
        if any(term not in postings for _, term in order):
            continue
        offset, term = order[0]
        starts = addresses(term) - offset
        for offset, term in order[1:]:
            starts = starts[_near(addresses(term), starts + offset, slop)]
            if not len(starts):
                break
        if len(starts):
            doc = np.searchsorted(firsts, starts, side="right")
            starts = starts[(starts >= 0) & (starts + len(order) <= firsts[np.minimum(doc, len(firsts) - 1)])]
            if len(starts):
                yield w, starts


def search(index: DataFrame, plan, slop: int = 0) -> DataFrame:
    """Per document of the index: words, merged hit spans and found items. ``plan``: broadcast (orders, items)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders, items = plan.value
        for batch in batches:
            for row in range(batch.num_rows):
                own = {c: batch.column(c)[row].values for c in ("doc_ids", "text_keys", "firsts", "terms", "postings")}
                firsts = own["firsts"].to_numpy(zero_copy_only=False).astype(np.int64)
                postings = dict(zip(own["terms"].to_pylist(), own["postings"].to_pylist(), strict=True))
                edge = np.zeros(int(firsts[-1]) + 1, np.int32)
                found: dict[int, set] = {}
                for w, starts in segment_matches(postings, firsts, orders, slop):
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, starts + len(orders[w]), -1)
                    for d in np.unique(np.searchsorted(firsts, starts, side="right") - 1).tolist():
                        found.setdefault(d, set()).update(items[w])
                hit = np.concatenate([[False], np.cumsum(edge[:-1]) > 0, [False]])
                # A span that reaches from one document into the next is two spans.
                inner = np.unique(firsts[1:-1])
                change = np.flatnonzero(hit[1:] != hit[:-1])
                begins, ends = change[::2], change[1::2]
                cuts = inner[(hit[inner] & hit[inner + 1])] if len(inner) else inner
                begins, ends = np.sort(np.concatenate([begins, cuts])), np.sort(np.concatenate([ends, cuts]))
                doc = np.searchsorted(firsts, begins, side="right") - 1
                spans: list[list] = [[] for _ in range(len(firsts) - 1)]
                for d, s, e in zip(doc.tolist(), (begins - firsts[doc]).tolist(), (ends - firsts[doc]).tolist(), strict=True):
                    spans[d].append({"s": s, "e": e})
                yield pa.RecordBatch.from_arrays(
                    [
                        own["doc_ids"], own["text_keys"], pa.array(np.diff(firsts)),
                        pa.array(spans, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))),
                        pa.array([list(found.get(d, ())) for d in range(len(firsts) - 1)], pa.list_(pa.string())),
                    ],
                    names=["doc_id", "text_key", "n_words", "spans", "items"],
                )

    return index.mapInArrow(run, _HITS)


def item_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple]]:
    """The items in runs of about ``block_bytes`` of text, one run on the driver at a time."""
    sized = items.select("item_id", "text")
    total = sized.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    for b in range(blocks):
        yield [tuple(r) for r in sized.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()]


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 0, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: doc_id, text_key, n_words, ``spans`` of hit words (merged), ``items`` found (as text)."""
    spark = docs.sparkSession
    parts = []
    for b, rows in enumerate(item_blocks(items, block_bytes)):
        block = compile_windows(rows, window)
        index = cut(build_index(docs, spark.sparkContext.broadcast(block.vocabulary)))
        counts = term_counts(index)
        orders, held = [], []
        for terms, owners in zip(block.terms, block.items, strict=True):
            if all(t in counts for t in terms):
                orders.append(sorted(enumerate(terms), key=lambda x: (counts[x[1]], x)))
                held.append(owners)
        parts.append(search(index, spark.sparkContext.broadcast((orders, held)), slop).withColumn("_block", F.lit(b)))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    # Equal rows have equal hits: one of each and their number stand for all, however many there are.
    once = every.groupBy("doc_id", "text_key", "_block").agg(F.first("n_words").alias("n_words"), F.first("spans").alias("spans"), F.first("items").alias("items"), F.count(F.lit(1)).alias("_n"))
    met = once.groupBy("doc_id", "text_key").agg(
        F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("_n").alias("_n"),
    )
    reach = F.aggregate(
        "spans", F.struct(F.lit(0).alias("e"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(F.greatest(a["e"], x["e"]).alias("e"), (a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(a["e"], x["s"]))).alias("n")), lambda a: a["n"],
    )
    return met.withColumn("n_hit", reach).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_copy", "_n")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    named = F.filter("items", lambda x: x.isNotNull())
    return matches(docs, items, window).select(
        "doc_id", "n_words", "n_hit", F.size(named).cast("long").alias("n_items"),
        F.sha2(F.array_join(named, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without a hit, with all their columns."""
    id_name, key_name = unused(docs, "_id", "_key")
    bad = matches(docs, items, window).filter(F.col("n_hit") > 0).select(F.col("doc_id").alias(id_name), F.col("text_key").alias(key_name)).distinct()
    return docs.join(broadcast_if_small(cut(bad), BAD_ROWS), F.col("doc_id").eqNullSafe(F.col(id_name)) & (text_key() == F.col(key_name)), "left_anti")
