"""Fuzzy line removal: one occurrence is kept of every group of lines that read alike.

Lines are normalised (lower case, everything but letters as a blank). Each distinct line has
a 64-bit SimHash over its words. Lines whose SimHashes differ in at most three bits agree in
two of five blocks of it, so they meet in a join on block pairs; a pair is linked if the edit
similarity of its word sequences is at least 0.8. A group is what links connect, and its first occurrence by
document and line stays. Built-in expressions only.

As only groups matter, the lines of a bucket are first linked along one order; then only pairs
across groups are looked at, all of them, so that a common line does not meet itself in pairs.

Lines of fewer than ``MIN_WORDS`` words stay as they are. Null texts stay null. Rows equal in id
and text are one document: they keep the same lines. Null ids come first. A text may become
empty; no document goes.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tieweave.llm.components import components
from tieweave.llm.names import unused
from tieweave.session import cut

MIN_WORDS = 5
MAX_BITS = 3
#: One edit in so many words is allowed: similarity 0.8.
EDIT_SHARE = 5
#: Lists of lines with so many documents and lines together are sent to the tasks at most; more are joined by shuffle.
SENT_LINES = 1_000_000
BLOCKS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]


def normalised(text: Column) -> Column:
    """Text with its line breaks, and only letters and single blanks besides."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\n]+", " ")


#: Bits of one lane of a sum; a lane holds the count of one SimHash bit over up to LANE_WORDS words.
LANE = 16
LANE_WORDS = (1 << (LANE - 1)) - 1
_ONES = sum(1 << (LANE * lane) for lane in range(64 // LANE))


def _word_sums(hashed: DataFrame, keys: list[str]) -> DataFrame:
    """SimHash of every row of ``hashed`` (``keys`` and ``words``): bit i is set if more than half of the words' hashes have it.

    Each addition counts four bits, in lanes; a row's words are in one task, so all but one sum
    a row are made before the shuffle. Rows of very many words are counted by ``_long_simhash``.
    """
    word = hashed.select(*keys, F.explode("words").alias("word")).withColumn("h", F.xxhash64("word"))
    sums = [F.sum(F.shiftrightunsigned("h", k).bitwiseAND(F.lit(_ONES))).alias(f"s{k}") for k in range(LANE)]
    counted = word.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sums)

    def bit(i: int) -> Column:
        count = F.shiftrightunsigned(F.col(f"s{i % LANE}"), i - i % LANE).bitwiseAND(F.lit((1 << LANE) - 1))
        return F.when(2 * count > F.col("n"), F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long")).otherwise(F.lit(0).cast("long"))

    total = bit(0)
    for i in range(1, 64):
        total = total.bitwiseOR(bit(i))
    return counted.select(*keys, total.alias("simhash"))


def _long_simhash(words: Column) -> Column:
    """The same, bit by bit, for rows beyond the lanes."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    zero = F.lit(0).cast("long")

    def bit(i: Column) -> Column:
        count = F.aggregate(hashes, zero, lambda a, h: a + F.call_function("shiftrightunsigned", h, i).bitwiseAND(F.lit(1)))
        return F.when(2 * count > F.size(words), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(zero)

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(63)), bit), zero, lambda a, x: a.bitwiseOR(x))


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _lines(docs: DataFrame, min_words: int) -> DataFrame:
    """doc_id, text_key, line, h1 and h2 (hashes of the normalised line), n_words, simhash."""
    keys = ["doc_id", "text_key", "line", "h1", "h2", "n_words"]

    def worded(part: DataFrame) -> DataFrame:
        keyed = part.filter("text IS NOT NULL").select("doc_id", text_key(F.col("text")).alias("text_key"), normalised(F.col("text")).alias("norm"))
        split = keyed.select("doc_id", "text_key", F.posexplode(F.split("norm", "\n")).alias("line", "norm")).withColumn("norm", F.trim("norm"))
        held = split.select("doc_id", "text_key", "line", F.xxhash64("norm").alias("h1"), F.xxhash64("norm", F.lit(1)).alias("h2"), F.split("norm", " ").alias("words"))
        return held.withColumn("n_words", F.size("words")).filter(F.col("n_words") >= min_words)

    # ``row`` keeps equal rows of the input apart.
    usual = worded(docs).filter(F.col("n_words") <= LANE_WORDS).withColumn("row", F.monotonically_increasing_id())
    # A line of more words has at least two characters for each.
    long = worded(docs.filter(F.length("text") > 2 * LANE_WORDS)).filter(F.col("n_words") > LANE_WORDS)
    return _word_sums(usual, [*keys, "row"]).drop("row").unionByName(long.select(*keys, _long_simhash(F.col("words")).alias("simhash")))


def _small(lists: DataFrame, column: str) -> DataFrame:
    """Marked to be sent to all tasks if its documents and list entries, of a few bytes each, were counted to be few."""
    total = lists.agg(F.coalesce(F.sum(F.size(column) + 1), F.lit(0))).first()[0]
    return F.broadcast(lists) if total <= SENT_LINES else lists


def _bits(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _keys(lines: DataFrame) -> DataFrame:
    """A row per distinct line and pair of blocks; ``key`` holds the number of the pair and both blocks."""
    def block(at: int, size: int) -> Column:
        return F.shiftrightunsigned("simhash", at).bitwiseAND(F.lit((1 << size) - 1))

    keys = [
        F.lit(t << 26).cast("long").bitwiseOR(F.shiftleft(block(*BLOCKS[i]), 13)).bitwiseOR(block(*BLOCKS[j]))
        for t, (i, j) in enumerate(combinations(range(len(BLOCKS)), 2))
    ]
    return lines.select("node", "simhash", "n_words", F.explode(F.array(*keys)).alias("key"))


def _fits(words_a: str, words_b: str) -> Column:
    """Numbers of words that can still reach the edit similarity."""
    return EDIT_SHARE * F.abs(F.col(words_a) - F.col(words_b)) <= F.greatest(words_a, words_b)


def word_signs(words: Column, seed: int) -> Column:
    """A text of one character a word, the same for equal words; two words share one by chance of 1 in 55,000."""
    def sign(word: Column) -> Column:
        return F.decode(F.unhex(F.lpad(F.hex(F.lit(256) + F.pmod(F.xxhash64(word, F.lit(seed)), F.lit(55_000))), 4, "0")), "UTF-16BE")

    return F.array_join(F.transform(words, sign), "")


def word_edits(a: str, b: str) -> Column:
    """Fewest words to put in, take out or replace to turn one line into the other, from the signs of their words.

    Shared signs can only make the number smaller, so the larger one of two independent kinds
    of signs is taken; both are wrong by chance near 1 in 10^9 for each replaced word.
    """
    return F.greatest(*[F.levenshtein(F.col(f"{a}.{k}"), F.col(f"{b}.{k}")) for k in ("one", "two")])


def _verified(pairs: DataFrame, lines: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (a, b) of distinct lines whose edit similarity holds; their text is read from a first occurrence."""
    wanted = lines.join(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "node", "left_semi")
    at = _small(cut(wanted.groupBy("first.doc_id", "first.text_key").agg(F.collect_list(F.struct("first.line", "node")).alias("at")).withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})), "at")
    # Equal rows give the same lines again; one of each is enough.
    sources = docs.filter("text IS NOT NULL").select("doc_id", "text").join(at, F.col("doc_id").eqNullSafe(F.col("_id")) & (text_key(F.col("text")) == F.col("_key")))
    split = sources.select("at", F.posexplode(F.split(normalised(F.col("text")), "\n")).alias("line", "norm"))
    lines_of = split.select(F.trim("norm").alias("norm"), F.explode(F.filter("at", lambda x: x["line"] == F.col("line"))).alias("x")).select("x.node", "norm")
    worded = lines_of.select("node", F.split("norm", " ").alias("words"))
    # Written once a line, not once a pair.
    signs = cut(worded.select("node", F.size("words").alias("n"), F.struct(word_signs(F.col("words"), 1).alias("one"), word_signs(F.col("words"), 2).alias("two")).alias("signs")).distinct())
    held = pairs.join(signs.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("signs").alias("signs_a")), "a").join(signs.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("signs").alias("signs_b")), "b")
    return held.filter(EDIT_SHARE * word_edits("signs_a", "signs_b") <= F.greatest("n_a", "n_b")).select("a", "b")


def line_groups(docs: DataFrame, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """All lines of ``min_words`` words or more, and the distinct ones with their ``keeper`` (first occurrence of the group) and ``copies``."""
    lines = cut(_lines(docs, min_words))
    place = F.struct("doc_id", "text_key", "line")
    distinct = cut(
        lines.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("copies"), F.any_value("simhash").alias("simhash"), F.any_value("n_words").alias("n_words"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    w = Window.partitionBy("key").orderBy("simhash", "n_words", "node")
    around = _keys(distinct).withColumns({"before": F.lag(F.struct("node", "simhash", "n_words")).over(w), "after": F.lead("node").over(w)})
    met = cut(around.filter("before IS NOT NULL OR after IS NOT NULL"))
    chain = (
        met.filter("before IS NOT NULL").select(F.col("before.node").alias("a"), F.col("node").alias("b"), F.col("before.simhash").alias("sim_a"), F.col("simhash").alias("sim_b"), F.col("before.n_words").alias("words_a"), F.col("n_words").alias("words_b"))
        .filter((_bits("sim_a", "sim_b") <= MAX_BITS) & _fits("words_a", "words_b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    chain = cut(chain)
    links = cut(_verified(chain, distinct, docs))
    # Keys of three lines or more can hold pairs that are no neighbours.
    wide = met.join(met.filter("before IS NOT NULL AND after IS NOT NULL").select("key").distinct(), "key", "left_semi").select("node", "simhash", "n_words", "key")
    named = wide.join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = named.groupBy("key").agg(F.min("component").alias("_low"), F.max("component").alias("_high")).filter("_low <> _high").select("key")
    left = named.join(mixed, "key", "left_semi")
    right = left.select(F.col("key").alias("_key"), F.col("node").alias("b"), F.col("simhash").alias("sim_b"), F.col("n_words").alias("words_b"), F.col("component").alias("_component"))
    across = left.join(
        right, (F.col("key") == F.col("_key")) & (F.col("component") < F.col("_component")) & (_bits("simhash", "sim_b") <= MAX_BITS) & _fits("n_words", "words_b"),
    ).select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()
    fresh = cut(across.join(chain, ["a", "b"], "left_anti"))
    every = components(links.unionByName(_verified(fresh, distinct, docs)))
    grouped = distinct.join(every, "node", "left").withColumn("component", F.coalesce("component", "node"))
    keepers = grouped.groupBy("component").agg(F.min("first").alias("keeper"), F.sum("copies").alias("group_size"))
    return lines, grouped.join(keepers, "component").select("h1", "h2", "keeper", "group_size")


def without_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with their columns, ``text`` without the removed lines, and ``n_lines`` and ``n_removed``."""
    return removed_lines(docs, *line_groups(docs, min_words))


def removed_lines(docs: DataFrame, lines: DataFrame, groups: DataFrame) -> DataFrame:
    """The documents without all ``lines`` of ``groups`` but their keepers."""
    id_name, key_name, gone_name = unused(docs, "_id", "_key", "_gone")
    gone = (
        lines.select("doc_id", "text_key", "line", "h1", "h2").join(groups.filter("group_size > 1"), ["h1", "h2"])
        .filter(~F.struct("doc_id", "text_key", "line").eqNullSafe(F.col("keeper")))
        .groupBy(F.col("doc_id").alias(id_name), F.col("text_key").alias(key_name)).agg(F.collect_set("line").alias(gone_name))
    )
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    parts_name = unused(docs, "_parts")[0]
    met = docs.select(*kept, F.split("text", "\n", -1).alias(parts_name)).join(_small(cut(gone), gone_name), F.col("doc_id").eqNullSafe(F.col(id_name)) & (text_key(F.col("text")) == F.col(key_name)), "left")
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts_name) - 1), gone_name), lambda i: F.get(parts_name, i))
    return met.select(
        *[F.when(F.col(gone_name).isNull(), F.col("text")).otherwise(F.array_join(left, "\n")).alias("text") if c == "text" else F.col(c) for c in kept],
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(parts_name)).cast("long").alias("n_lines"),
        F.coalesce(F.size(gone_name), F.lit(0)).cast("long").alias("n_removed"),
    )
