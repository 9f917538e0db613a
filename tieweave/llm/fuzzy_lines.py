"""Fuzzy line removal by SimHash blocks: one occurrence is kept of every group of lines that read alike.

Lines are normalised (lower case; letters, marks and digits stay, all else is a blank). Words are
what blanks separate; in scripts written without blanks each character is a word. Lines of signs
only are known by their signs. Equal lines are one group, however short they are. Lines of
``MIN_WORDS`` words or more have a SimHash, whose blocks are counted over shares of the words: a
word's hash names the block that it votes in, so a few edits leave most blocks as they are. Lines
meet in a join on every pair of blocks, and a pair is linked if the edit similarity of its word
sequences is at least 0.8. A group is what links connect; its first occurrence by document and
line stays. Built-in expressions only.

With s blocks, e edits reach at most 2e of them, so two lines with e < (s - 1) / 2 edits always
meet; beyond that a block stays the same by its majorities only, and pairs near the limit of long
lines can be missed. Short lines have fewer blocks, as their shares would be empty otherwise.

Lines of a key are linked to its least line first, afterwards all pairs across groups are looked
at, so a group of like lines does not meet itself in pairs.

Null texts stay null and have no lines; empty and blank lines stay. Rows equal in id and text are
one document and keep the same lines. Null ids come first. A text may become empty; no document
goes. Empty tables give empty results. Further columns are kept, whatever their names; ``n_lines``
and ``n_removed`` are written anew. Lines and texts may have any length.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tieweave.llm.components import components
from tieweave.llm.line_dedup import EDIT_SHARE, MIN_WORDS, _fits, _small, removed_lines, text_key
from tieweave.session import Scratch, cut

#: Bits of a block.
BITS = 14
#: Blocks of a line, and the numbers of words that have so many. A line of 15 words or fewer has no
#: partner above 18, so each pair is together in one range.
RANGES = [(4, MIN_WORDS, 18), (6, 16, None)]
#: Scripts written without blanks; all are above U+0E00.
_NO_BLANKS = r"[\x{E00}-\x{10FFFF}&&[" + "".join(rf"\p{{Is{s}}}" for s in ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar")) + "]]"


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def normalised_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, line and norm (words with single blanks between; a line of signs as it is) of every line that is not blank."""
    keyed = docs.filter("text IS NOT NULL").select("doc_id", text_key(F.col("text")).alias("text_key"), "text")
    worded = F.split(F.regexp_replace(F.regexp_replace(F.lower("text"), _NO_BLANKS, " $0 "), r"[^\p{L}\p{M}\p{N}\n]+", " "), "\n")
    # Made once a text: what comes after an explode is not put in its place by the optimizer.
    both = F.zip_with(worded, F.split("text", "\n"), lambda words, raw: F.struct(F.trim(words).alias("words"), raw.alias("raw")))
    lines = keyed.select("doc_id", "text_key", F.posexplode(both).alias("line", "x"))
    norm = F.when(F.col("x.words") == "", F.regexp_replace("x.raw", r"^\s+|\s+$", "")).otherwise(F.col("x.words"))
    return lines.select("doc_id", "text_key", "line", norm.alias("norm"), (F.col("x.words") != "").alias("has_words")).filter("norm <> ''")


def _counted(k: int, ones: Column, total: Column, h: Column) -> Column:
    return total + F.call_function("shiftrightunsigned", h, F.lit(k)).bitwiseAND(ones)


def _majorities(hashes: Column, bits: int, width: int) -> Column:
    """Number whose bit i is set if more than half of the hashes have bit i; a lane of ``width`` bits counts one of them."""
    lanes = 63 // width
    apart = -(-bits // lanes)
    # Bits k, k + width, ... of the hash are counted by one addition.
    ones = _long(sum(1 << (width * lane) for lane in range(lanes)))

    def voted(sums: Column, k: Column) -> Column:
        total = _long(0)
        for lane in range(lanes):
            count = F.call_function("shiftrightunsigned", sums, F.lit(width * lane)).bitwiseAND(_long((1 << width) - 1))
            total = total + F.when((2 * count > F.size(hashes)) & (k < bits - lane * apart), _long(1 << (lane * apart))).otherwise(_long(0))
        return F.call_function("shiftleft", total, k)

    # What a lambda uses more than once is made again for each use, so the sums are bound to a variable.
    sums = F.array(*[F.aggregate(hashes, _long(0), partial(_counted, k, ones)) for k in range(apart)])
    return F.aggregate(F.transform(sums, voted), _long(0), lambda total, x: total + x)


def _between(low: int, high: int, h: Column) -> Column:
    return (h >= _long(low)) & (h < _long(high))


def simhash_blocks(hashes: Column, blocks: int, bits: int) -> Column:
    """Array of one number a block: the SimHash of those words whose hash lies in the block's share of all hashes."""
    step = (1 << 64) // blocks
    edges = [-(1 << 63) + step * i for i in range(blocks)] + [(1 << 63) - 1]
    shares = [F.filter(hashes, partial(_between, edges[i], edges[i + 1])) for i in range(blocks)]
    # Shares above 511 words take wider lanes.
    return F.transform(F.array(*shares), lambda s: F.when(F.size(s) < 512, _majorities(s, bits, 9)).otherwise(_majorities(s, bits, 31)))


def _marked(docs: DataFrame, min_words: int, bits: int) -> DataFrame:
    """The lines with h1 and h2 (hashes), and, of lines that are compared, norm, n_words, parity of the distinct words by 64 slots, and blocks by range."""
    # An explode of one value keeps the arrays from being made again for each use.
    words = normalised_lines(docs).withColumn("words", F.when(F.col("has_words"), F.split("norm", " ")))
    held = words.withColumn("n_words", F.coalesce(F.size("words"), F.lit(0))).withColumn("compared", F.col("n_words") >= max(2, min_words))
    hashed = held.select("*", F.explode(F.array(F.when(F.col("compared"), F.array_distinct(F.transform("words", lambda w: F.xxhash64(w)))))).alias("hashes"))
    parity = F.aggregate("hashes", _long(0), lambda s, h: s.bitwiseXOR(F.call_function("shiftleft", _long(1), h.bitwiseAND(_long(63)).cast("int"))))
    ranged = [F.when(_in_range(low, high), simhash_blocks(F.col("hashes"), blocks, bits)).alias(f"blocks{blocks}") for blocks, low, high in RANGES]
    return hashed.select(
        "doc_id", "text_key", "line", F.xxhash64("norm").alias("h1"), F.xxhash64("norm", F.lit(1)).alias("h2"),
        F.when(F.col("compared"), F.col("norm")).alias("norm"), F.when(F.col("compared"), F.col("n_words")).alias("n_words"), parity.alias("parity"), *ranged,
    )


def _in_range(low: int, high: int | None) -> Column:
    return (F.col("n_words") >= low) & (F.lit(True) if high is None else F.col("n_words") <= high)


def _entries(distinct: DataFrame, bits: int) -> DataFrame:
    """A row (key, node) per compared line and pair of its blocks; ``key`` holds the number of the pair and both blocks."""
    number, made = 0, []
    for blocks, low, high in RANGES:
        keys = []
        for i, j in combinations(range(blocks), 2):
            keys.append(F.col(f"blocks{blocks}")[i] + F.shiftleft(F.col(f"blocks{blocks}")[j], bits) + _long(number << (2 * bits)))
            number += 1
        made.append(F.when(_in_range(low, high), F.array(*keys)).otherwise(F.array().cast("array<long>")))
    return distinct.filter("n_words IS NOT NULL").select("node", F.explode(F.concat(*made)).alias("key"))


def _signs(norm: Column) -> Column:
    """A text of one character a word, the same for equal words; two words share one by chance of 1 in a million."""
    signs = F.transform(F.split(norm, " "), lambda w: F.lpad(F.hex(F.pmod(F.xxhash64(w, F.lit(2)), _long(1 << 20)) + _long(1 << 16)), 8, "0"))
    return F.decode(F.unhex(F.array_join(signs, "")), "UTF-32")


def _possible(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) that numbers of words and parities of distinct words leave possible; facts: node, n_words, parity."""
    distinct = pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    held = distinct.join(facts.select(F.col("node").alias("a"), F.col("n_words").alias("n_a"), F.col("parity").alias("p_a")), "a")
    held = held.join(facts.select(F.col("node").alias("b"), F.col("n_words").alias("n_b"), F.col("parity").alias("p_b")), "b")
    return held.filter(_near("n_a", "n_b", "p_a", "p_b")).select("a", "b")


def _near(n_a: str, n_b: str, p_a: str, p_b: str) -> Column:
    """An edit changes at most two of the distinct words."""
    return _fits(n_a, n_b) & (F.bit_count(F.col(p_a).bitwiseXOR(F.col(p_b))) <= 2 * F.floor(F.greatest(n_a, n_b) / EDIT_SHARE))


def _verified(pairs: DataFrame, distinct: DataFrame, lines: DataFrame) -> DataFrame:
    """Pairs (a, b) whose edit similarity holds, from the lines at their first occurrence."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = cut(distinct.join(nodes, "node", "left_semi").select("node", F.col("first.doc_id").alias("_id"), F.col("first.text_key").alias("_key"), F.col("first.line").alias("_line"), F.array("node").alias("_at")))
    place = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")) & (F.col("line") == F.col("_line"))
    # Equal rows give the same line again.
    signs = cut(lines.select("doc_id", "text_key", "line", "n_words", "norm").join(_small(wanted, "_at"), place).select("node", "n_words", _signs(F.col("norm")).alias("signs")).distinct())
    held = pairs.join(signs.select(F.col("node").alias("a"), F.col("n_words").alias("n_a"), F.col("signs").alias("s_a")), "a")
    held = held.join(signs.select(F.col("node").alias("b"), F.col("n_words").alias("n_b"), F.col("signs").alias("s_b")), "b")
    most = F.floor(F.greatest("n_a", "n_b") / EDIT_SHARE).cast("int")
    return held.filter(F.call_function("levenshtein", F.col("s_a"), F.col("s_b"), most) >= 0).select("a", "b")


def _across_entries(placed: DataFrame) -> DataFrame:
    """Entries whose key has lines of several components, and another line of a fitting number of words.

    Lines next to an entry by number of words are the nearest there are: if neither fits, none does.
    """
    of, by_words = Window.partitionBy("key"), Window.partitionBy("key").orderBy("n_words")
    near = placed.withColumns({"_less": F.lag("n_words").over(by_words), "_more": F.lead("n_words").over(by_words), "_low": F.min("component").over(of), "_high": F.max("component").over(of)})
    return near.filter(F.col("_low") != F.col("_high")).filter(_fits("_less", "n_words") | _fits("_more", "n_words")).drop("_less", "_more", "_low", "_high")


def links(distinct: DataFrame, lines: DataFrame, bits: int = BITS) -> DataFrame:
    """Pairs (a, b) of alike lines that connect all that pairs with a common key connect."""
    entries = _entries(distinct, bits)
    facts = distinct.select("node", "n_words", "parity")
    # Keys of two lines are a pair each; only larger keys look at their lines again.
    # Hardly any two entries of a task have one key, so they are dealt out as they are and not combined before.
    keyed = cut(entries.repartition("key").groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    large = keyed.filter("n > 2").select("key", "a", F.array("a").alias("_at"))
    met = cut(entries.join(_small(large, "_at").drop("_at"), "key"))
    first = cut(_possible(keyed.select("a", "b").unionByName(met.select("a", F.col("node").alias("b"))), facts))
    found = cut(_verified(first, distinct, lines))

    # A line's component is looked up once a line, not once a key.
    named = facts.join(components(found), "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = met.select("key", "node").join(named, "node")
    left = cut(_across_entries(placed))
    right = left.select(F.col("key").alias("_key"), F.col("node").alias("b"), F.col("n_words").alias("n_b"), F.col("parity").alias("p_b"), F.col("component").alias("_component"))
    across = left.join(right, (F.col("key") == F.col("_key")) & (F.col("component") < F.col("_component")) & _near("n_words", "n_b", "parity", "p_b"))
    pairs = across.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()
    fresh = cut(pairs.join(first, ["a", "b"], "left_anti"))
    return found.unionByName(_verified(fresh, distinct, lines))


def distinct_lines(lines: DataFrame) -> DataFrame:
    """One row per different line: first (its first occurrence), copies, and what was made of it."""
    made = ["n_words", "parity", *[f"blocks{blocks}" for blocks, _, _ in RANGES]]
    grouped = lines.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "text_key", "line")).alias("first"), F.count(F.lit(1)).alias("copies"), *[F.any_value(c).alias(c) for c in made])
    return cut(grouped.withColumn("node", F.monotonically_increasing_id()))


def marked_lines(scratch: Scratch, docs: DataFrame, min_words: int = MIN_WORDS, bits: int = BITS) -> DataFrame:
    """All lines that are not blank, written once: place, hashes, and for compared lines text, number of words and blocks."""
    return scratch.keep(_marked(docs, min_words, bits))


def line_groups(lines: DataFrame, bits: int = BITS) -> DataFrame:
    """h1, h2, ``keeper`` (first occurrence) and ``group_size`` of the group of every different line."""
    distinct = distinct_lines(lines)
    grouped = distinct.join(components(links(distinct, lines, bits)), "node", "left").withColumn("component", F.coalesce("component", "node"))
    keepers = grouped.groupBy("component").agg(F.min("first").alias("keeper"), F.sum("copies").alias("group_size")).filter("group_size > 1")
    return grouped.join(keepers, "component").select("h1", "h2", "keeper", "group_size")


def without_fuzzy_lines(docs: DataFrame, min_words: int = MIN_WORDS, bits: int = BITS) -> DataFrame:
    """The documents with their columns, ``text`` without the removed lines, and ``n_lines`` and ``n_removed``."""
    with Scratch(docs.sparkSession) as scratch:
        lines = marked_lines(scratch, docs, min_words, bits)
        places = lines.select("doc_id", "text_key", "line", "h1", "h2")
        return removed_lines(docs, places, line_groups(lines, bits))
