"""Line removal by edit similarity: one occurrence is kept of every group of lines that read alike.

Lines are normalised (lower case; letters, marks and digits stay, all else is a blank). Words are
what blanks separate; in scripts written without blanks each character is a word. Lines of signs
only are known by their signs. Equal lines are one group, however short. Of lines of ``min_words``
words or more a pair is linked if the edit similarity of its word sequences is at least 0.8, and
every such pair across groups is found. A group is what links connect, and its first occurrence by
document and line stays. Built-in expressions only.

No link is missed: e edits leave all but 2e of a line's word pairs in place, or 2e less one for each
word that the other line has more. So at most ``missing(n)`` of the distinct word pairs of a line of
n words are absent from a partner, and of the first ``missing(n) + 1`` in one order over the corpus
two partners share one. The order is from rare to frequent by a count sketch; it decides about
the number of candidates only.

As only groups matter, the lines of a word pair are first linked to the one before and the first;
then all pairs across groups are looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tieweave.llm.components import components
from tieweave.llm.line_dedup import EDIT_SHARE, MIN_WORDS, _fits, _small, removed_lines, text_key, word_signs
from tieweave.session import cut

SKETCH_BITS = 16
#: Scripts written without blanks.
_NO_BLANKS = "".join(rf"\p{{Is{s}}}" for s in ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar"))


def _split(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns, line and norm (words with single blanks between; a line of signs only as it is) of every line."""
    apart = F.regexp_replace(F.lower("text"), f"([{_NO_BLANKS}])", " $1 ")
    worded = F.split(F.regexp_replace(apart, r"[^\p{L}\p{M}\p{N}\n]+", " "), "\n")
    # Made once a text: what comes after an explode is not put in its place by the optimizer.
    both = F.zip_with(worded, F.split("text", "\n"), lambda words, raw: F.struct(F.trim(words).alias("words"), raw.alias("raw")))
    lines = docs.select(*keep, F.posexplode(both).alias("line", "x"))
    return lines.select(*keep, "line", F.when(F.col("x.words") == "", F.regexp_replace("x.raw", r"^\s+|\s+$", "")).otherwise(F.col("x.words")).alias("norm"))


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, line, h1 and h2 (hashes of the normalised line) of every line that is not blank."""
    keyed = docs.filter("text IS NOT NULL").select("doc_id", text_key(F.col("text")).alias("text_key"), "text")
    return _split(keyed, "doc_id", "text_key").filter("norm <> ''").select("doc_id", "text_key", "line", F.xxhash64("norm").alias("h1"), F.xxhash64("norm", F.lit(1)).alias("h2"))


def missing(n: Column) -> Column:
    """Most distinct word pairs of a line of n words that a partner can lack."""
    return 2 * F.floor(n / EDIT_SHARE).cast("int") + (n % EDIT_SHARE == EDIT_SHARE - 1).cast("int")


def _words(distinct: DataFrame, docs: DataFrame, min_words: int) -> DataFrame:
    """node, n_words and words of the distinct lines of ``min_words`` words or more, read from their first occurrence."""
    at = _small(cut(distinct.groupBy("first.doc_id", "first.text_key").agg(F.collect_list(F.struct("first.line", "node")).alias("at")).withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})), "at")
    # Equal rows give the same lines again.
    sources = docs.filter("text IS NOT NULL").select("doc_id", "text").join(at, F.col("doc_id").eqNullSafe(F.col("_id")) & (text_key(F.col("text")) == F.col("_key")))
    found = F.get(F.filter("at", lambda x: x["line"] == F.col("line")), F.lit(0))["node"]
    held = _split(sources, "at").select(found.alias("node"), "norm").filter("node IS NOT NULL").filter(F.col("norm").rlike(r"[\p{L}\p{M}\p{N}]"))
    words = held.select("node", F.explode(F.array(F.split("norm", " "))).alias("words"))
    return words.select("node", F.size("words").alias("n_words"), "words").filter(F.col("n_words") >= max(2, min_words))


def _worded(distinct: DataFrame, docs: DataFrame, min_words: int) -> DataFrame:
    """node, n_words, grams (distinct word pairs) and parity (of the grams, by 64 slots)."""
    pairs = F.zip_with(F.slice("words", F.lit(1), F.col("n_words") - 1), F.slice("words", F.lit(2), F.col("n_words") - 1), lambda a, b: F.xxhash64(a, b))
    grams = cut(_words(distinct, docs, min_words).select("node", "n_words", F.array_distinct(pairs).alias("grams")))
    parity = F.aggregate("grams", F.lit(0).cast("long"), lambda s, g: s.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), g.bitwiseAND(F.lit(63)).cast("int"))))
    return grams.withColumn("parity", parity)


def _levels(worded: DataFrame) -> Column:
    """Sketch of the grams' numbers of lines, as an array of levels by bucket."""
    counted = worded.select(F.explode("grams").alias("g")).groupBy(_bucket(F.col("g")).alias("bucket")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    levels = ["0"] * (1 << SKETCH_BITS)
    for bucket, n in zip(counted.column("bucket").to_pylist(), counted.column("n").to_pylist(), strict=True):
        levels[bucket] = str(n)
    return F.split(F.lit(" ".join(levels)), " ").cast("array<int>")


def _bucket(gram: Column) -> Column:
    return F.call_function("shiftrightunsigned", gram, F.lit(64 - SKETCH_BITS)).cast("int")


def _near(x: str, y: str) -> Column:
    """Bounds by the numbers of words and by the parities of the distinct word pairs."""
    most = missing(F.col(f"{x}.n_words")) + missing(F.col(f"{y}.n_words"))
    return _fits(f"{x}.n_words", f"{y}.n_words") & (F.bit_count(F.col(f"{x}.parity").bitwiseXOR(F.col(f"{y}.parity"))) <= most)


def _verified(pairs: DataFrame, distinct: DataFrame, docs: DataFrame, min_words: int) -> DataFrame:
    """Pairs (a, b) whose edit similarity holds; shared signs of words can only hide an edit, so both kinds must say so."""
    wanted = distinct.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi")
    made = F.struct(word_signs(F.col("words"), 1).alias("one"), word_signs(F.col("words"), 2).alias("two"))
    signs = cut(_words(wanted, docs, min_words).select("node", "n_words", made.alias("signs")).distinct())
    held = pairs.join(signs.select(F.col("node").alias("a"), F.col("n_words").alias("n_a"), F.col("signs").alias("signs_a")), "a").join(signs.select(F.col("node").alias("b"), F.col("n_words").alias("n_b"), F.col("signs").alias("signs_b")), "b")
    most = F.floor(F.greatest("n_a", "n_b") / EDIT_SHARE).cast("int")
    within = [F.call_function("levenshtein", F.col(f"signs_a.{k}"), F.col(f"signs_b.{k}"), most) >= 0 for k in ("one", "two")]
    return held.filter(within[0] & within[1]).select("a", "b")


def links(distinct: DataFrame, docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Pairs (a, b) of alike lines that connect all that alike lines connect."""
    worded = _worded(distinct, docs, min_words)
    levels = _levels(worded)
    ordered = F.array_sort(F.transform("grams", lambda g: F.struct(F.get(levels, _bucket(g)).alias("level"), g.alias("g"))))
    listed = F.transform(F.slice(ordered, F.lit(1), missing(F.col("n_words")) + 1), lambda x: x["g"])
    # Equal rows give equal entries; a line is no partner of itself.
    entries = worded.select(F.struct("node", "n_words", "parity").alias("x"), F.explode(listed).alias("key"))
    w = Window.partitionBy("key").orderBy("x.n_words", "x.node")
    around = entries.withColumns({"before": F.lag("x").over(w), "after": F.lead("x").over(w), "head": F.first("x").over(w)})
    # The lines next to one by their numbers of words fit, or none does.
    met = cut(around.filter(_fits("before.n_words", "x.n_words") | _fits("after.n_words", "x.n_words")))

    def pairs(frame: DataFrame) -> DataFrame:
        return frame.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()

    first = cut(pairs(met.select("x", F.explode(F.array_compact(F.array("before", "head"))).alias("y")).filter((F.col("x.node") != F.col("y.node")) & _near("x", "y"))))
    found = cut(_verified(first, distinct, docs, min_words))
    named = met.select("key", "x").withColumn("node", F.col("x.node")).join(components(found), "node", "left").select("key", "x", F.coalesce("component", "node").alias("component"))
    mixed = named.groupBy("key").agg(F.min("component").alias("_low"), F.max("component").alias("_high"), F.count(F.lit(1)).alias("_n")).filter("_low <> _high AND _n > 2").select("key")
    left = named.join(mixed, "key", "left_semi")
    right = left.select(F.col("key").alias("_key"), F.col("x").alias("y"), F.col("component").alias("_component"))
    across = pairs(left.join(right, (F.col("key") == F.col("_key")) & (F.col("component") < F.col("_component")) & _near("x", "y")))
    return found.unionByName(_verified(cut(across.join(first, ["a", "b"], "left_anti")), distinct, docs, min_words))


def line_groups(docs: DataFrame, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """All lines that are not blank, and the distinct ones with the ``keeper`` (first occurrence) and ``group_size`` of their group."""
    lines = cut(_lines(docs))
    place = F.struct("doc_id", "text_key", "line")
    distinct = cut(lines.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("copies")).withColumn("node", F.monotonically_increasing_id()))
    grouped = distinct.join(components(links(distinct, docs, min_words)), "node", "left").withColumn("component", F.coalesce("component", "node"))
    keepers = grouped.groupBy("component").agg(F.min("first").alias("keeper"), F.sum("copies").alias("group_size"))
    return lines, grouped.join(keepers, "component").select("h1", "h2", "keeper", "group_size")


def without_alike_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with their columns, ``text`` without the removed lines, and ``n_lines`` and ``n_removed``."""
    return removed_lines(docs, *line_groups(docs, min_words))
