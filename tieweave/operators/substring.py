"""Which words occur in which texts, without comparing every text with every word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tieweave.session import BROADCAST_ROWS, broadcast_if_small, cut, fits

GRAM = 3
# Keeps the fields of a text apart; no wildcard matches it.
FIELD_END = "\u0001"


def contained_terms(
    texts: DataFrame,
    terms: DataFrame,
    scope: list[str],
    keys: list[str],
    limit: int = BROADCAST_ROWS,
    wildcards: bool = False,
) -> DataFrame:
    """(scope, keys, term) for every term that is a substring of the text of its scope.

    ``texts``: scope + keys + ``text``, one row per key. ``terms``: scope + ``term``.
    Few terms (counted) travel to the texts, so the texts are scanned once and not
    shuffled. More terms than ``limit`` meet the texts through an equi-join on
    character trigrams and are then verified; both ways give the same rows.

    With ``wildcards``, ``%`` in a term stands for any characters and ``_`` for one, both
    within one field of the text. A term of nothing but ``%`` is in every text.
    """
    words = terms.select(*scope, "term").filter(F.col("term") != "").distinct()
    words = words.withColumn("pattern", _pattern(F.col("term")) if wildcards else F.lit(None).cast("string"))
    words = words.withColumn("core", F.when(F.col("pattern").isNull(), F.col("term")).otherwise(_core(F.col("term"))))
    if fits(words, limit):
        return _terms_to_texts(texts, words, scope, keys)
    return by_trigrams(texts, words, scope, keys)


def _pattern(term: Column) -> Column:
    """A pattern for a term with wildcards, null for any other.

    It starts where a field does and takes the earliest place for each stretch between two
    ``%``, for good: that is enough, and a text is read once however often a stretch fails.
    """
    escaped = F.regexp_replace(term, r"([\\\[\](){}.*+?^$|])", r"\\$1")
    one = f"[^{FIELD_END}]"
    stretches = F.replace(F.replace(escaped, F.lit("_"), F.lit(one)), F.lit("%"), F.lit(f")(?>{one}*?"))
    wild = F.contains(term, F.lit("%")) | F.contains(term, F.lit("_"))
    return F.when(wild, F.concat(F.lit(f"(?:^|{FIELD_END})(?>{one}*?"), stretches, F.lit(")")))


def _holds(text: Column, word: Column) -> Column:
    # A plain stretch rules out most texts before a pattern is tried.
    return F.contains(text, word["core"]) & F.when(word["pattern"].isNotNull(), F.rlike(text, word["pattern"])).otherwise(F.lit(True))


def _core(term: Column) -> Column:
    """The longest stretch of a term without wildcards, which every text that matches holds."""
    return F.reduce(F.split(term, "[%_]"), F.lit(""), lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best))


def _terms_to_texts(texts: DataFrame, words: DataFrame, scope: list[str], keys: list[str]) -> DataFrame:
    # The word lists together were counted to hold at most the broadcast limit of words.
    word = F.struct("term", "pattern", "core")
    if scope:
        lists = F.broadcast(words.groupBy(*scope).agg(F.collect_set(word).alias("_words")))
        joined = texts.join(lists, scope)
    else:
        found = words.select("term", "pattern", "core").sort("term").collect()
        none = F.array().cast("array<struct<term:string,pattern:string,core:string>>")
        each = [F.struct(F.lit(t).alias("term"), F.lit(p).cast("string").alias("pattern"), F.lit(c).alias("core")) for t, p, c in found]
        joined = texts.withColumn("_words", F.array(*each) if found else none)
    hits = F.filter("_words", lambda w: _holds(F.col("text"), w))
    return joined.select(*scope, *keys, F.explode(F.transform(hits, lambda w: w["term"])).alias("term"))


def _grams(text, size: int):
    """Distinct character runs of one length, in one pass: a look ahead takes nothing, so every place is tried."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=({'.' * size}))"), F.lit(1)))


def by_trigrams(texts: DataFrame, words: DataFrame, scope: list[str], keys: list[str]) -> DataFrame:
    """Equi-join on the rarest gram of every term, then check the whole term.

    A term with wildcards is looked up by its longest stretch without them; where there is
    none, by the empty gram that every text has, as such a term is in nearly all of them.
    """
    core = F.col("core")
    term_gram = F.when(F.length(core) >= GRAM, _grams(core, GRAM)).otherwise(F.array(core))
    term_grams = words.select(*scope, "term", "pattern", "core", F.explode(term_gram).alias("gram"))

    short = [r[0] for r in words.select(F.length(core).alias("n")).filter(F.col("n") < GRAM).distinct().collect()]
    sizes = sorted(set(short) | {GRAM})  # at most the lengths 0 to 3
    text_gram = F.flatten(F.array(*[_grams(F.col("text"), n) if n else F.array(F.lit("")) for n in sizes]))
    wanted = broadcast_if_small(term_grams.select(*scope, "gram").distinct())
    # Texts are taken apart once; what is written are the runs that some term has.
    text_grams = cut(texts.select(*scope, *keys, F.explode(text_gram).alias("gram")).join(wanted, [*scope, "gram"], "left_semi"))

    # Joining on the rarest gram keeps frequent runs of characters out of the join.
    seen = text_grams.groupBy(*scope, "gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = (
        term_grams.join(seen, [*scope, "gram"])
        .groupBy(*scope, "term", "pattern", "core")
        .agg(F.min(F.struct("n", "gram"))["gram"].alias("gram"), F.count(F.lit(1)).alias("present"))
        .join(term_grams.groupBy(*scope, "term").agg(F.count(F.lit(1)).alias("needed")), [*scope, "term"])
        .filter(F.col("present") == F.col("needed"))
        .select(*scope, "term", "pattern", "core", "gram")
    )
    pairs = text_grams.join(rarest, [*scope, "gram"]).select(*scope, *keys, F.struct("term", "pattern", "core").alias("word"))
    return (
        pairs.join(texts, [*scope, *keys])
        .filter(_holds(F.col("text"), F.col("word")))
        .select(*scope, *keys, "word.term")
    )
