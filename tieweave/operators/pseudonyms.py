"""Names to placeholders and back, with one dictionary per network (or per goal)."""

from __future__ import annotations

from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from tieweave.functions import values as V
from tieweave.operators.occurrences import occurrences
from tieweave.operators.ranking import positions

NET = "network_id"
TOKEN = V.WORD_START + r"[PC]\d{3,}" + V.WORD_END
ONLY_PERSON = r"^P\d{3,}$"
ONLY_COMPANY = r"^C\d{3,}$"


def person_tokens(people: DataFrame) -> DataFrame:
    """P001.. by name, the owner is P000: network_id, person_id, name, token, ord."""
    others = positions(people.filter(~F.col("is_me")).select(NET, "person_id", "name"), [NET], [F.col("name"), F.col("person_id")], "ord")
    owner = people.filter("is_me").select(NET, "person_id", "name", F.lit(0).cast("long").alias("ord"))
    return others.unionByName(owner).withColumn("token", F.format_string("P%03d", "ord"))


def company_tokens(people: DataFrame) -> DataFrame:
    """C001.. by length, longest first, then name: network_id, name, token, ord."""
    names = people.filter(~F.col("is_me")).select(NET, F.explode("companies").alias("name")).select(
        NET, F.trim("name").alias("name")
    ).filter("name <> ''").distinct()
    ordered = positions(names, [NET], [F.length("name").desc(), F.col("name")], "ord")
    return ordered.withColumn("token", F.format_string("C%03d", "ord"))


def dictionary(people: DataFrame) -> DataFrame:
    """Both kinds together: network_id, kind, entity_id, name, token, ord."""
    p = person_tokens(people).select(NET, F.lit("person").alias("kind"), F.col("person_id").alias("entity_id"), "name", "token", "ord")
    c = company_tokens(people).select(NET, F.lit("company").alias("kind"), F.col("ord").alias("entity_id"), "name", "token", "ord")
    return p.unionByName(c)


def roster(people: DataFrame, hint_chars: int = 6) -> DataFrame:
    """Tokens with the beginning of the name, the owner left out."""
    return person_tokens(people).filter("token <> 'P000'").select(NET, "token", F.substring("name", 1, hint_chars).alias("hint"))


def pseudonymise(texts: DataFrame, names: DataFrame, scope: list[str], keys: list[str], leak_safe: bool = True) -> DataFrame:
    """Replace known names in ``text`` by their tokens, longest name first.

    A name next to a Latin letter or digit is left alone. ``names``: scope + kind, name,
    token, ord. Every text is read once for each block of names; only the places found are
    carried to it, so what a text gathers is bounded by the text. ``leak_safe=False`` writes
    tokens as it goes, which lets a token protect a name right after it.
    """
    rank = F.when(F.col("kind") == "person", 0).otherwise(1)
    first = names.filter("name <> ''").groupBy(*scope, "name").agg(F.min(F.struct(rank.alias("k"), F.col("ord"), F.col("token"))).alias("w"))
    words = first.select(*scope, F.col("name").alias("term"), "w")
    places = occurrences(texts, words, scope, keys).join(words, [*scope, "term"])
    order = F.struct((-F.length("term")).alias("l"), "w", "term", "start")
    if leak_safe:
        found = places.groupBy(*scope, *keys).agg(F.sort_array(F.collect_list(order)).alias("_found"))
        held = texts.join(found, [*scope, *keys], "left")
        cuts = F.transform("_found", lambda e: F.struct(e["start"].alias("start"), (-e["l"]).alias("length"), e["w"]["token"].alias("token")))
        return held.withColumn("text", F.when(F.col("_found").isNull(), F.col("text")).otherwise(_rewritten(F.col("text"), cuts))).drop("_found")
    once = places.groupBy(*scope, *keys, "term").agg(F.any_value("w").alias("w"))
    found = once.groupBy(*scope, *keys).agg(F.sort_array(F.collect_list(F.struct((-F.length("term")).alias("l"), "w", "term"))).alias("_found"))
    quoted = lambda t: F.regexp_replace(t, r"([\\.\[\]{}()*+?^$|#&~-])", r"\\$1")
    pattern = lambda e: F.concat(F.lit("(?<![A-Za-z0-9])"), quoted(e["term"]), F.lit("(?![A-Za-z0-9])"))
    new = F.aggregate("_found", F.col("text"), lambda acc, e: F.regexp_replace(acc, pattern(e), e["w"]["token"]))
    out = texts.join(found, [*scope, *keys], "left")
    return out.withColumn("text", F.when(F.col("_found").isNull(), F.col("text")).otherwise(new)).drop("_found")


def replaced(text: str, places: list[dict]) -> str:
    """The text with tokens at those places, in order of precedence, that are free and not inside a word."""
    word = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
    free, chosen = bytearray(b"\x01") * len(text), []
    for _, same in groupby(places, key=lambda p: p["token"]):
        at_once, last = [], 0
        for p in same:
            a, b = p["start"], p["start"] + p["length"]
            # A name that has been replaced by its token before is no letter; places of one name are decided together.
            inside = (a and free[a - 1] and text[a - 1] in word) or (b < len(text) and free[b] and text[b] in word)
            if not inside and a >= last and all(free[a:b]):
                at_once.append((a, b, p["token"]))
                last = b
        for a, b, _ in at_once:
            free[a:b] = bytes(b - a)
        chosen += at_once
    parts, at = [], 0
    for a, b, token in sorted(chosen):
        parts += [text[at:a], token]
        at = b
    return "".join([*parts, text[at:]])


@F.pandas_udf(T.StringType())
def _rewritten(texts: pd.Series, places: pd.Series) -> pd.Series:
    return pd.Series([t if t is None or p is None else replaced(t, p) for t, p in zip(texts, places, strict=True)], dtype=object)


def restore(texts: DataFrame, names: DataFrame, scope: list[str], keys: list[str], keep_unknown: bool = True) -> DataFrame:
    """Tokens in ``text`` back to names; unknown tokens stay (or vanish).

    The text is cut at its tokens and put together again, so a restored name is never
    read as a token itself.
    """
    tokens = F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))
    used = texts.select(*scope, *keys, F.explode(F.array_distinct(tokens)).alias("token"))
    known = used.join(names.select(*scope, "token", "name"), [*scope, "token"])
    maps = known.groupBy(*scope, *keys).agg(F.map_from_entries(F.collect_list(F.struct("token", "name"))).alias("_names"))
    unknown = (lambda t: t) if keep_unknown else (lambda t: F.lit(""))
    filled = F.transform(tokens, lambda t: F.coalesce(F.element_at("_names", t), unknown(t)))
    joined = F.array_join(F.zip_with(F.split("text", TOKEN), filled, lambda p, f: F.concat(p, F.coalesce(f, F.lit("")))), "")
    bare = F.col("text") if keep_unknown else F.regexp_replace("text", TOKEN, "")
    out = texts.join(maps, [*scope, *keys], "left")
    return out.withColumn("text", F.when(F.col("_names").isNull(), bare).otherwise(joined)).drop("_names")


def tokenise_companies(links: DataFrame, names: DataFrame, scope: list[str]) -> DataFrame:
    """Company links (scope + company) with the token where there is one, else the name."""
    tokens = names.filter("kind = 'company'").select(*scope, F.col("name").alias("company"), "token")
    clean = links.withColumn("company", F.trim("company"))
    return clean.join(tokens, [*scope, "company"], "left").withColumn("shown", F.coalesce("token", "company")).drop("token")
