"""Needs of some people against offers of others, and introductions the owner can broker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tieweave.operators.analytics import contacts, me_rows
from tieweave.operators.ranking import top_k
from tieweave.operators.substring import contained_terms
from tieweave.session import broadcast_if_small, cut

NET = "network_id"


def needs_of(people: DataFrame) -> DataFrame:
    return _values(people, F.col("needs"), "need")


def offers_of(people: DataFrame) -> DataFrame:
    return _values(people, F.concat("tags", "skills", "companies"), "offer")


def _values(people: DataFrame, values: Column, out: str) -> DataFrame:
    """A person's distinct folded values, one a row. A person is one row, so they are told apart there and not shuffled."""
    folded = F.array_distinct(F.transform(values, lambda x: F.lower(x)))
    return contacts(people).select(NET, "person_id", "name", F.explode(folded).alias(out)).filter(F.col(out) != "")


def value_matches(needs: DataFrame, offers: DataFrame) -> DataFrame:
    """Needs and offers where one contains the other, on distinct values of a network."""
    n = needs.select(NET, "need").distinct()
    o = offers.select(NET, "offer").distinct()
    inside = contained_terms(
        o.withColumn("text", F.col("offer")), n.withColumnRenamed("need", "term"), [NET], ["offer"]
    ).select(NET, F.col("term").alias("need"), "offer")
    around = contained_terms(
        n.withColumn("text", F.col("need")), o.withColumnRenamed("offer", "term"), [NET], ["need"]
    ).select(NET, "need", F.col("term").alias("offer"))
    return inside.unionByName(around).distinct()


def bio_matches(needs: DataFrame, people: DataFrame) -> DataFrame:
    """People whose bio holds a need: network_id, person_id, name, need."""
    texts = contacts(people).filter(F.col("bio").isNotNull()).select(NET, "person_id", "name", F.lower("bio").alias("text"))
    hits = contained_terms(texts, needs.select(NET, F.col("need").alias("term")), [NET], ["person_id", "name"])
    return hits.withColumnRenamed("term", "need")


def match_table(people: DataFrame) -> DataFrame:
    """Needs against offers per network, with how many people are on either side.

    The people pairs behind a row are seekers x providers; they are counted, not listed.
    """
    needs, offers = needs_of(people), offers_of(people)
    seekers = needs.groupBy(NET, "need").agg(F.count(F.lit(1)).alias("seekers"))
    providers = offers.groupBy(NET, "offer").agg(F.count(F.lit(1)).alias("providers"))
    by_value = value_matches(needs, offers).join(providers, [NET, "offer"]).select(
        NET, "need", F.lit("attribute").alias("via"), "offer", "providers"
    )
    by_bio = bio_matches(needs, people).groupBy(NET, "need").agg(F.count(F.lit(1)).alias("providers")).select(
        NET, "need", F.lit("bio").alias("via"), F.col("need").alias("offer"), "providers"
    )
    return by_value.unionByName(by_bio).join(seekers, [NET, "need"])


def introductions(people: DataFrame, limit: int = 50) -> DataFrame:
    """First ``limit`` introductions per network by seeker, then provider name.

    Of each need only the first limit + 1 providers and of each network only the first
    ``limit`` seekers that have one can appear in the result, so nothing else is paired.
    """
    needs, offers = needs_of(people), offers_of(people)
    by_name = [F.col("name"), F.col("person_id")]
    first_offers = top_k(offers, [NET, "offer"], by_name, limit + 1)
    via_value = value_matches(needs, offers).join(first_offers, [NET, "offer"]).select(
        NET, "need", "person_id", "name", F.lit(0).alias("via"), F.col("offer").alias("keyword")
    )
    via_bio = top_k(bio_matches(needs, people), [NET, "need"], by_name, limit + 1).select(
        NET, "need", "person_id", "name", F.lit(1).alias("via"), F.col("need").alias("keyword")
    )
    matched = via_value.unionByName(via_bio).groupBy(NET, "need", "person_id", "name").agg(
        F.min(F.struct("via", "keyword")).alias("m")
    )
    # At most limit + 1 people for each need of a network, read twice below.
    providers = cut(top_k(matched, [NET, "need"], by_name, limit + 1).drop("rank"))

    served = providers.groupBy(NET, "need").agg(F.count(F.lit(1)).alias("n"), F.min("person_id").alias("only_id"))
    able = needs.join(broadcast_if_small(served), [NET, "need"]).filter((F.col("n") > 1) | (F.col("only_id") != F.col("person_id")))
    seekers = cut(top_k(able.select(NET, "person_id", "name").distinct(), [NET], by_name, limit).select(NET, "person_id"))
    asked = needs.join(broadcast_if_small(seekers), [NET, "person_id"], "left_semi").select(
        NET, "need", F.col("person_id").alias("seeker_id"), F.col("name").alias("seeker")
    )
    pairs = (
        asked.join(providers.withColumnsRenamed({"person_id": "provider_id", "name": "provider"}), [NET, "need"])
        .filter("provider_id <> seeker_id")
        .groupBy(NET, "seeker_id", "seeker", "provider_id", "provider")
        .agg(F.min(F.struct("need", "m")).alias("w"))
    )
    keyword = F.col("w.m.keyword")
    rows = pairs.select(
        NET, "seeker_id", "seeker", "provider_id", "provider", F.col("w.need").alias("need"), keyword.alias("keyword"),
        F.concat(F.col("seeker"), F.lit(" 需要「"), F.col("w.need"), F.lit("」，"), F.col("provider"), F.lit(" 在「"), keyword, F.lit("」上对得上")).alias("why"),
    )
    order = [F.col("seeker"), F.col("seeker_id"), F.col("provider"), F.col("provider_id")]
    return top_k(rows, [NET], order, limit, "place")


def brokered_paths(intros: DataFrame, people: DataFrame) -> DataFrame:
    """Provider - owner - seeker as a path, with its contexts and what to do next."""
    me = me_rows(people).join(people.select(NET, F.col("person_id").alias("me_id"), F.col("name").alias("me_name")), [NET, "me_id"])
    word = F.coalesce("keyword", F.lit(""))
    has_me, has_word = F.col("me_id").isNotNull(), word != ""
    tell = F.concat(F.lit("匹配「"), word, F.lit("」"))
    pair = F.concat(F.col("provider"), F.lit(" ↔ "), F.col("seeker"))
    direct = F.lit("你直接认识")
    return intros.join(me, NET, "left").select(
        NET, "seeker_id", "provider_id",
        F.when(has_me, F.array("provider_id", "me_id", "seeker_id")).otherwise(F.array("provider_id", "seeker_id")).alias("path"),
        F.when(has_me, F.array(F.lit(None).cast("string"), direct, F.when(has_word, tell).otherwise(direct)))
        .otherwise(F.array(F.lit(None).cast("string"), F.when(has_word, tell).otherwise(F.lit("")))).alias("contexts"),
        F.when(has_me, F.concat(F.lit("由你居间引荐 "), pair, F.when(has_word, F.concat(F.lit("（"), tell, F.lit("）"))).otherwise(""), F.lit("。")))
        .otherwise(F.concat(pair, F.when(has_word, F.concat(F.lit(" "), tell)).otherwise(""), F.lit("。"))).alias("next_step"),
        F.col("why").alias("rationale"),
    )
