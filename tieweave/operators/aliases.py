"""Company aliases: which names merge, and the merge itself."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tieweave.functions import values as V
from tieweave.operators.analytics import company_headcount
from tieweave.operators.enrichment import parsed
from tieweave.session import broadcast_if_small, cut

NET = "network_id"


def builtin_rules(spark: SparkSession) -> DataFrame:
    rows = [(c, a, "builtin", g, m) for g, (c, names) in enumerate(V.BUILTIN_ALIASES.items()) for m, a in enumerate(names)]
    return spark.createDataFrame(rows, "canonical string, alias string, source string, group_ord int, member_ord int")


def parse_clusters(responses: DataFrame) -> DataFrame:
    """Rules from cluster answers (raw): groups without a canonical or other name drop out.

    Where answers have a ``network_id``, their rules keep it and hold there only.
    """
    net = [NET] if NET in responses.columns else []
    groups = parsed(responses).filter(F.col("error").isNull()).select(
        *net,
        F.posexplode(F.expr("try_variant_get(v, '$.groups', 'array<variant>')")).alias("group_ord", "g")
    ).filter(F.expr("schema_of_variant(g) like 'OBJECT%'"))
    named = groups.select(
        *net, "group_ord", F.trim(F.coalesce(F.expr("try_variant_get(g, '$.canonical', 'string')"), F.lit(""))).alias("canonical"),
        F.expr("transform(try_variant_get(g, '$.aliases', 'array<variant>'), x -> trim(try_variant_get(x, '$', 'string')))").alias("names"),
    ).filter("canonical <> ''")
    return named.select(*net, "canonical", "group_ord", F.posexplode("names").alias("member_ord", "alias")).filter(
        "alias is not null and alias <> '' and alias <> canonical"
    ).select(*net, "canonical", "alias", F.lit("model").alias("source"), "group_ord", "member_ord")


_PLAN = "network_id string, canonical string, alias string, source string, headcount long, canonical_present boolean, member_ord int"


def _claim(rows: pd.DataFrame) -> pd.DataFrame:
    """Groups claim names one after the other; a group that folds nothing claims nothing."""
    taken: set[str] = set()
    out = []
    # Numbers start anew in every file and answer, so a group is known by its canonical name too.
    key = ["prio", "group_ord", "canonical"]
    for _, group in rows.sort_values([*key, "member_ord"]).groupby(key, sort=True):
        canonical, source = group["canonical"].iloc[0], group["source"].iloc[0]
        counts = dict(zip(group["alias"], group["headcount"]))
        free = [name for name in counts if name not in taken]
        aliases = [name for name in free if name != canonical]
        present = canonical in counts
        if len(aliases) + present < 2:
            continue
        heads = sum(counts[name] for name in aliases) + (counts[canonical] if present else 0)
        out += [(group["network_id"].iloc[0], canonical, a, source, heads, present, i) for i, a in enumerate(aliases)]
        taken.update(aliases)
        if present:
            taken.add(canonical)
    return pd.DataFrame(out, columns=[f.split(" ")[0] for f in _PLAN.split(", ")])


def plan_merges(people: DataFrame, rules: DataFrame) -> DataFrame:
    """Aliases to fold per network: file rules first, then built-in, then model.

    The rules meet the names that occur; only those few rows per network are walked in
    order, because each group may take names from later ones.
    """
    prio = F.when(F.col("source") == "file", 0).when(F.col("source") == "builtin", 1).otherwise(2)
    # Rules without a network hold in all of them.
    of = F.col(NET) if NET in rules.columns else F.lit(None).cast("string")
    rules = rules.select("*", of.alias("_of"))
    cols = ["_of", "canonical", "source", "group_ord", prio.alias("prio")]
    members = rules.select(*cols, "alias", "member_ord").unionByName(
        rules.select(*cols).distinct().select("_of", "canonical", "source", "group_ord", "prio", F.col("canonical").alias("alias"), F.lit(-1).alias("member_ord"))
    )
    names = company_headcount(people.filter(~F.col("is_me"))).withColumnRenamed("company", "alias")
    matched = names.join(members, "alias").filter(F.col("_of").isNull() | (F.col("_of") == F.col(NET))).groupBy(NET, "prio", "source", "group_ord", "canonical", "alias").agg(
        F.min("member_ord").alias("member_ord"), F.max("headcount").alias("headcount")
    )
    group = [NET, "prio", "group_ord", "canonical"]
    able = matched.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    return matched.join(able.drop("n"), group, "left_semi").groupBy(NET).applyInPandas(_claim, _PLAN)


def residual_names(people: DataFrame, plan: DataFrame) -> DataFrame:
    """Names no planned group covers."""
    covered = plan.select(NET, F.col("alias").alias("company")).unionByName(plan.select(NET, F.col("canonical").alias("company"))).distinct()
    return company_headcount(people.filter(~F.col("is_me"))).join(covered, [NET, "company"], "left_anti").select(NET, "company")


def merged_links(people: DataFrame, plan: DataFrame) -> DataFrame:
    """Person-company links under canonical names, each once: network_id, person_id, company, at."""
    links = people.select(NET, "person_id", F.posexplode("companies").alias("at", "company"))
    moved = links.join(_new_names(plan), [NET, "company"], "left").withColumn("company", F.coalesce("canonical", "company"))
    return moved.groupBy(NET, "person_id", "company").agg(F.min("at").alias("at"))


def _new_names(plan: DataFrame) -> DataFrame:
    """Names that fold, with their canonical name and place. Few of them (counted) travel to the links, which are not shuffled then."""
    return broadcast_if_small(cut(plan.select(NET, F.col("alias").alias("company"), "canonical", "member_ord")))


def merged_link_rows(links: DataFrame, plan: DataFrame) -> DataFrame:
    """Links with whatever they tell (role, since, is_current) under canonical names.

    ``links``: network_id, person_id, company and further columns that can be ordered. Of the links
    of one person that fall together the one to the canonical name stays as it is, otherwise that of
    the first alias of the plan; of equal links the smallest. A null company folds into nothing.
    """
    told = [c for c in links.columns if c not in (NET, "person_id", "company")]
    moved = links.join(_new_names(plan).withColumnRenamed("canonical", "_new"), [NET, "company"], "left").select(
        NET, "person_id", F.coalesce("_new", "company").alias("company"),
        F.struct(F.coalesce("member_ord", F.lit(-1)).alias("_ord"), *told).alias("_link"),
    )
    kept = moved.groupBy(NET, "person_id", "company").agg(F.min("_link").alias("_link"))
    return kept.select(NET, "person_id", "company", *[F.col(f"_link.{c}").alias(c) for c in told])


def merge_companies(people: DataFrame, plan: DataFrame) -> DataFrame:
    lists = merged_links(people, plan).groupBy(NET, "person_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "company"))), lambda x: x["company"]).alias("_merged")
    )
    rows = people.join(lists, [NET, "person_id"], "left")
    return rows.withColumn("companies", F.coalesce("_merged", "companies")).select(*people.columns)


def merge_summary(people: DataFrame, plan: DataFrame) -> DataFrame:
    """Per network: names before and after, links moved, alias names removed.

    Where the canonical name was unknown, the first alias is renamed and does not count.
    """
    roster = company_headcount(people.filter(~F.col("is_me")))
    before = roster.groupBy(NET).agg(F.count(F.lit(1)).alias("names_before"))
    counted = plan.filter("canonical_present or member_ord > 0").join(
        roster.select(NET, F.col("company").alias("alias"), F.col("headcount").alias("links")), [NET, "alias"]
    )
    moved = counted.groupBy(NET).agg(F.sum("links").alias("links_moved"), F.count(F.lit(1)).alias("names_removed"))
    folded = plan.groupBy(NET).agg(F.count(F.lit(1)).alias("_folded"))
    out = before.join(folded, NET, "left").join(moved, NET, "left").na.fill(0)
    return out.withColumn("names_after", F.col("names_before") - F.col("_folded")).drop("_folded")
