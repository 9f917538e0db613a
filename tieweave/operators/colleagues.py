"""Edges between colleagues and their ids, made without moving the pairs.

The pairs of a company are the square of its people. What a written edge rules, and where a pair
stands among the new edges, is told by columns of the one person and by the list of the others, so only these are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tieweave.operators import analytics as A
from tieweave.operators.folding import EDGE_KEY
from tieweave.operators.ranking import positions, sums_before, top_k
from tieweave.session import cut, kept

NET = "network_id"
LISTED = 64  # edges of one person that travel with the person; whoever has more goes by joins


def ruled_pairs(people: DataFrame, writes: DataFrame) -> DataFrame:
    """Directions among ``writes`` that are a pair of colleagues, the lesser id first."""
    own = A.memberships(people).groupBy(NET, "person_id").agg(F.collect_list("company").alias("own"))
    of = lambda x: own.select(NET, F.col("person_id").alias(f"{x}_id"), F.col("own").alias(x))
    asked = writes.select(*EDGE_KEY).filter("source_id < target_id").distinct()
    both = asked.join(of("source"), [NET, "source_id"]).join(of("target"), [NET, "target_id"])
    return kept(both.filter(F.arrays_overlap("source", "target")).select(*EDGE_KEY))


def _listed(rows: DataFrame, item, out: str) -> DataFrame:
    """The first edges of every source by target, one more than may travel."""
    few = top_k(rows, [NET, "source_id"], [F.col("target_id")], LISTED + 1)
    return few.groupBy(NET, F.col("source_id").alias("person_id")).agg(F.array_sort(F.collect_list(item)).alias(out))


def _unruled(pairs: DataFrame, ruled: DataFrame) -> DataFrame:
    keys = ruled.select(NET, F.col("source_id").alias("low_id"), F.col("target_id").alias("high_id"))
    return pairs.join(keys, [NET, "low_id", "high_id"], "left_anti")


def _free(members: DataFrame, ruled: DataFrame, lows: DataFrame | None = None) -> DataFrame:
    """Pairs among ``members``, the lesser id among ``lows`` if given, that no written edge rules."""
    lists = _listed(ruled, F.col("target_id"), "ruled")
    lows = (members if lows is None else lows).join(lists, [NET, "person_id"], "left")
    short = F.coalesce(F.size("ruled") <= LISTED, F.lit(True))
    met = A.all_meetings(lows, members, [F.col("ruled"), short.alias("short")])
    left = F.when(F.col("ruled").isNotNull() & F.col("short"), F.array_except("met", "ruled")).otherwise(F.col("met"))
    pairs = A.each(met.withColumn("met", left).drop("ruled"), "met", "high_id").select(NET, "low_id", "high_id", "short")
    if lists.filter(F.size("ruled") > LISTED).isEmpty():
        return pairs.drop("short")
    return pairs.filter("short").unionByName(_unruled(pairs.filter("NOT short"), ruled)).drop("short")


def free_pairs(people: DataFrame, ruled: DataFrame) -> DataFrame:
    """Pairs of colleagues that no written edge rules: low_id, high_id."""
    return _free(kept(A.company_members(people)), ruled)


def numbered(people: DataFrame, ruled: DataFrame, written: DataFrame, top: DataFrame) -> DataFrame:
    """Edge ids for ``written`` directions and for the free pairs, numbered together by source and target on from ``top``.

    Rows: network_id, source_id, target_id, edge_id and ``w``, the further columns of a written direction, null for a pair.
    A person's targets are sorted block by block of the first, largest, company; what comes before a block is counted from
    places. Only the ids of colleagues from other companies are moved, as lists. Pairs of people with more than
    ``LISTED`` other edges are sorted, once.
    """
    written = written.select(*EDGE_KEY, F.struct(*[c for c in written.columns if c not in EDGE_KEY]).alias("w"))
    members = kept(A.company_members(people))
    other = written.select(*EDGE_KEY, F.lit(1).alias("new"), F.lit(0).alias("old")).unionByName(
        ruled.select(*EDGE_KEY, F.lit(0).alias("new"), F.lit(1).alias("old"))
    ).groupBy(*EDGE_KEY).agg(F.max("new").alias("new"), F.max("old").alias("old"))
    lists = _listed(other, F.struct("target_id", "new", "old"), "edges")
    one = [NET, "person_id"]
    plain = members.filter("earlier IS NULL").join(lists, one, "left").filter(F.col("edges").isNull() | (F.size("edges") <= LISTED))
    far = A.meetings(members, members, later=True).groupBy(NET, F.col("low_id").alias("person_id")).agg(F.sort_array(F.flatten(F.collect_list("met"))).alias("far"))
    plain = kept(plain.join(far, one, "left"))

    source = F.col("person_id").alias("source_id")
    others = written.join(plain.select(NET, source), [NET, "source_id"], "left_anti")
    employed = members.select(NET, source).distinct()
    # Colleagues of one person are sorted by themselves, whoever has none may have any number of edges.
    own_sort = others.join(employed, [NET, "source_id"], "left_semi")
    many = members.join(plain.select(*one), one, "left_anti")
    if not many.isEmpty():
        rest = _free(members, ruled, many)
        own_sort = own_sort.unionByName(rest.select(NET, F.col("low_id").alias("source_id"), F.col("high_id").alias("target_id"), F.lit(None).cast(written.schema["w"].dataType).alias("w")))
    far_sort = cut(positions(others.join(employed, [NET, "source_id"], "left_anti"), [NET, "source_id"], [F.col("target_id")], "_at"))

    added = lambda n, e: n + e["new"] - e["old"]
    sum_of = lambda es: F.coalesce(F.aggregate(es, F.lit(0), added), F.lit(0))
    count = lambda xs: F.when(xs.isNull(), 0).otherwise(F.size(xs))
    totals = plain.select(*one, (F.col("n") - F.col("place") + sum_of(F.col("edges")) + count(F.col("far"))).alias("_n")).unionByName(
        own_sort.select(NET, "source_id").unionByName(far_sort.select(NET, "source_id")).groupBy(NET, F.col("source_id").alias("person_id")).agg(F.count(F.lit(1)).alias("_n"))
    )
    start = F.col("_base") + F.greatest(F.coalesce("_top", F.lit(0)), F.lit(0))
    starts = cut(sums_before(totals, [NET], [F.col("person_id")], F.col("_n"), "_base").join(top, NET, "left").select(*one, start.alias("_start")))

    at = F.row_number().over(Window.partitionBy(NET, "source_id").orderBy("target_id")).cast("long")
    late = own_sort.withColumn("_at", at).unionByName(far_sort.select(*own_sort.columns, "_at"))
    late = late.join(starts.withColumnRenamed("person_id", "source_id"), [NET, "source_id"]).select(*EDGE_KEY, (F.col("_start") + F.col("_at")).alias("edge_id"), "w")

    # What of a person's lists falls into a block, and how many edges come before it.
    here = lambda x: (F.col("_from").isNull() | (x >= F.col("_from"))) & (F.col("_to").isNull() | (x < F.col("_to")))
    some = lambda xs: F.when(F.size(xs) > 0, xs)
    edges = lambda c: some(F.transform(F.filter("edges", lambda e: (e[c] == 1) & here(e["target_id"])), lambda e: e["target_id"])).alias(f"_{c}")
    before = (
        F.col("_j") * A.BLOCK - F.col("place") + count(F.filter("far", lambda x: x < F.col("_from")))
        + sum_of(F.filter("edges", lambda e: e["target_id"] < F.col("_from")))
    )
    base = F.col("_start") + F.when(F.col("_from").isNull(), 0).otherwise(before)
    met = A.meetings(plain.join(starts, one), members, [base.alias("_base"), some(F.filter("far", here)).alias("_far"), edges("new"), edges("old")])
    none = F.array().cast("array<long>")
    found = F.concat("met", F.coalesce("_far", none))
    found = F.when(F.col("_old").isNull(), found).otherwise(F.array_except(found, "_old"))
    found = F.sort_array(F.concat(found, F.coalesce("_new", none)))
    plainly = F.coalesce("_far", "_new", "_old").isNull()
    met = met.select(NET, F.col("low_id").alias("source_id"), "_base", "_new", F.when(plainly, F.col("met")).otherwise(found).alias("to"))
    direct = met.filter("_new IS NOT NULL").select(NET, "source_id", "_base", "to", F.explode("_new").alias("target_id"))
    direct = direct.select(*EDGE_KEY, (F.col("_base") + F.array_position("to", F.col("target_id"))).alias("edge_id"))
    pairs = A.each(met, "to", "target_id").filter(~F.coalesce(F.array_contains("_new", F.col("target_id")), F.lit(False)))
    pairs = pairs.select(*EDGE_KEY, (F.col("_base") + F.col("_place") + 1).alias("edge_id"))
    return late.unionByName(direct.join(written, EDGE_KEY)).unionByName(pairs, allowMissingColumns=True)
