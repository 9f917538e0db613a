"""Best introduction path from every network's owner, over edges and over shared companies.

All networks are searched at once in rounds. A round offers every node that improved to its
neighbours, reduces the offers to the best one of each node, and writes only the nodes that improved.
After ``max_hops`` rounds every node that can be in the result has its best short path. A longer path
matters only if it is cheaper still, so later rounds follow nothing that cannot get below the most
expensive of these paths: a long chain ends where its cost does.

People of one company know each other. Instead of an edge for every pair, a company is a node between
its people: each round it takes the best of its people that improved and offers them to all others. A
pair with an edge of its own is ruled by that edge alone; a person with b such colleagues looks at the
first b + 1 entries of the company, one of which is free.

Edge costs are whole numbers (60 / strength), so equal path costs are exactly equal.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from tieweave.functions import values as V
from tieweave.operators.analytics import memberships
from tieweave.operators.folding import both_ways, undirected
from tieweave.session import Scratch, cut

UNIT = 60  # least common multiple of the strengths 1..5
LEGS_PER_SLICE = 100_000
#: Salts under which the best entries of a company are taken first.
SALTS = 32
NET = "network_id"


def clamp_floor(floor: int) -> int:
    return max(1, min(5, floor))


def weighted_graph(edges: DataFrame, me: DataFrame, max_hops: int = 3, weak_me_floor: int = 4) -> DataFrame:
    """Undirected edges with their cost; weak edges to the owner are made expensive."""
    floor, penalty = clamp_floor(weak_me_floor), max_hops * max_hops * 4
    base = (F.lit(UNIT) / F.greatest(F.col("strength"), F.lit(1))).cast("long")
    touches = (F.col("low_id") == F.col("me_id")) | (F.col("high_id") == F.col("me_id"))
    return (
        undirected(edges).join(me.select(NET, "me_id"), NET, "left")
        .withColumn("cost", F.when(F.coalesce(touches, F.lit(False)) & (F.col("strength") < floor), base * penalty).otherwise(base))
        .drop("me_id")
    )


def _sliced(rows: DataFrame, key: list[str], spread: str, per_slice: int) -> tuple[DataFrame, DataFrame]:
    """Rows with a ``slice`` of at most about ``per_slice`` rows of one key, and the keys that have more than one slice.

    An owner may touch a third of all edges, a company may hold a third of all people: their rows
    never share one partition. There are at most (rows / ``per_slice``) such keys.
    """
    large = rows.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / per_slice).cast("int").alias("slices")).filter("slices > 1")
    sliced = rows.join(large, key, "left").withColumn("slice", F.pmod(F.xxhash64(spread), F.coalesce("slices", F.lit(1))).cast("int"))
    return sliced.drop("slices").repartition(*key, "slice"), large


def _to_slices(rows: DataFrame, key: list[str], large: DataFrame) -> DataFrame:
    """Every row once for each slice of its key."""
    counted = rows.join(large, key, "left")
    return counted.withColumn("slice", F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1))).drop("slices")


@dataclass
class Companies:
    """Who is in which company: sliced by company, and by person with the number of entries the company must name."""

    members: DataFrame
    large: DataFrame
    of_person: DataFrame
    cost: int
    strength: int


def company_nodes(people: DataFrame, edges: DataFrame, strength: int, per_slice: int, scratch: Scratch) -> Companies:
    """Companies of two people and more, each person with the colleagues that an edge of its own rules (``barred``)."""
    key = [NET, "company"]
    rows = memberships(people).withColumnRenamed("person_id", "node")
    rows = scratch.keep(rows.join(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*key), key))
    ways = both_ways(undirected(edges).select(NET, "low_id", "high_id"))
    mine = ways.join(rows.select(NET, F.col("node").alias("from_id"), "company"), [NET, "from_id"])
    both = mine.join(rows.select(NET, F.col("node").alias("to_id"), "company"), [NET, "to_id", "company"])
    barred = both.groupBy(NET, "company", F.col("to_id").alias("node")).agg(F.collect_set("from_id").alias("barred"))
    marked = scratch.keep(rows.join(barred, [*key, "node"], "left").withColumn("n_barred", F.coalesce(F.size("barred"), F.lit(0))))
    most = marked.groupBy(*key).agg((F.max("n_barred") + 1).alias("most"))
    members, large = _sliced(marked, key, "node", per_slice)
    return Companies(scratch.hold(members), scratch.keep(large), scratch.keep(marked.select(*key, "node").join(most, key)), UNIT // strength, strength)


def _next(k: str, cost, strength, to, max_hops: int):
    """Best path ``k`` with one leg more; of paths longer than ``max_hops`` only cost and length are known."""
    hops = F.col(f"{k}.hops") + 1
    short = hops <= max_hops
    return F.struct(
        (F.col(f"{k}.cost") + cost).alias("cost"), hops.alias("hops"),
        F.when(short, F.array_append(F.col(f"{k}.path"), to)).alias("path"),
        F.when(short, F.array_append(F.col(f"{k}.strengths"), strength)).alias("strengths"),
    )


def _offers(frontier: DataFrame, legs: DataFrame, hubs: DataFrame, companies: Companies | None, max_hops: int, unit_cost: bool) -> DataFrame:
    """network_id, node, k: what the frontier offers to its neighbours."""
    step = _to_slices(frontier, [NET, "node"], hubs).join(legs, [NET, "node", "slice"])
    cost = F.lit(1).cast("long") if unit_cost else F.col("cost")
    over_edges = step.select(NET, F.col("to_id").alias("node"), _next("k", cost, F.col("strength"), F.col("to_id"), max_hops).alias("k"))
    if companies is None:
        return over_edges
    key = [NET, "company"]
    entries = frontier.join(companies.of_person, [NET, "node"]).withColumnRenamed("node", "x")
    salted = Window.partitionBy(*key, F.pmod(F.xxhash64("x"), F.lit(SALTS))).orderBy("k", "x")
    first = entries.withColumn("place", F.row_number().over(salted)).filter("place <= most")
    listed = first.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy("k", "x"))).filter("place <= most").drop("most")
    listed = _to_slices(listed, key, companies.large)
    free = (F.col("x") != F.col("node")) & ~F.coalesce(F.array_contains("barred", F.col("x")), F.lit(False))
    # Whoever bars nobody is served by the first entry.
    served = listed.filter("place = 1").join(companies.members, [*key, "slice"]).filter(free)
    others = listed.filter("place > 1").join(companies.members.filter("n_barred > 0"), [*key, "slice"]).filter(free & (F.col("place") <= F.col("n_barred") + 1))
    leg = F.lit(1 if unit_cost else companies.cost).cast("long")
    return over_edges.unionByName(
        served.unionByName(others).select(NET, "node", _next("k", leg, F.lit(companies.strength), F.col("node"), max_hops).alias("k"))
    )


def _improved(written: list[DataFrame], offers: DataFrame) -> DataFrame:
    """The best offer of every node for which nothing as good was written. Minima combine before the shuffle."""
    rows = offers.select(NET, "node", "k", F.lit(False).alias("old"))
    for known in written:
        rows = rows.unionByName(known.select(NET, "node", "k", F.lit(True).alias("old")))
    merged = rows.groupBy(NET, "node").agg(F.min("k").alias("k"), F.min(F.when(F.col("old"), F.col("k"))).alias("was"))
    return merged.filter(F.col("was").isNull() | (F.col("k") < F.col("was"))).select(NET, "node", "k")


def _best(written: list[DataFrame]) -> DataFrame:
    rows = written[0]
    for more in written[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy(NET, "node").agg(F.min("k").alias("k"))


def _rounds(start: DataFrame, offers, max_hops: int, scratch: Scratch, least: int | None) -> tuple[DataFrame, DataFrame | None]:
    """Best k of every node over at most ``max_hops`` legs by cost, hops and path; and the nodes that longer paths reach cheaper.

    ``least``: cost of the cheapest leg; None ends the search after ``max_hops`` rounds.
    """
    written = [scratch.keep(start)]
    for _ in range(max_hops):
        written.append(scratch.keep(_improved(written, offers(written[-1]))))
        if written[-1].isEmpty():
            return _best(written), None
    short = scratch.keep(_best(written))
    if least is None:
        return short, None
    # A longer path has at least this cost, and is of use only below the short path of its node.
    bound = short.filter(F.col("k.cost") > least * (max_hops + 1)).groupBy(NET).agg(F.max("k.cost").alias("bound"))
    if bound.isEmpty():
        return short, None
    bound = scratch.keep(bound)
    within = lambda rows, ahead: rows.join(bound, NET).filter(F.col("k.cost") + ahead < F.col("bound")).drop("bound")
    longer = [scratch.keep(_improved([short], within(offers(within(written[-1], least)), 0)))]
    while not longer[-1].isEmpty():
        longer.append(scratch.keep(_improved([short, *longer], within(offers(within(longer[-1], least)), 0))))
    if len(longer) == 1:
        return short, None
    return short, _best(longer[:-1]).join(short.select(NET, "node"), [NET, "node"], "left_semi").select(NET, "node")


def path_forest(
    edges: DataFrame, me: DataFrame, max_hops: int = 3, weak_me_floor: int = 4, legs_per_slice: int = LEGS_PER_SLICE,
    people: DataFrame | None = None, over_companies: bool = False, colleague_strength: int = V.COLLEAGUE_STRENGTH,
) -> DataFrame:
    """Best introduction path from the owner to everyone reachable within ``max_hops``.

    The cheapest path is searched without a length limit. Where it is too long, the path with the
    fewest hops takes its place; where that is too long too, the person is left out. ``people``: edges
    of anybody else are no edges. ``over_companies``: people of one company know each other with
    ``colleague_strength``, as if they had an edge each, which needs ``people``. Rows: network_id,
    person_id, hops, path, strengths, path_strength, kind.
    """
    floor = clamp_floor(weak_me_floor)
    if people is not None:
        there = people.select(NET, "person_id").distinct()
        for end in ("source_id", "target_id"):
            edges = edges.join(there.withColumnRenamed("person_id", end), [NET, end], "left_semi")
    with Scratch(edges.sparkSession) as scratch:
        graph = weighted_graph(edges, me, max_hops, floor)
        ways = both_ways(graph.select(NET, "low_id", "high_id", "strength", "cost")).withColumnRenamed("from_id", "node")
        legs, hubs = _sliced(ways, [NET, "node"], "to_id", legs_per_slice)
        # Laid out once: every round finds the legs where the frontier is sent.
        legs, hubs = scratch.hold(legs), scratch.keep(hubs)
        companies = company_nodes(people, edges, colleague_strength, legs_per_slice, scratch) if over_companies else None
        start = me.select(
            NET, F.col("me_id").alias("node"),
            F.struct(
                F.lit(0).cast("long").alias("cost"), F.lit(0).alias("hops"),
                F.array("me_id").alias("path"), F.array().cast("array<int>").alias("strengths"),
            ).alias("k"),
        )
        least = legs.agg(F.min("cost")).first()[0]
        if companies and least is not None:
            least = min(least, companies.cost)
        offers = lambda frontier: _offers(frontier, legs, hubs, companies, max_hops, False)
        short, too_long = _rounds(start, offers, max_hops, scratch, least)
        chosen = short.filter("k.hops >= 1")
        if too_long is not None:
            too_long = scratch.keep(too_long)
            by_hops = lambda frontier: _offers(frontier, legs, hubs, companies, max_hops, True)
            some = start.join(too_long.select(NET).distinct(), NET, "left_semi")
            fewest = _rounds(some, by_hops, max_hops, scratch, None)[0].join(too_long, [NET, "node"], "left_semi")
            chosen = chosen.join(too_long, [NET, "node"], "left_anti").unionByName(fewest)
        total = F.aggregate("strengths", F.lit(0), lambda a, x: a + x)
        out = chosen.select(
            NET, F.col("node").alias("person_id"), F.col("k.hops").alias("hops"), F.col("k.path").alias("path"), F.col("k.strengths").alias("strengths"),
        ).withColumn("path_strength", total)
        return cut(out.withColumn("kind", path_kind(F.col("hops"), F.get("strengths", F.lit(0)), floor)))


def path_kind(hops, first_strength, floor: int):
    """direct / weak for one hop (by strength), else indirect."""
    return F.when(hops > 1, "indirect").when(first_strength < floor, "weak").otherwise("direct")
