"""Network statistics, neighbourhoods, browsing and graph export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tieweave.functions import people as Q
from tieweave.functions.text import edge_key, scrub
from tieweave.operators.folding import both_ways, undirected
from tieweave.operators.ranking import top_k
from tieweave.schema import ATTRIBUTES
from tieweave.session import cut, kept

NET = "network_id"
MAX_LIGHT = 10  # companies per person up to which subsets are counted
BLOCK = 2_048  # people of one company per block
PAIRS = 8_000_000  # pairs of colleagues per task
PIECE = 64  # items of a list that are laid out as rows at once


def me_rows(people: DataFrame) -> DataFrame:
    """The owner of every network: network_id, me_id."""
    return people.filter("is_me").groupBy(NET).agg(F.min("person_id").alias("me_id"))


def contacts(people: DataFrame) -> DataFrame:
    return people.filter(~F.col("is_me"))


def list_contacts(people: DataFrame) -> DataFrame:
    return contacts(people).orderBy(NET, "name", "person_id")


def find_by_name(requests: DataFrame, people: DataFrame) -> DataFrame:
    """Exact names to ids, never the owner; of equal names the smallest id."""
    named = contacts(people).join(requests.select(NET, "name").distinct(), [NET, "name"], "left_semi")
    return named.groupBy(NET, "name").agg(F.min("person_id").alias("person_id"))


def long_attributes(people: DataFrame) -> DataFrame:
    """One row per attribute value: network_id, person_id, kind, ord, value."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("list")) for k in ATTRIBUTES])
    return people.select(NET, "person_id", F.explode(kinds).alias("a")).select(
        NET, "person_id", "a.kind", F.posexplode("a.list").alias("ord", "value")
    )


def hydrate(people: DataFrame, attributes: DataFrame) -> DataFrame:
    """Put the long attribute rows back as five ordered lists per person."""
    gather = lambda k: F.transform(
        F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("ord", "value")))), lambda x: x["value"]
    ).alias(k)
    lists = attributes.groupBy(NET, "person_id").agg(*[gather(k) for k in ATTRIBUTES])
    base = people.drop(*ATTRIBUTES)
    none = F.array().cast("array<string>")
    return base.join(lists, [NET, "person_id"], "left").select(*base.columns, *[F.coalesce(k, none).alias(k) for k in ATTRIBUTES])


# ---------------------------------------------------------------- edges and the owner


def me_edges(edges: DataFrame, me: DataFrame) -> DataFrame:
    """Edges that touch the owner, seen from the other side."""
    touch = (F.col("source_id") == F.col("me_id")) | (F.col("target_id") == F.col("me_id"))
    other = F.when(F.col("source_id") == F.col("me_id"), F.col("target_id")).otherwise(F.col("source_id"))
    return edges.join(me, NET).filter(touch).withColumn("person_id", other)


def strength_to_me(edges: DataFrame, me: DataFrame) -> DataFrame:
    return me_edges(edges, me).groupBy(NET, "person_id").agg(F.max("strength").alias("strength_to_me"))


def named_edges(edges: DataFrame, people: DataFrame) -> DataFrame:
    """Edges with both names and owner flags; edges to unknown people drop out."""
    a = people.select(NET, F.col("person_id").alias("source_id"), F.col("name").alias("a_name"), F.col("is_me").alias("a_is_me"))
    b = people.select(NET, F.col("person_id").alias("target_id"), F.col("name").alias("b_name"), F.col("is_me").alias("b_is_me"))
    return edges.join(a, [NET, "source_id"]).join(b, [NET, "target_id"])


def filter_edges(
    named: DataFrame, text: str | None = None, min_strength: int | None = None, sources: list[str] | None = None,
    include_me: bool = True, person_id: int | None = None,
) -> DataFrame:
    """Browse filter; every condition that is given must hold."""
    out = named
    if not include_me:
        out = out.filter(~F.col("a_is_me") & ~F.col("b_is_me"))
    if person_id is not None:
        out = out.filter((F.col("source_id") == person_id) | (F.col("target_id") == person_id))
    if min_strength is not None:
        out = out.filter(F.col("strength") >= min_strength)
    if sources is not None:
        out = out.filter(F.col("source").isin(*sources))
    word = (text or "").strip().lower()
    if word:
        hit = F.contains(F.lower("a_name"), F.lit(word)) | F.contains(F.lower("b_name"), F.lit(word))
        out = out.filter(hit | F.contains(F.lower(F.coalesce("context", F.lit(""))), F.lit(word)))
    return out


def edge_page(rows: DataFrame, offset: int = 0, limit: int = 100) -> DataFrame:
    """One page per network in browse order, with the network's total."""
    mine = F.when(F.col("a_is_me") | F.col("b_is_me"), 0).otherwise(1)
    order = [mine, F.col("strength").desc(), F.col("a_name"), F.col("b_name"), F.col("edge_id")]
    total = rows.groupBy(NET).agg(F.count(F.lit(1)).alias("total"))
    page = top_k(rows, [NET], order, offset + limit, "place").filter(F.col("place") > offset)
    return page.join(total, NET)


def neighbourhood(edges: DataFrame, people: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """Neighbours as rows (a well-connected person may have very many), with the edge.

    ``of``: network_id, person_id to restrict to.
    """
    named = people.select(NET, F.col("person_id").alias("to_id"), F.col("name").alias("neighbour"), F.col("is_me").alias("is_me_edge"))
    pairs = both_ways(undirected(edges))
    if of is not None:
        pairs = pairs.join(of.select(NET, F.col("person_id").alias("from_id")).distinct(), [NET, "from_id"], "left_semi")
    return pairs.join(named, [NET, "to_id"]).select(
        NET, F.col("from_id").alias("person_id"), F.col("to_id").alias("neighbour_id"), "neighbour",
        "strength", "context", "frequency", "edge_id", "is_me_edge",
    )


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(undirected(edges).select(NET, "low_id", "high_id")).groupBy(NET, F.col("from_id").alias("person_id")).agg(
        F.count(F.lit(1)).alias("degree")
    )


def summary_cards(people: DataFrame, edges: DataFrame) -> DataFrame:
    s2me = strength_to_me(edges, me_rows(people))
    return (
        people.join(degrees(edges), [NET, "person_id"], "left").join(s2me, [NET, "person_id"], "left")
        .select(NET, "person_id", "name", Q.industry(me_aware=True).alias("industry"),
                F.coalesce("strength_to_me", F.lit(0)).alias("strength"), Q.headline().alias("headline"),
                Q.talking_point().alias("reason"), F.coalesce("degree", F.lit(0)).alias("neighbours"))
    )


# ------------------------------------------------------------------------- graph export


def graph_nodes(people: DataFrame, edges: DataFrame) -> DataFrame:
    rows = people.join(strength_to_me(edges, me_rows(people)), [NET, "person_id"], "left")
    label = Q.industry(me_aware=True)
    strength = F.when(~F.col("is_me"), F.col("strength_to_me"))
    return rows.select(
        NET, "person_id", "name", label.alias("industry"), Q.industry_colour(label).alias("colour"),
        Q.node_size(strength, F.col("is_me")).alias("size"), "is_me", "is_wishlist",
        strength.alias("strength_to_me"), "bio", "notes", *ATTRIBUTES,
    )


def graph_edges(edges: DataFrame) -> DataFrame:
    return edges.select(
        NET, edge_key(F.col("source_id"), F.col("target_id")).alias("edge_key"), "source_id", "target_id",
        "strength", "context", "frequency", Q.edge_width(F.col("strength")).alias("width"),
        Q.edge_alpha(F.col("strength")).alias("alpha"),
    )


def visible_nodes(nodes: DataFrame, industries: list[str] | None = None, min_strength: int = 0, search: str = "") -> DataFrame:
    """Facet filter: industries and strength spare the owner, all search words must occur."""
    out = nodes
    if industries:
        out = out.filter(F.col("is_me") | F.col("industry").isin(*industries))
    if min_strength > 0:
        out = out.filter(F.col("is_me") | (F.coalesce("strength_to_me", F.lit(0)) >= min_strength))
    words = search.strip().lower().split()
    if words:
        hay = F.lower(F.concat_ws(" ", "name", "bio", "notes", "tags", "companies", "cities", "skills", "needs"))
        for w in words:
            out = out.filter(F.contains(hay, F.lit(w)))
    return out


def visible_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between two visible people; the owner's own edges stay hidden."""
    shown = nodes.filter(~F.col("is_me")).select(NET, "person_id")
    left = shown.withColumnRenamed("person_id", "source_id")
    right = shown.withColumnRenamed("person_id", "target_id")
    return edges.join(left, [NET, "source_id"], "left_semi").join(right, [NET, "target_id"], "left_semi")


def ambient_labels(nodes: DataFrame, count: int = 5, always_from: int = 5) -> DataFrame:
    """People whose label is always drawn: strongest few, plus the closest and the owner."""
    strength = F.coalesce("strength_to_me", F.lit(0))
    few = top_k(nodes.filter(~F.col("is_me")), [NET], [strength.desc(), F.col("size").desc(), F.col("person_id")], count)
    close = nodes.filter(F.col("is_me") | (strength >= always_from))
    return few.select(NET, "person_id").unionByName(close.select(NET, "person_id")).distinct()


def registry(people: DataFrame, networks: DataFrame | None = None) -> DataFrame:
    """One row per network: owner, contacts, display name."""
    out = people.groupBy(NET).agg(
        F.count_if(~F.col("is_me")).alias("contacts"), F.min(F.when(F.col("is_me"), F.col("person_id"))).alias("me_id")
    )
    if networks is None:
        return out.withColumn("display_name", F.col(NET))
    return out.join(networks.select(NET, "display_name"), NET, "left").withColumn("display_name", F.coalesce("display_name", NET))


# --------------------------------------------------------------------------- statistics


def totals(people: DataFrame, edges: DataFrame) -> DataFrame:
    p = contacts(people).groupBy(NET).agg(F.count(F.lit(1)).alias("total_contacts"))
    e = edges.groupBy(NET).agg(F.count(F.lit(1)).alias("total_relationships"))
    return people.select(NET).distinct().join(p, NET, "left").join(e, NET, "left").na.fill(0)


def by_industry(people: DataFrame) -> DataFrame:
    return contacts(people).groupBy(NET, Q.industry().alias("industry")).agg(F.count(F.lit(1)).alias("n"))


def by_strength(edges: DataFrame, people: DataFrame) -> DataFrame:
    return strength_to_me(edges, me_rows(people)).groupBy(NET, "strength_to_me").agg(F.count(F.lit(1)).alias("n"))


def top_values(people: DataFrame, field: str, k: int = 8) -> DataFrame:
    counts = contacts(people).select(NET, F.explode(field).alias("value")).groupBy(NET, "value").agg(F.count(F.lit(1)).alias("n"))
    return top_k(counts, [NET], [F.col("n").desc(), F.col("value")], k, "place")


def company_headcount(people: DataFrame) -> DataFrame:
    return (
        people.select(NET, "person_id", F.explode("companies").alias("company")).distinct()
        .groupBy(NET, "company").agg(F.count(F.lit(1)).alias("headcount"))
    )


# ---------------------------------------------------------------------------- colleagues


def memberships(people: DataFrame) -> DataFrame:
    return contacts(people).select(NET, "person_id", F.explode("companies").alias("company")).select(
        NET, F.trim("company").alias("company"), "person_id"
    ).filter("company <> ''").distinct()


def company_members(people: DataFrame) -> DataFrame:
    """Members of companies of two people and more: network_id, company (a number), n (its people), person_id, ``place`` (among
    them by id), ``heads`` (the first id of every block, null if there is one block) and ``earlier``: the person's larger companies, null if there are none."""
    rows = memberships(people).filter("person_id IS NOT NULL")
    sizes = rows.groupBy(NET, "company").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    # Numbers are compared for pairs where names would be; the checkpoint pins them.
    sizes = cut(sizes.withColumn("c", F.monotonically_increasing_id()))
    staff = Window.partitionBy(NET, "company")
    placed = rows.join(sizes, [NET, "company"]).withColumn("place", F.row_number().over(staff.orderBy("person_id")))
    head = F.when((F.col("place") - 1) % BLOCK == 0, F.col("person_id"))
    placed = placed.withColumn("heads", F.when(F.col("n") > BLOCK, F.sort_array(F.collect_list(head).over(staff))))
    # Large companies come first, as most pairs are theirs and need no look at earlier ones.
    own = placed.groupBy(NET, "person_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "c", "place", "heads"))).alias("own"))
    return own.select(NET, "person_id", "own", F.posexplode("own").alias("at", "o")).select(
        NET, F.col("o.c").alias("company"), (-F.col("o.m")).alias("n"), "person_id", "o.place", "o.heads",
        F.when(F.col("at") > 0, F.slice(F.col("own.c"), 1, F.col("at"))).alias("earlier"),
    )


def meetings(lows: DataFrame, members: DataFrame, low: list[Column] = (), later: bool = False) -> DataFrame:
    """Whom each of ``lows`` (rows of ``members``) meets: low_id, columns ``low`` and ``met``, the sorted greater ids of one block of the company.

    A company's people are dealt by id into blocks of ``BLOCK``, and a block meets itself and those behind it, so no
    row lists and no task sees more than one pair of blocks at once. People who share several companies meet in the
    first. ``later`` tells whether to look at everybody's first company or at all others: a first one needs no look at
    earlier ones. Rows of a first company come for every block from the person's own on, be ``met`` empty or not;
    ``low`` may name ``_j``, the block, and ``_from`` and ``_to``, the ids that it stands for (null: open).
    """
    key = [NET, "company", "_i", "_j"]
    block, last = [F.floor((F.col(c) - 1) / BLOCK).cast("int") for c in ("place", "n")]
    asked = lows.filter(F.col("earlier").isNotNull() if later else F.col("earlier").isNull())
    left = asked.withColumn("_i", block).withColumn("_j", F.explode(F.sequence(F.col("_i"), last)))
    left = left.withColumns({"_from": F.when(F.col("_j") > F.col("_i"), F.get("heads", F.col("_j"))), "_to": F.get("heads", F.col("_j") + 1)})
    skip = F.when(F.col("_i") == F.col("_j"), F.col("place") - F.col("_j") * BLOCK).otherwise(0)
    left = left.select(*key, F.col("person_id").alias("low_id"), F.col("earlier").alias("_x"), skip.alias("_skip"), *low)
    item = F.struct("person_id", "earlier") if later else F.col("person_id")
    blocks = members.groupBy(NET, "company", block.alias("_j")).agg(F.sort_array(F.collect_list(item)).alias("_block"))
    right = blocks.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_j"))))
    # The pairs are many more than the rows, so tasks follow their number and are not put together by size.
    pairs = members.agg(F.sum(F.col("n") - F.col("place"))).first()[0] or 0
    tasks = max(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(4_000, pairs // PAIRS))
    both = left.repartition(tasks, *key).join(right.repartition(tasks, *key), key)
    met = F.when(F.col("_skip") > 0, F.slice("_block", F.col("_skip") + 1, BLOCK)).otherwise(F.col("_block"))
    if later:
        met = F.transform(F.filter(met, lambda q: q["earlier"].isNull() | ~F.arrays_overlap("_x", q["earlier"])), lambda q: q["person_id"])
    return both.withColumn("met", met).drop("company", "_i", "_j", "_x", "_skip", "_block")


def each(rows: DataFrame, items: str, value: str, place: str = "_place") -> DataFrame:
    """Rows with every item of a list as ``value`` and its place in it, from 0.

    Lists are taken in pieces that meet the places of one piece: a join makes the many rows, and none of them is moved.
    """
    places = F.broadcast(rows.sparkSession.range(PIECE).select(F.col("id").cast("int").alias("_p")))
    size = F.size(items)
    pieces = rows.withColumn("_first", F.explode_outer(F.when(size > 0, F.sequence(F.lit(0), size - 1, F.lit(PIECE)))))
    met = pieces.withColumn("_left", size - F.col("_first")).join(places, F.col("_p") < F.col("_left"))
    return met.withColumn(place, F.col("_first") + F.col("_p")).withColumn(value, F.get(items, F.col(place))).drop("_first", "_left", "_p", items)


def colleague_pairs(people: DataFrame) -> DataFrame:
    """Every pair of people who share a company: low_id, high_id. The pairs are the result itself (one edge each)."""
    members = kept(company_members(people))
    return each(all_meetings(members, members), "met", "high_id").select(NET, "low_id", "high_id")


def all_meetings(lows: DataFrame, members: DataFrame, low: list[Column] = ()) -> DataFrame:
    """``meetings`` in all companies; every pair of people who share some is in one of them."""
    first = meetings(lows, members, low)
    if members.filter("earlier IS NOT NULL").isEmpty():
        return first
    return first.unionByName(meetings(lows, members, low, later=True))


def clique_summary(people: DataFrame) -> DataFrame:
    """Per network: companies with two or more people, and distinct pairs they make.

    Nothing pairwise is built: pairs sharing at least one company are counted by
    inclusion and exclusion over the company sets people have in common. Sets of
    more than ``MAX_LIGHT`` companies are paired explicitly instead. People with the
    same companies count as one set of that many people, so copies cost nothing.
    """
    rows = memberships(people)
    sizes = rows.groupBy(NET, "company").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    cliques = sizes.groupBy(NET).agg(F.count(F.lit(1)).alias("companies"))
    shared = rows.join(sizes, [NET, "company"], "left_semi")
    sets = shared.groupBy(NET, "person_id").agg(F.array_sort(F.collect_set("company")).alias("s")).groupBy(NET, "s").agg(F.count(F.lit(1)).alias("n"))
    light = sets.filter(F.size("s") <= MAX_LIGHT)
    none = F.array(F.array().cast("array<string>"))
    grow = lambda acc, x: F.concat(acc, F.transform(acc, lambda t: F.array_append(t, x)))
    subsets = light.select(NET, "n", F.explode(F.aggregate("s", none, grow)).alias("t")).filter(F.size("t") > 0)
    held = subsets.groupBy(NET, "t").agg(F.sum("n").alias("n"))
    sign = F.when(F.size("t") % 2 == 1, 1).otherwise(-1)
    counted = held.select(NET, (sign * (F.col("n") * (F.col("n") - 1) / 2)).cast("long").alias("pairs"))
    heavy = sets.filter(F.size("s") > MAX_LIGHT)
    among = heavy.select(NET, (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("pairs"))
    of = lambda x, d: d.select(NET, F.explode("s").alias("company"), F.col("s").alias(f"s_{x}"), F.col("n").alias(f"n_{x}"))
    # Two heavy sets meet once, the lesser first; a heavy and a light one in one order only.
    once = (F.size("s_b") <= MAX_LIGHT) | (F.col("s_a") < F.col("s_b"))
    extra = (
        of("a", heavy).join(of("b", sets), [NET, "company"]).filter(once).select(NET, "s_a", "s_b", "n_a", "n_b").distinct()
        .groupBy(NET).agg(F.sum(F.col("n_a") * F.col("n_b")).alias("pairs")).unionByName(among)
    )
    pairs = counted.unionByName(extra).groupBy(NET).agg(F.sum("pairs").alias("pairs"))
    return cliques.join(pairs, NET, "left")


def top_cliques(people: DataFrame, k: int = 10) -> DataFrame:
    sizes = memberships(people).groupBy(NET, "company").agg(F.count(F.lit(1)).alias("members")).filter("members >= 2")
    return top_k(sizes, [NET], [F.col("members").desc(), F.col("company")], k, "place")


# ------------------------------------------------------------------------ ego snapshots


def snapshot_people(requests: DataFrame, people: DataFrame, edges: DataFrame) -> DataFrame:
    """Requested people with scrubbed texts and their edge to the owner; unknown ids stay.

    Requests: ticket_id, network_id, person_id.
    """
    mine = me_edges(
        undirected(edges).withColumnsRenamed({"low_id": "source_id", "high_id": "target_id"}), me_rows(people)
    ).select(NET, "person_id", F.col("strength").alias("me_strength"), F.col("frequency").alias("me_frequency"),
             scrub(F.col("context")).alias("me_context"))
    known = contacts(people).withColumn("found", F.lit(True))
    return (
        requests.join(known, [NET, "person_id"], "left").join(mine, [NET, "person_id"], "left")
        .select("ticket_id", NET, "person_id", F.col("found").isNull().alias("missing"), "name",
                F.when(F.col("found"), scrub(F.col("bio"))).alias("bio"), F.when(F.col("found"), scrub(F.col("notes"))).alias("notes"),
                "tags", "skills", "companies", "cities", "is_wishlist", "me_strength", "me_frequency", "me_context")
    )


def snapshot_neighbours(requests: DataFrame, people: DataFrame, edges: DataFrame) -> DataFrame:
    """One-hop neighbours of the requested people, the owner left out."""
    known = contacts(people).select(NET, "person_id")
    near = neighbourhood(edges, people, requests).filter(~F.col("is_me_edge"))
    return requests.join(known, [NET, "person_id"], "left_semi").join(near, [NET, "person_id"]).select(
        "ticket_id", NET, "person_id", "neighbour_id", "neighbour", "strength", "frequency"
    )


