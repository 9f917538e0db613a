"""Network construction: cleaned rows to people and provenance-tracked edges."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, functions as F, types as T

from tieweave.functions import values as V
from tieweave.operators.analytics import NET, clique_summary, me_rows
from tieweave.operators.colleagues import free_pairs, numbered, ruled_pairs
from tieweave.operators.folding import merge_people, pair_choice, replace_people, upsert_edges
from tieweave.operators.numbering import mark_known, with_edge_ids
from tieweave.operators.ranking import positions
from tieweave.operators.validation import split_contact_rows
from tieweave.schema import ATTRIBUTES
from tieweave.session import kept
from tieweave.sources.contacts import peer_mentions

EDGE_COLUMNS = ["network_id", "source_id", "target_id", "strength", "context", "frequency", "source", "seq"]


@dataclass
class Built:
    """What an import makes. Edges are many times the rows where colleagues are inferred, so nothing of them is made before they are asked for."""

    people: DataFrame
    writes: DataFrame  # what rows and known edges tell of edges
    colleague_strength: int | None  # of the edges between colleagues; null: none are made
    known: DataFrame | None
    unresolved: DataFrame
    stats: DataFrame
    refused: DataFrame

    @cached_property
    def told(self) -> DataFrame:
        """The best write of every direction, made once: it is asked for ruled pairs and folded on."""
        return kept(upsert_edges(self.writes, keep_seq=True))

    @cached_property
    def ruled(self) -> DataFrame:
        return ruled_pairs(self.people, self.told)

    @cached_property
    def written(self) -> DataFrame:
        """The edges that rows and known edges tell, without ids; shared companies are the last write."""
        if self.colleague_strength is None:
            return upsert_edges(self.writes)
        return upsert_edges(_with_colleagues(self.told, self.ruled, self.colleague_strength))

    @cached_property
    def folded(self) -> DataFrame:
        """All edges without ids."""
        if self.colleague_strength is None:
            return self.written
        free = _lows(free_pairs(self.people, self.ruled))
        return self.written.unionByName(colleague_writes(free, self.colleague_strength), allowMissingColumns=True)

    @cached_property
    def edges(self) -> DataFrame:
        if self.colleague_strength is None:
            return with_edge_ids(self.written, self.known)
        return _with_pair_ids(self.people, self.written, self.ruled, self.known, self.colleague_strength)


def named_ids(people: DataFrame) -> DataFrame:
    """The person that a name stands for: of namesakes the one of least id."""
    return people.filter(~F.col("is_me")).groupBy(NET, "name").agg(F.min("person_id").alias("person_id"))


def with_existing(rows: DataFrame, existing: DataFrame | None, mode: str) -> DataFrame:
    """Fold rows into people; the known person of a row's name counts as written before every row."""
    fold = merge_people if mode == "merge" else replace_people
    cols = ["network_id", "name", "bio", "notes", *ATTRIBUTES, "is_wishlist"]
    new = rows.select(*cols, F.struct(F.lit(1).alias("step"), F.col("seq").alias("at")).alias("seq"))
    if existing is None:
        return fold(new)
    at = new.schema["seq"].dataType["at"].dataType
    asked = named_ids(existing).join(rows.select(NET, "name").distinct(), [NET, "name"], "left_semi").select(NET, "person_id")
    old = existing.join(asked, [NET, "person_id"], "left_semi").select(
        *cols, F.struct(F.lit(0).alias("step"), F.lit(None).cast(at).alias("at")).alias("seq")
    )
    return fold(new.unionByName(old))


def assign_ids(people: DataFrame, existing: DataFrame) -> DataFrame:
    """Keep known ids; number new people per network in the order they were first seen."""
    ids = named_ids(existing)
    # The fold feeds both halves below, so it is run once.
    marked = kept(people.join(ids, [NET, "name"], "left"))
    known = marked.filter(F.col("person_id").isNotNull())
    fresh = positions(marked.filter(F.col("person_id").isNull()).drop("person_id"), [NET], [F.col("first_seq"), F.col("name")], "_n")
    top = existing.groupBy(NET).agg(F.max("person_id").alias("_top"))
    numbered = fresh.join(top, NET, "left").withColumn(
        "person_id", F.col("_n") + F.greatest(F.coalesce("_top", F.lit(0)), F.lit(0))
    ).drop("_n", "_top")
    return known.unionByName(numbered).drop("first_seq").withColumn("is_me", F.lit(False))


def owner_edges(rows: DataFrame, people: DataFrame, me: DataFrame) -> DataFrame:
    """One edge write per contacted row, in row order."""
    ids = named_ids(people)
    frequency = F.col("frequency") if "frequency" in rows.columns else F.lit(V.DEFAULT_FREQUENCY)
    return rows.filter(~F.col("is_wishlist")).join(ids, [NET, "name"]).join(me, NET).select(
        NET, F.col("me_id").alias("source_id"), F.col("person_id").alias("target_id"), "strength", "context",
        frequency.alias("frequency"), F.lit("manual").alias("source"), "seq", *_day(rows),
    )


def _day(rows: DataFrame) -> list[str]:
    return ["last_contact"] if "last_contact" in rows.columns else []


def resolve_peers(mentions: DataFrame, people: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mentions with both ids, and mentions whose peer is not in the network."""
    ids = named_ids(people).withColumnRenamed("person_id", "id")
    a = ids.select(NET, "name", F.col("id").alias("a_id"))
    b = ids.select(NET, F.col("name").alias("peer"), F.col("id").alias("b_id"))
    both = mentions.join(a, [NET, "name"], "left").join(b, [NET, "peer"], "left")
    lost = both.filter(F.col("a_id").isNull() | F.col("b_id").isNull()).select(NET, "name", "peer", "seq")
    return both.filter("a_id <> b_id"), lost


def peer_edges(resolved: DataFrame, last_wins: bool) -> DataFrame:
    """One edge per pair: the first mention in a column, the last row of a sheet."""
    cols = [NET, "a_id", "b_id", "seq", "strength", "context"]
    rows = resolved.withColumn("frequency", F.col("frequency") if "frequency" in resolved.columns else F.lit(V.DEFAULT_FREQUENCY))
    picked = pair_choice(rows.select(*cols, "frequency", *_day(rows)), "a_id", "b_id", "seq", last_wins)
    return picked.select(
        NET, F.col("low_id").alias("source_id"), F.col("high_id").alias("target_id"), "strength", "context", "frequency",
        F.lit("manual").alias("source"), "seq", *_day(rows),
    )


def colleague_values(strength: int) -> dict:
    """What the edge of two colleagues says."""
    return {"strength": strength, "context": V.COLLEAGUE_CONTEXT, "frequency": V.COLLEAGUE_FREQUENCY, "source": "colleague_inferred"}


def colleague_writes(pairs: DataFrame, strength: int = V.COLLEAGUE_STRENGTH) -> DataFrame:
    """The edges that shared companies give ``pairs`` (source_id, target_id)."""
    return pairs.select(NET, "source_id", "target_id", *[F.lit(v).alias(c) for c, v in colleague_values(strength).items()])


def _lows(pairs: DataFrame) -> DataFrame:
    return pairs.withColumnsRenamed({"low_id": "source_id", "high_id": "target_id"})


def _with_colleagues(writes: DataFrame, ruled: DataFrame, strength: int) -> DataFrame:
    """Writes (``seq``: step and order in it) and, after them, what shared companies say of the same directions."""
    last = F.struct(F.lit(1 << 20).alias("step"), F.lit(None).cast(writes.schema["seq"].dataType["at"].dataType).alias("at"))
    return writes.unionByName(colleague_writes(ruled, strength).withColumn("seq", last), allowMissingColumns=True)


def _with_pair_ids(people: DataFrame, written: DataFrame, ruled: DataFrame, known: DataFrame | None, strength: int) -> DataFrame:
    """Written edges and one for every free pair of colleagues, with ids as ``with_edge_ids`` gives them."""
    marked = mark_known(written, known)
    fresh = marked.filter(F.col("edge_id").isNull()).drop("edge_id")
    top = written.select(NET, F.lit(0).cast("long").alias("_top")).limit(0) if known is None else known.groupBy(NET).agg(F.max("edge_id").alias("_top"))
    new = numbered(people, ruled, fresh, top)
    given = {c: F.lit(v) for c, v in colleague_values(strength).items()}
    cols = [F.when(F.col("w").isNull(), given.get(c, F.lit(None))).otherwise(F.col(f"w.{c}")).alias(c) for c in fresh.columns if c not in (NET, "source_id", "target_id")]
    return marked.filter(F.col("edge_id").isNotNull()).unionByName(new.select(NET, "source_id", "target_id", "edge_id", *cols))


def in_steps(batches: list[DataFrame], at: T.DataType) -> DataFrame:
    """Union of edge batches; every batch counts as written after the ones before it, ``seq`` (of type ``at``) orders the rows of a batch that has one.

    ``last_contact`` is part of a write where any batch has it.
    """
    out = None
    dated = any(_day(b) for b in batches)
    for step, batch in enumerate(batches):
        within = F.col("seq") if "seq" in batch.columns else F.lit(None)
        picked = batch.withColumn("seq", F.struct(F.lit(step).alias("step"), within.cast(at).alias("at")))
        day = F.col("last_contact") if _day(batch) else F.lit(None).cast("date").alias("last_contact")
        picked = picked.select(*EDGE_COLUMNS, *([day] if dated else []))
        out = picked if out is None else out.unionByName(picked)
    return out


def fold_colleagues(people: DataFrame, edges: DataFrame, strength: int = V.COLLEAGUE_STRENGTH) -> DataFrame:
    """Edges plus one edge per pair sharing a company, without ids; edges set by hand stay as they are."""
    return _beside(people, edges, strength).folded


def infer_colleagues(people: DataFrame, edges: DataFrame, strength: int = V.COLLEAGUE_STRENGTH) -> DataFrame:
    """``fold_colleagues`` with ids.

    Known edges keep id, introducer and further columns. Whoever only looks for paths needs no such
    edges: ``path_forest(over_companies=True)`` goes through the companies instead.
    """
    return _beside(people, edges, strength).edges


def _beside(people: DataFrame, edges: DataFrame, strength: int) -> Built:
    cols = [c for c in EDGE_COLUMNS if c != "seq"]
    writes = in_steps([edges.select(*cols)], T.LongType())
    return Built(people, writes, strength, edges, unresolved=None, stats=None, refused=None)


def build_network(
    rows: DataFrame, existing: DataFrame, edges: DataFrame | None = None, relations: DataFrame | None = None,
    mode: str = "merge", colleagues: bool = True, colleague_strength: int = V.COLLEAGUE_STRENGTH,
) -> Built:
    """Import cleaned rows into networks that hold at least their owner.

    Only the people that rows name are folded; everybody else, namesakes included, passes
    through. Rows of a strength outside 1..5 that are no wishes are not imported but returned.
    Edges come with ids and can be searched as they are. The ``last_contact`` of an edge is that of
    the write that won, null if that told none; where no rows tell days, known ones stay.

    Edge batches in order: known edges, owner edges, peers named in rows, relation
    sheet, shared companies. Within a batch the rules of that batch decide, across
    batches the provenance fold does.
    """
    me = me_rows(existing)
    rows = kept(rows)  # cleaned once, read by the fold and by every edge batch
    wishes = F.coalesce("is_wishlist", F.lit(False))
    fit, refused = split_contact_rows(rows.filter(~wishes))
    rows = rows.filter(wishes).unionByName(fit)
    # Every edge batch joins the people, so they are folded and numbered once.
    folded = assign_ids(with_existing(rows, existing, mode), existing)
    others = existing.filter(~F.col("is_me")).join(named_ids(existing).join(rows.select(NET, "name").distinct(), [NET, "name"], "left_semi"), [NET, "person_id"], "left_anti")
    people = kept(folded.unionByName(others.select(*folded.columns)))
    batches = [owner_edges(rows, people, me)]
    lost = []
    if "peers" in rows.columns:
        found, missing = resolve_peers(peer_mentions(rows), people)
        batches.append(peer_edges(found, last_wins=False).drop("seq"))
        lost.append(missing.select(NET, "name", "peer"))
    if relations is not None:
        found, missing = resolve_peers(relations, people)
        batches.append(peer_edges(found, last_wins=True).drop("seq"))
        lost.append(missing.select(NET, "name", "peer"))
    counts = [b.select(NET, F.lit(i).alias("step")) for i, b in enumerate(batches)]
    if edges is not None:
        # Known dates are part of the fold only where rows tell dates too; otherwise they stay.
        days = _day(edges) if any(_day(b) for b in batches) else []
        batches.insert(0, edges.select(*[c for c in EDGE_COLUMNS if c != "seq"], *days))
    unresolved = lost[0] if lost else rows.limit(0).select(NET, "name", F.col("name").alias("peer"))
    for more in lost[1:]:
        unresolved = unresolved.unionByName(more)
    steps = counts[0]
    for more in counts[1:]:
        steps = steps.unionByName(more)
    written = steps.groupBy(NET).agg(F.count_if(F.col("step") > 0).alias("peer_edges"))
    # Pairs of colleagues are counted without making them.
    pairs = clique_summary(people) if colleagues else people.limit(0).select(NET, F.lit(0).cast("long").alias("pairs"))
    stats = rows.groupBy(NET).agg(F.count(F.lit(1)).alias("people")).join(written, NET, "left").join(
        pairs.select(NET, F.col("pairs").alias("colleague_edges")), NET, "left"
    ).na.fill(0)
    owner = existing.filter("is_me").select("network_id", "person_id", "name", "bio", "notes", "is_me", "is_wishlist", *ATTRIBUTES)
    writes = in_steps(batches, rows.schema["seq"].dataType)
    return Built(owner.unionByName(people), writes, colleague_strength if colleagues else None, edges, unresolved, stats, refused)
