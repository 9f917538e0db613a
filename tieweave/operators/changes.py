"""Change logs folded into snapshots, deletions with everything that hangs on them,
ticket numbers and embedding upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tieweave.functions.people import embed_text
from tieweave.operators.ranking import positions
from tieweave.schema import ATTRIBUTES

NET = "network_id"
PATCHED = ("name", "bio", "notes", *ATTRIBUTES, "is_wishlist")


def fold_person_patches(log: DataFrame) -> DataFrame:
    """Last given value per field and the last operation, per person.

    log: network_id, person_id, seq, op (put / delete) and the patch fields, where null
    leaves a field as it is. Patches before a delete do not survive it.
    """
    key = [NET, "person_id"]
    gone = log.filter("op = 'delete'").groupBy(*key).agg(F.max("seq").alias("_gone"))
    live = log.filter("op <> 'delete'").join(gone, key, "left").filter(F.col("_gone").isNull() | (F.col("seq") > F.col("_gone")))
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("seq", F.col(c).alias("v"))))["v"].alias(c)
    folded = live.groupBy(*key).agg(*[last(c) for c in PATCHED])
    state = folded.join(gone.select(*key, F.lit(True).alias("reset")), key, "full")
    return state.withColumn("reset", F.coalesce("reset", F.lit(False))).withColumn("alive", F.col("name").isNotNull() | ~F.col("reset"))


def apply_person_patches(people: DataFrame, log: DataFrame) -> DataFrame:
    """Snapshot after a change log: add, partly change, delete, set the wishlist mark.

    A blank new name is ignored; a person only exists once a name is given.
    """
    clean = log.withColumn("name", F.when(F.trim("name") != "", F.trim("name")))
    delta = fold_person_patches(clean).select(NET, "person_id", "reset", *[F.col(c).alias(f"_{c}") for c in PATCHED])
    rows = people.join(delta, [NET, "person_id"], "full").withColumn("reset", F.coalesce("reset", F.lit(False)))
    kept = lambda c: F.coalesce(f"_{c}", F.when(~F.col("reset"), F.col(c)))
    none = F.array().cast("array<string>")
    cols = []
    for c in people.columns:
        if c in ATTRIBUTES:
            cols.append(F.coalesce(kept(c), none).alias(c))
        elif c == "is_wishlist":
            cols.append(F.coalesce(kept(c), F.lit(False)).alias(c))
        elif c in PATCHED:
            cols.append(kept(c).alias(c))
        elif c == "is_me":
            cols.append(F.coalesce("is_me", F.lit(False)).alias(c))
        else:
            cols.append(F.col(c))
    return rows.select(*cols).filter(F.col("name").isNotNull())


def set_wishlist(people: DataFrame, marks: DataFrame) -> DataFrame:
    """Last mark per person wins: network_id, person_id, seq, on."""
    last = marks.groupBy(NET, "person_id").agg(F.max_by("on", "seq").alias("on"))
    return people.join(last, [NET, "person_id"], "left").withColumn("is_wishlist", F.coalesce("on", "is_wishlist")).select(*people.columns)


def delete_people(gone: DataFrame, people: DataFrame, edges: DataFrame, embeddings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Remove people with their edges and vectors; edges they introduced lose the introducer."""
    key = gone.select(NET, "person_id").distinct()
    at = lambda c: key.withColumnRenamed("person_id", c)
    rest = edges.join(at("source_id"), [NET, "source_id"], "left_anti").join(at("target_id"), [NET, "target_id"], "left_anti")
    marked = rest.join(at("introduced_by_id").withColumn("_x", F.lit(True)), [NET, "introduced_by_id"], "left")
    rest = marked.withColumn("introduced_by_id", F.when(F.col("_x").isNull(), F.col("introduced_by_id"))).select(*edges.columns)
    return people.join(key, [NET, "person_id"], "left_anti"), rest, embeddings.join(key, [NET, "person_id"], "left_anti")


def patch_edges(edges: DataFrame, patches: DataFrame) -> DataFrame:
    """Changed edges become manual; fields left null keep their value; deletes remove.

    patches: network_id, edge_id, seq, op (put / delete), strength, context, frequency.
    """
    key = [NET, "edge_id"]
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("seq", F.col(c).alias("v"))))["v"].alias(f"_{c}")
    folded = patches.groupBy(*key).agg(F.bool_or(F.col("op") == "delete").alias("_gone"), *[last(c) for c in ("strength", "context", "frequency")])
    rows = edges.join(folded, key, "left").filter(F.col("_gone").isNull() | ~F.col("_gone"))
    new = {c: F.coalesce(f"_{c}", c) for c in ("strength", "context", "frequency")}
    new["source"] = F.when(F.col("_gone").isNotNull(), F.lit("manual")).otherwise(F.col("source"))
    return rows.select(*[new[c].alias(c) if c in new else F.col(c) for c in edges.columns])


def ensure_owner(people: DataFrame, wanted: DataFrame) -> DataFrame:
    """The first request per network creates the owner, unless there is one.

    wanted: network_id, seq, person_id, name, bio.
    """
    first = wanted.groupBy(NET).agg(F.min(F.struct("seq", "person_id", "name", "bio")).alias("w"))
    missing = first.join(people.filter("is_me").select(NET).distinct(), NET, "left_anti")
    none = F.array().cast("array<string>")
    rows = missing.select(
        NET, F.col("w.person_id").alias("person_id"), F.col("w.name").alias("name"), F.col("w.bio").alias("bio"),
        F.lit(None).cast("string").alias("notes"), F.lit(True).alias("is_me"), F.lit(False).alias("is_wishlist"),
        *[none.alias(k) for k in ATTRIBUTES],
    )
    return people.select(*rows.columns).unionByName(rows)


def upsert_vectors(embeddings: DataFrame, writes: DataFrame) -> DataFrame:
    """Last written vector per person; ``writes`` carry ``seq``."""
    last = writes.groupBy(NET, "person_id").agg(F.max_by("vector", "seq").alias("vector"))
    old = embeddings.select(NET, "person_id", "vector").join(last.select(NET, "person_id"), [NET, "person_id"], "left_anti")
    return old.unionByName(last)


def embedding_worklist(people: DataFrame, done: DataFrame) -> DataFrame:
    """People with a bio whose embedding text has changed or was never embedded.

    done: network_id, person_id, text_hash of the text last embedded.
    """
    text = embed_text()
    rows = people.filter(~F.col("is_me") & (F.coalesce("bio", F.lit("")) != "")).select(
        NET, "person_id", text.alias("text"), F.sha2(text, 256).alias("text_hash")
    )
    return rows.join(done.select(NET, "person_id", "text_hash"), [NET, "person_id", "text_hash"], "left_anti")


def number_tickets(tickets: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """FB-YYYYMMDD-NNNN ids per day, going on from the day's largest.

    tickets: ts, seq and payload columns. existing: ticket_id.
    """
    days = tickets.withColumn("day", F.date_format("ts", "yyyyMMdd"))
    numbered = positions(days, ["day"], [F.col("seq")], "_n")
    if existing is not None:
        parts = F.split("ticket_id", "-")
        used = existing.groupBy(parts[1].alias("day")).agg(F.max(parts[2].cast("long")).alias("_used"))
        numbered = numbered.join(used, "day", "left").withColumn("_n", F.col("_n") + F.coalesce("_used", F.lit(0))).drop("_used")
    return numbered.withColumn("ticket_id", F.format_string("FB-%s-%04d", "day", "_n")).drop("_n", "day")


def find_tickets(tickets: DataFrame, ids: list[str]) -> DataFrame:
    return tickets.filter(F.col("ticket_id").isin(*ids))


