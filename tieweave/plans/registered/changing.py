"""Change logs, deletions, validation, tickets, embedding upkeep and streams."""

import hashlib

from pyspark.sql import functions as F

from tieweave.functions import people as Q
from tieweave.functions import text as X
from tieweave.operators import analytics as A, changes as C, plugins as U, validation as D
from tieweave.plans.registered.base import query
from tieweave.plans.registered.building import EDGE_STATE
from tieweave.plans.registered.network import SCRUB, _tickets
from tieweave.plans.registered.building import _EMBED
from tieweave.session import work_path
from tieweave.sources.testbed import edge_changes, raw_stream
from tieweave.streaming import jobs as S

_NONE = lambda: F.lit(None).cast("string")


def patch_log(t, stream=False):
    """Person changes from the events: notes set, tags replaced, wishlist set, deletes, adds."""
    e = raw_stream(t.spark, t.sf, "events") if stream else t.raw("events")
    kind, u = F.col("event_type"), F.col("user_id")
    new = kind == "signup"
    none = F.lit(None).cast("array<string>")
    return e.select(
        F.concat(F.lit("n"), (u % 25).cast("string")).alias("network_id"), u.alias("person_id"), F.struct("ts", "event_id").alias("seq"),
        F.when((kind == "error") & (F.col("event_id") % 3 == 0), "delete").otherwise("put").alias("op"),
        F.when(new, F.concat(F.lit("User "), u.cast("string"))).when(kind == "view", F.lit(" ")).alias("name"),
        F.when(new, F.concat(F.lit("bio "), F.col("event_id").cast("string"))).alias("bio"),
        F.when(kind == "click", F.concat(F.lit("note "), F.col("event_id").cast("string"))).alias("notes"),
        F.when(kind == "purchase", F.array(F.concat(F.lit("tag"), (F.col("event_id") % 7).cast("string")))).alias("tags"),
        none.alias("skills"), none.alias("companies"), none.alias("cities"), none.alias("needs"),
        F.when(kind == "view", F.col("event_id") % 2 == 0).alias("is_wishlist"),
    )


def _start(t):
    """People before the log: the users with even ids."""
    ids = t.raw("events").select(F.col("user_id").alias("person_id")).distinct().filter("person_id % 2 = 0")
    none = F.array().cast("array<string>")
    return ids.select(
        F.concat(F.lit("n"), (F.col("person_id") % 25).cast("string")).alias("network_id"), "person_id", F.concat(F.lit("Old "), F.col("person_id").cast("string")).alias("name"),
        _NONE().alias("bio"), F.lit("old").alias("notes"), F.lit(False).alias("is_me"), F.lit(True).alias("is_wishlist"), F.array(F.lit("start")).alias("tags"),
        none.alias("skills"), none.alias("companies"), none.alias("cities"), none.alias("needs"),
    )


PEOPLE_STATE = """WITH lg AS (SELECT *, {t: ts, e: event_id} AS o FROM events),
  del AS (SELECT user_id, max(o) AS d FROM lg WHERE event_type = 'error' AND event_id % 3 = 0 GROUP BY 1),
  live AS (SELECT lg.* FROM lg LEFT JOIN del USING (user_id) WHERE (d IS NULL OR o > d) AND NOT (event_type = 'error' AND event_id % 3 = 0)),
  agg AS (SELECT user_id, max(CASE WHEN event_type = 'signup' THEN 'User ' || user_id END) AS name, arg_max('bio ' || event_id, o) FILTER (WHERE event_type = 'signup') AS bio,
    arg_max('note ' || event_id, o) FILTER (WHERE event_type = 'click') AS notes, arg_max('tag' || (event_id % 7), o) FILTER (WHERE event_type = 'purchase') AS tags,
    arg_max(event_id % 2 = 0, o) FILTER (WHERE event_type = 'view') AS w FROM live GROUP BY 1),
  ids AS (SELECT DISTINCT user_id FROM events)
  SELECT 'n' || (user_id % 25) AS network_id, user_id AS person_id, name, bio, notes, tags, is_wishlist FROM (
   SELECT i.user_id, coalesce(a.name, CASE WHEN keep THEN 'Old ' || i.user_id END) AS name, a.bio, coalesce(a.notes, CASE WHEN keep THEN 'old' END) AS notes,
     coalesce(a.tags, CASE WHEN keep THEN 'start' ELSE '' END) AS tags, coalesce(a.w, keep) AS is_wishlist
   FROM (SELECT ids.user_id, ids.user_id % 2 = 0 AND d IS NULL AS keep FROM ids LEFT JOIN del USING (user_id)) i LEFT JOIN agg a USING (user_id)) WHERE name IS NOT NULL"""
_SHOWN = ["network_id", "person_id", "name", "bio", "notes", "tags", "is_wishlist"]


@query("l1_person_changes", PEOPLE_STATE)
def _(t):
    return C.apply_person_patches(_start(t), patch_log(t)).select(*_SHOWN)


@query("c6_wishlist_marks", "SELECT p.network_id, p.person_id, coalesce(w, is_wishlist) AS is_wishlist FROM person p LEFT JOIN (SELECT user_id, arg_max(event_type = 'click', {t: ts, e: event_id}) AS w FROM events GROUP BY 1) e ON p.person_id = e.user_id")
def _(t):
    net = A.contacts(t.person).select("network_id", F.col("person_id").alias("user_id"))
    marks = t.raw("events").join(net, "user_id").select(
        "network_id", F.col("user_id").alias("person_id"), F.struct("ts", "event_id").alias("seq"), (F.col("event_type") == "click").alias("on")
    )
    return C.set_wishlist(t.person, marks).select("network_id", "person_id", "is_wishlist")


def _gone(t):
    return A.contacts(t.person).filter("person_id % 5 = 0").select("network_id", "person_id")


def _introduced(t):
    return t.edge.withColumn("introduced_by_id", F.col("target_id") % 100)


@query("d13_deleted_edges", "SELECT network_id, edge_id, CASE WHEN target_id % 100 % 5 = 0 AND EXISTS (FROM contact c WHERE c.network_id = edge.network_id AND c.person_id = target_id % 100) THEN NULL ELSE target_id % 100 END AS introduced_by_id FROM edge WHERE (source_id % 5 <> 0 OR source_id < 0) AND target_id % 5 <> 0")
def _(t):
    return C.delete_people(_gone(t), t.person, _introduced(t), t.embedding)[1].select("network_id", "edge_id", "introduced_by_id")


@query("d13_deleted_people", "SELECT network_id, person_id FROM person WHERE is_me OR person_id % 5 <> 0")
def _(t):
    return C.delete_people(_gone(t), t.person, t.edge, t.embedding)[0].select("network_id", "person_id")


@query("d13_deleted_vectors", "SELECT network_id, person_id FROM emb WHERE network_id = 'all' OR person_id % 5 <> 0")
def _(t):
    return C.delete_people(_gone(t), t.person, t.edge, t.embedding)[2].select("network_id", "person_id")


@query("l2_edge_changes", """SELECT network_id, source_id, target_id, CASE WHEN edge_id % 4 = 1 THEN 2 ELSE strength END AS strength, CASE WHEN edge_id % 4 = 2 THEN 'new ' || edge_id ELSE context END AS context,
  CASE WHEN edge_id % 4 IN (1, 2) THEN 'manual' ELSE source END AS source FROM (SELECT network_id, edge_id, source_id, target_id, strength, context, CASE WHEN edge_id % 3 = 0 THEN 'ai_inferred' ELSE source END AS source FROM edge) WHERE edge_id % 4 <> 3""")
def _(t):
    edges = t.edge.withColumn("source", F.when(F.col("edge_id") % 3 == 0, "ai_inferred").otherwise(F.col("source")))
    k = F.col("edge_id") % 4
    log = t.edge.filter("edge_id % 4 <> 0").select(
        "network_id", "edge_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("seq"), F.when(k == 3, "delete").otherwise("put").alias("op"),
        F.when(k == 1, 1).alias("first"), F.lit(None).cast("string").alias("frequency"), F.col("edge_id").alias("e"),
    ).select("network_id", "edge_id", "seq", "op", F.when(F.col("first") == 1, F.col("seq")).cast("int").alias("strength"), "frequency",
             F.when((F.col("e") % 4 == 2) & (F.col("seq") == 1), F.concat(F.lit("new "), F.col("e").cast("string"))).alias("context"))
    return C.patch_edges(edges, log).select("network_id", "source_id", "target_id", "strength", "context", "source")


@query("l3_owners_ensured", "SELECT network_id, person_id, name FROM person WHERE is_me UNION ALL SELECT 'x' || s_nationkey, min(s_suppkey), arg_min(s_name, s_suppkey) FROM supplier GROUP BY s_nationkey")
def _(t):
    w = t.raw("supplier")
    new = w.select(F.concat(F.lit("x"), F.col("s_nationkey").cast("string")).alias("network_id"), F.col("s_suppkey").alias("seq"), F.col("s_suppkey").alias("person_id"), F.col("s_name").alias("name"), _NONE().alias("bio"))
    again = w.select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("network_id"), F.col("s_suppkey").alias("seq"), F.lit(-77).cast("long").alias("person_id"), F.col("s_name").alias("name"), _NONE().alias("bio"))
    return C.ensure_owner(t.person, new.unionByName(again)).filter("is_me").select("network_id", "person_id", "name")


@query("l4_vectors_upserted", "SELECT network_id, person_id, round(CASE WHEN person_id % 3 = 0 THEN -CAST(vector[1] AS DOUBLE) ELSE CAST(vector[1] AS DOUBLE) END, 6) AS first FROM emb")
def _(t):
    flip = F.transform("vector", lambda x: -x).cast("array<float>")
    some = t.embedding.filter("person_id % 3 = 0")
    writes = some.withColumn("seq", F.lit(1)).unionByName(some.select("network_id", "person_id", flip.alias("vector"), F.lit(2).alias("seq")))
    return C.upsert_vectors(t.embedding, writes).select("network_id", "person_id", F.col("vector")[0].cast("double").alias("first"))


@query("l4_embedding_worklist", f"SELECT network_id, person_id, {_EMBED} AS text, sha256({_EMBED}) AS text_hash FROM contact WHERE bio <> '' AND person_id % 4 <> 0")
def _(t):
    done = t.person.filter("person_id % 4 < 2").select("network_id", "person_id", F.when(F.col("person_id") % 4 == 0, F.sha2(Q.embed_text(), 256)).otherwise("old").alias("text_hash"))
    return C.embedding_worklist(t.person, done)


_FB = """fb AS (SELECT event_id, 'FB-' || strftime(ts, '%Y%m%d') || '-' || lpad(CAST(row_number() OVER (PARTITION BY strftime(ts, '%Y%m%d') ORDER BY ts, event_id) + 3 * CAST(day(ts) % 2 AS BIGINT) AS VARCHAR), 4, '0') AS ticket_id FROM events WHERE event_type = 'error')"""


def _numbered(t):
    e = t.raw("events").filter("event_type = 'error'")
    used = e.filter(F.dayofmonth("ts") % 2 == 1).select(F.concat(F.lit("FB-"), F.date_format("ts", "yyyyMMdd"), F.lit("-0003")).alias("ticket_id")).distinct()
    return C.number_tickets(e.select("ts", F.struct("ts", "event_id").alias("seq"), "event_id"), used)


@query("f5_ticket_ids", f"WITH {_FB} SELECT event_id, ticket_id FROM fb")
def _(t):
    return _numbered(t).select("event_id", "ticket_id")


@query("l5_ticket_lookup", f"WITH {_FB} SELECT event_id, ticket_id FROM fb WHERE ticket_id IN ('FB-20240101-0005', 'FB-20240102-0001', 'FB-20240103-0001')")
def _(t):
    return C.find_tickets(_numbered(t), ["FB-20240101-0005", "FB-20240102-0001", "FB-20240103-0001"]).select("event_id", "ticket_id")


# ----------------------------------------------------------------------------- validation


def _broken_edges(t):
    k = F.col("edge_id") % 50
    return t.edge.select(
        "network_id", "edge_id", "source_id", F.when(k == 1, F.col("source_id")).when(k == 2, F.lit(-5000).cast("long")).otherwise(F.col("target_id")).alias("target_id"),
        F.when(k == 3, 0).when(k == 4, 9).otherwise(F.col("strength")).alias("strength"), "context", F.when(k == 5, "daily").otherwise(F.col("frequency")).alias("frequency"),
        F.when(k == 6, "guess").otherwise(F.col("source")).alias("source"),
    )


@query("c8_edge_checks", """WITH b AS (SELECT network_id, edge_id, source_id, CASE edge_id % 50 WHEN 1 THEN source_id WHEN 2 THEN -5000 ELSE target_id END AS target_id, edge_id % 50 AS k FROM edge)
  SELECT network_id, CASE k WHEN 1 THEN 'self_loop' WHEN 2 THEN 'missing_target_id' WHEN 5 THEN 'frequency' WHEN 6 THEN 'source' ELSE 'strength' END AS reason, CAST(edge_id AS VARCHAR) AS row_key FROM b WHERE k BETWEEN 1 AND 6
  UNION ALL SELECT network_id, 'duplicate_edge', CAST(max(edge_id) AS VARCHAR) FROM b GROUP BY network_id, source_id, target_id HAVING count(*) > 1""")
def _(t):
    return D.check_edges(_broken_edges(t), t.person)


@query("c8_people_checks", "SELECT network_id, 'owner_count' AS reason, CASE WHEN network_id = 'n3' THEN '0' ELSE '2' END AS row_key FROM me WHERE network_id IN ('n3', 'n4') UNION ALL SELECT network_id, 'duplicate_person', CAST(person_id AS VARCHAR) FROM contact WHERE person_id % 100 = 7 UNION ALL SELECT network_id, 'duplicate_person', CAST(me_id AS VARCHAR) FROM me WHERE network_id = 'n4'")
def _(t):
    p = t.person.filter("not (is_me and network_id = 'n3')")
    twice = t.person.filter("(not is_me and person_id % 100 = 7) or (is_me and network_id = 'n4')")
    return D.check_people(p.unionByName(twice))


@query("c9_feedback_checks", """SELECT event_id, array_to_string(list_filter([CASE WHEN length(title) NOT BETWEEN 10 AND 40 THEN 'title_length' END, CASE WHEN event_id % 7 = 0 THEN 'severity' END, CASE WHEN event_id % 5 = 0 THEN 'involved' END,
    CASE WHEN event_id % 2 = 0 AND event_id % 3 = 0 THEN 'screenshot_needed' END, CASE WHEN event_id % 2 = 0 AND event_id % 11 = 0 THEN 'did' END, CASE WHEN event_id % 2 = 0 AND event_id % 13 = 0 THEN 'history' END,
    CASE WHEN event_id % 2 = 1 AND event_id % 3 = 1 THEN 'user_story' END, CASE WHEN event_id % 2 = 1 AND event_id % 11 = 1 THEN 'acceptance_bullet' END], lambda x: x IS NOT NULL), '|') AS violations
  FROM (SELECT event_id, event_type || ' seen ' || repeat('x', CAST(event_id % 40 AS BIGINT)) AS title FROM events)""")
def _(t):
    k = F.col("event_id")
    bug = k % 2 == 0
    forms = t.raw("events").select(
        k, F.when(bug, "bug").otherwise("feature").alias("type"), F.concat("event_type", F.lit(" seen "), F.repeat(F.lit("x"), (k % 40).cast("int"))).alias("title"),
        F.lit("me").alias("submitter"), F.when(k % 7 == 0, "huge").otherwise("daily").alias("severity"),
        F.when(k % 5 == 0, F.array().cast("array<bigint>")).otherwise(F.array("user_id")).alias("involved"),
        F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("image/png"))).alias("screenshots"),
        F.lit("a").alias("want_to_do"), F.when(k % 11 == 0, "").otherwise("b").alias("did"), F.lit("c").alias("actual"), F.lit("d").alias("expected"),
        F.when(k % 13 == 0, "never").otherwise("new").alias("history"),
        F.when(k % 3 == 1, "please add").when(k % 3 == 0, "当我搜索的时候，我希望快").otherwise("When I search THEN it is fast").alias("user_story"),
        F.when(k % 11 == 1, F.array(F.lit("text"), F.lit("-no space"))).otherwise(F.array(F.lit("text"), F.lit(" 1. works"))).alias("acceptance"),
    )
    return D.check_feedback(forms).select("event_id", "violations")


@query("c10_vector_checks", "SELECT network_id, person_id, CASE WHEN person_id % 10 = 0 THEN 63 ELSE -1 END AS dim FROM emb WHERE person_id % 10 = 0 OR person_id % 25 = 1")
def _(t):
    k = F.col("person_id")
    cut_short = t.embedding.withColumn("vector", F.when(k % 10 == 0, F.slice("vector", 1, 63)).when(k % 25 == 1, F.lit(None)).otherwise(F.col("vector")))
    return D.check_vectors(cut_short, 64)


# ------------------------------------------------------------------------------ plug-ins


@query("n2_embedding_batches", "SELECT network_id, person_id, CAST(length(text) % 97 AS DOUBLE) AS a, 1.0e0 AS b FROM (SELECT network_id, person_id, " + _EMBED + " AS text FROM contact)")
def _(t):
    model = lambda texts: [[float(len(x) % 97), 1.0] for x in texts]
    vectors = U.embed(A.contacts(t.person).select("network_id", "person_id", Q.embed_text().alias("text")), model)
    return vectors.select("network_id", "person_id", F.col("vector")[0].cast("double").alias("a"), F.col("vector")[1].cast("double").alias("b"))


@query("n3_model_answers", "SELECT goal_id, CASE WHEN goal_id % 6 = 0 THEN NULL ELSE '{\"n\": ' || length(original) || '}' END AS raw, CASE WHEN goal_id % 6 = 0 THEN 'no answer' END AS error FROM goal")
def _(t):
    def model(payload: str) -> str:
        number, text = payload.split("|", 1)
        if int(number) % 6 == 0:
            raise RuntimeError("no answer")
        return f'{{"n": {len(text)}}}'

    asked = t.goal.select("goal_id", F.concat_ws("|", F.col("goal_id").cast("string"), "original").alias("payload"))
    return U.answer(asked, model, ["goal_id"])


@query("n1_pair_scores", "SELECT goal_id, cand.person_id, round(length(g.summary) / (length(g.summary) + length(p.name)), 6) AS pair_score FROM cand JOIN goal g USING (goal_id) JOIN contact p ON p.network_id = g.network_id AND p.person_id = cand.person_id")
def _(t):
    from tieweave.operators.retrieval import hybrid_search

    found = hybrid_search(t.goal, t.person, t.embedding).select("goal_id", "network_id", "person_id")
    pairs = found.join(t.goal.select("goal_id", F.col("summary").alias("query")), "goal_id").join(t.person.select("network_id", "person_id", F.col("name").alias("text")), ["network_id", "person_id"])
    return U.score_pairs(pairs, lambda a, b: [len(x) / (len(x) + len(y)) for x, y in zip(a, b)])


# ------------------------------------------------------------------------------- streams


def _fresh(t, name):
    """A work folder of its own for every run of a stream."""
    import uuid

    return work_path(t.spark, "streams", hashlib.sha1(t.sf.encode()).hexdigest()[:12], f"{name}-{uuid.uuid4().hex[:8]}")


@query("m1_edge_stream", EDGE_STATE)
def _(t):
    path = _fresh(t, "edges")
    q = S.edge_stream(edge_changes(t.spark, t.sf, stream=True), f"{path}/state", f"{path}/checkpoint", compact_every=1)
    q.awaitTermination()
    return S.state(t.spark, f"{path}/state", S.fold_edges).drop("seq")


@query("m2_person_stream", PEOPLE_STATE)
def _(t):
    path = _fresh(t, "people")
    S.person_stream(patch_log(t, stream=True).withColumn("name", F.when(F.trim("name") != "", F.col("name"))), f"{path}/state", f"{path}/checkpoint").awaitTermination()
    log = S.state(t.spark, f"{path}/state", S.compact_patches)
    return C.apply_person_patches(_start(t), log).select(*_SHOWN)


@query("m3_scrub_stream", f"SELECT conv_id, turn, {SCRUB.format('text')} AS text FROM conversations")
def _(t):
    path = _fresh(t, "scrub")
    source = raw_stream(t.spark, t.sf, "conversations")
    S.write_scrubbed(source.select("conv_id", "turn", "text"), ["text"], f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{path}/out")


@query("l5_ticket_texts", f"SELECT ticket_id, t.person_id, {SCRUB.format('bio')} AS bio FROM (SELECT event_id AS ticket_id, user_id AS person_id FROM events WHERE event_type = 'error' AND event_id % 10 <> 0) t JOIN contact c USING (person_id)")
def _(t):
    rows = _tickets(t).filter("ticket_id % 10 <> 0").join(t.person.select("network_id", "person_id", "bio"), ["network_id", "person_id"])
    return rows.select("ticket_id", "person_id", X.scrub(F.col("bio")).alias("bio"))
