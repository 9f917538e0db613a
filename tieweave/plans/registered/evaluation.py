"""Retrieval evaluation and diagnosis."""

from pyspark.sql import Window, functions as F

from tieweave.operators import analytics as A, evaluation as V, retrieval as T
from tieweave.plans.registered.base import query
from tieweave.session import cut


def golden(t):
    """Expected: vectors of the query's label. Forbidden: those of the next label."""
    items = t.raw("embeddings").select(F.col("vec_id").alias("item"), F.col("label").cast("long").alias("label"))
    q = t.label_goal.select(F.col("goal_id").alias("query_id"), "vec_id")
    expected = items.join(q, F.col("label") == F.col("query_id")).filter("item <> vec_id").select("query_id", F.lit("expected").alias("kind"), "item")
    # Labels are a stated set; the first one follows the last.
    ring = Window.orderBy("goal_id")
    turn = t.label_goal.select(F.col("goal_id").alias("label"), F.coalesce(F.lag("goal_id").over(ring), F.max("goal_id").over(Window.partitionBy())).alias("query_id"))
    wrong = items.join(turn, "label").select("query_id", F.lit("forbidden").alias("kind"), "item")
    return expected.unionByName(wrong)


def queries(t):
    cats = F.array(*[F.lit(c) for c in ("role-cliff", "ambiguous", "longtail", "one-hop", "other")])
    return t.label_goal.select(
        F.col("goal_id").alias("query_id"), F.element_at(cats, (F.col("goal_id") % 5 + 1).cast("int")).alias("category"),
        F.concat(F.lit("n"), F.col("goal_id").cast("string")).alias("network_id"),
    )


def retrieved(t):
    """Two variants: by distance, and by cosine, each without the query vector itself."""
    out = None
    for name, metric in (("l2", "l2"), ("cosine", "cosine")):
        rows = T.nearest_people(t.label_goal, t.embedding_all, 21, metric=metric)
        own = t.label_goal.select("goal_id", F.col("vec_id").alias("person_id"))
        rows = rows.join(own, ["goal_id", "person_id"], "left_anti")
        from tieweave.operators.ranking import top_k

        rows = top_k(rows.drop("rank"), ["goal_id"], [F.col("distance"), F.col("person_id")], 20)
        rows = rows.select(F.lit(name).alias("variant"), F.col("goal_id").alias("query_id"), F.col("person_id").alias("item"), "rank")
        out = rows if out is None else out.unionByName(rows)
    return out


_D = {
    "l2": "list_distance(CAST(a.vector AS DOUBLE[]), CAST(g.vector AS DOUBLE[]))",
    "cosine": "1 - list_cosine_similarity(CAST(a.vector AS DOUBLE[]), CAST(g.vector AS DOUBLE[]))",
}
_RET = " UNION ALL ".join(
    f"SELECT * FROM (SELECT '{n}' AS variant, goal_id AS query_id, person_id AS item, row_number() OVER (PARTITION BY goal_id ORDER BY {d}, person_id) AS rank FROM label_goal g JOIN emb_all a ON person_id <> g.vec_id) WHERE rank <= 20"
    for n, d in _D.items()
)
_EVAL = f"""ret AS ({_RET}),
  turn AS (SELECT goal_id AS label, coalesce(lag(goal_id) OVER (ORDER BY goal_id), max(goal_id) OVER ()) AS earlier FROM label_goal),
  gold AS (SELECT goal_id AS query_id, 'expected' AS kind, e.vec_id AS item FROM embeddings e JOIN label_goal g ON e.label = g.goal_id WHERE e.vec_id <> g.vec_id
    UNION ALL SELECT earlier, 'forbidden', e.vec_id FROM embeddings e JOIN turn ON turn.label = e.label),
  qs AS (SELECT goal_id AS query_id, (['role-cliff','ambiguous','longtail','one-hop','other'])[goal_id % 5 + 1] AS category, 'n' || goal_id AS network_id FROM label_goal),
  sc AS (SELECT r.variant, r.query_id, category, count(*) FILTER (kind = 'expected' AND rank <= 5) / any_value(n) AS recall,
     coalesce(1.0e0 / min(rank) FILTER (kind = 'expected' AND rank <= {{depth}}), 0e0) AS mrr,
     coalesce(sum(1.0e0 / log2(rank + 1)) FILTER (kind = 'expected' AND rank <= least(10, {{depth}})), 0e0) / (SELECT sum(1.0e0 / log2(i + 1)) FROM generate_series(1, 10) t(i)) AS ndcg,
     coalesce(bool_or(kind = 'forbidden' AND rank <= 5), FALSE) AS cliff_hit
   FROM ret r JOIN qs USING (query_id) JOIN (SELECT query_id, count(*) AS n FROM gold WHERE kind = 'expected' GROUP BY 1) w USING (query_id)
   LEFT JOIN gold g ON g.query_id = r.query_id AND g.item = r.item GROUP BY ALL)""".replace("FILTER (kind", "FILTER (WHERE kind")


def _scores(t, depth=10):
    return V.score_queries(retrieved(t), golden(t), queries(t), depth=depth)


@query("k1_recall", "WITH " + _EVAL.format(depth=10) + " SELECT variant, query_id, round(recall, 6) AS recall FROM sc")
def _(t):
    return _scores(t).select("variant", "query_id", "recall")


@query("k2_mrr", "WITH " + _EVAL.format(depth=10) + " SELECT variant, query_id, round(mrr, 6) AS mrr FROM sc")
def _(t):
    return _scores(t).select("variant", "query_id", "mrr")


@query("k3_ndcg", "WITH " + _EVAL.format(depth=10) + " SELECT variant, query_id, round(ndcg, 6) AS ndcg FROM sc")
def _(t):
    return _scores(t).select("variant", "query_id", "ndcg")


@query("k3_ndcg_on_five_results", "WITH " + _EVAL.format(depth=5) + " SELECT variant, query_id, round(ndcg, 6) AS ndcg FROM sc")
def _(t):
    return _scores(t, depth=5).select("variant", "query_id", "ndcg")


@query("k4_cliffs", "WITH " + _EVAL.format(depth=10) + " SELECT variant, query_id, category, cliff_hit FROM sc")
def _(t):
    return _scores(t).select("variant", "query_id", "category", "cliff_hit")


@query("e15_metric_averages", "WITH " + _EVAL.format(depth=10) + """ SELECT variant, category, count(*) AS n, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg,
  round(1 - count(*) FILTER (WHERE cliff_hit) / count(*), 6) AS cliff_avoidance FROM sc GROUP BY GROUPING SETS ((variant), (variant, category))""")
def _(t):
    return V.summarise(_scores(t))


@query("k5_variant_comparison", "WITH " + _EVAL.format(depth=10) + """ SELECT query_id, category, round(max(recall) FILTER (WHERE variant = 'l2'), 6) AS l2_recall, round(max(mrr) FILTER (WHERE variant = 'l2'), 6) AS l2_mrr,
  round(max(ndcg) FILTER (WHERE variant = 'l2'), 6) AS l2_ndcg, bool_or(cliff_hit) FILTER (WHERE variant = 'l2') AS l2_cliff, round(max(recall) FILTER (WHERE variant = 'cosine'), 6) AS cosine_recall,
  round(max(mrr) FILTER (WHERE variant = 'cosine'), 6) AS cosine_mrr, round(max(ndcg) FILTER (WHERE variant = 'cosine'), 6) AS cosine_ndcg, bool_or(cliff_hit) FILTER (WHERE variant = 'cosine') AS cosine_cliff FROM sc GROUP BY ALL""")
def _(t):
    return V.compare_variants(_scores(t), ["l2", "cosine"])


@query("h3_overlaps", "WITH " + _EVAL.format(depth=10) + " SELECT variant, query_id, kind, item, rank FROM ret JOIN gold USING (query_id, item)")
def _(t):
    return V.overlaps(retrieved(t), golden(t))


@query("e16_golden_counts", "WITH " + _EVAL.format(depth=10) + " SELECT category, network_id, count(*) AS n FROM qs GROUP BY GROUPING SETS ((category), (network_id))")
def _(t):
    return V.golden_counts(queries(t))


@query("c11_golden_checks", "WITH " + _EVAL.format(depth=10) + """ SELECT query_id, 'category' AS reason, category AS value FROM qs WHERE category = 'other'
  UNION ALL SELECT query_id, kind || '_name', 'Customer#' || lpad(CAST(item AS VARCHAR), 9, '0') FROM gold JOIN qs USING (query_id)
  WHERE NOT EXISTS (FROM contact c WHERE c.network_id = qs.network_id AND c.name = 'Customer#' || lpad(CAST(item AS VARCHAR), 9, '0'))""")
def _(t):
    from tieweave.operators.validation import check_golden

    named = golden(t).withColumn("item", F.concat(F.lit("Customer#"), F.lpad(F.col("item").cast("string"), 9, "0")))
    return check_golden(queries(t), named.join(queries(t).select("query_id", "network_id"), "query_id"), t.person)


_DIAG = """ex AS (SELECT g.goal_id, g.network_id, c.name FROM goal g JOIN (SELECT network_id, name, person_id FROM contact) c USING (network_id)
     UNION ALL SELECT goal_id, network_id, 'Nobody' FROM goal),
  dg AS (SELECT ex.*, min(c.person_id) AS person_id, any_value(c.bio) AS bio FROM ex LEFT JOIN contact c ON c.network_id = ex.network_id AND c.name = ex.name GROUP BY ex.goal_id, ex.network_id, ex.name),
  rk AS (SELECT goal_id, channel, person_id, hits, row_number() OVER (PARTITION BY goal_id, channel ORDER BY hits DESC, person_id) AS rank FROM hit)"""


@query("k6_channel_diagnosis", f"""WITH {_DIAG} SELECT d.goal_id, d.network_id, d.name, d.person_id, d.person_id IS NOT NULL AS in_network, substring(CASE WHEN d.person_id IS NOT NULL THEN coalesce(bio, '') END, 1, 120) AS bio, n.rank AS vector_rank,
  round(n.distance, 6) AS distance, h.rank AS helper_rank, h.hits AS helper_hits, t.rank AS topic_rank, t.hits AS topic_hits
  FROM dg d LEFT JOIN near n ON n.goal_id = d.goal_id AND n.person_id = d.person_id LEFT JOIN rk h ON h.goal_id = d.goal_id AND h.person_id = d.person_id AND h.channel = 'helper'
  LEFT JOIN rk t ON t.goal_id = d.goal_id AND t.person_id = d.person_id AND t.channel = 'topic'""")
def _(t):
    return V.diagnose(_expected(t), t.person, T.nearest_people(t.goal, t.embedding, 60, me=t.me), T.keyword_ranks(t.goal, t.person))


def _expected(t):
    names = A.contacts(t.person).select("network_id", "name")
    ids = t.goal.select("goal_id", "network_id")
    return ids.join(names, "network_id").unionByName(ids.withColumn("name", F.lit("Nobody")))


@query("d12_expected_by_channel", f"""WITH {_DIAG} SELECT channel, count(*) AS expected, count(found) AS found, CAST(sum(found) AS BIGINT) AS rank_sum FROM (
   SELECT 'vector' AS channel, n.rank AS found FROM dg d LEFT JOIN near n ON n.goal_id = d.goal_id AND n.person_id = d.person_id
   UNION ALL SELECT c, r.rank FROM dg d, (SELECT unnest(['helper', 'topic']) AS c) LEFT JOIN rk r ON r.goal_id = d.goal_id AND r.person_id = d.person_id AND r.channel = c) GROUP BY 1""")
def _(t):
    rows = V.diagnose(_expected(t), t.person, T.nearest_people(t.goal, t.embedding, 60, me=t.me), T.keyword_ranks(t.goal, t.person))
    each = F.array(*[F.struct(F.lit(c).alias("channel"), F.col(f"{c}_rank").alias("r")) for c in ("vector", "helper", "topic")])
    return rows.select(F.explode(each).alias("x")).groupBy("x.channel").agg(
        F.count(F.lit(1)).alias("expected"), F.count("x.r").alias("found"), F.sum("x.r").alias("rank_sum")
    )


@query("a10_golden_file", "WITH " + _EVAL.format(depth=10) + " SELECT CAST(query_id AS VARCHAR) AS query_id, category, network_id, kind, CAST(item AS VARCHAR) AS item FROM gold JOIN qs USING (query_id)")
def _(t):
    from tieweave.plans.registered.building import _round_trip
    from tieweave.sources.contacts import read_golden

    g = golden(t).withColumn("item", F.col("item").cast("string"))
    # A golden query lists few names; here it is one list per query and slice of ids.
    rows = g.withColumn("slice", F.pmod(F.hash("item"), F.lit(16))).groupBy("query_id", "slice").agg(
        F.collect_list(F.when(F.col("kind") == "expected", F.col("item"))).alias("expected_top3"),
        F.collect_list(F.when(F.col("kind") == "forbidden", F.col("item"))).alias("must_not_include"),
    )
    out = rows.join(queries(t), "query_id").select(
        F.col("query_id").cast("string").alias("id"), "category", F.col("network_id").alias("owner"), F.lit("find").alias("goal"), "expected_top3", "must_not_include"
    )
    return read_golden(t.spark, _round_trip(t, "golden", out, "json")).drop("goal")


@query("a11_report_file", "WITH " + _EVAL.format(depth=10) + " SELECT variant, category, count(*) AS n, round(avg(recall), 6) AS recall FROM sc GROUP BY GROUPING SETS ((variant), (variant, category))")
def _(t):
    import hashlib

    from tieweave.session import work_path
    from tieweave.sources.sinks import write_report

    path = work_path(t.spark, "export", hashlib.sha1(t.sf.encode()).hexdigest()[:12], "report")
    scores = cut(_scores(t))
    write_report(V.summarise(scores), scores, path)
    return t.spark.read.schema("variant string, category string, n long, recall double").json(f"{path}/summary")
