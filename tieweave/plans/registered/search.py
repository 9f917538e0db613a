"""Retrieval, reranking, paths, goal search and matching."""

from pyspark.sql import functions as F

from tieweave.functions import people as Q
from tieweave.operators import analytics as A, matching as M, paths as P, rerank as R, retrieval as T
from tieweave.operators.folding import both_ways, undirected, with_edge_key
from tieweave.plans import goal_search as G
from tieweave.plans.registered.base import BUCKETS, query


@query("i1_knn_by_network", "SELECT goal_id, network_id, person_id, round(distance, 6) AS distance, rank FROM near")
def _(t):
    return T.nearest_people(t.goal, t.embedding, 60, me=t.me)


_ALL = """SELECT * FROM (SELECT goal_id, a.network_id, person_id, round({d}, 6) AS distance,
  row_number() OVER (PARTITION BY goal_id ORDER BY {d}, person_id) AS rank
  FROM label_goal g JOIN emb_all a ON TRUE) WHERE rank <= 20"""


@query("i1_knn_all_l2", _ALL.format(d="list_distance(CAST(a.vector AS DOUBLE[]), CAST(g.vector AS DOUBLE[]))"))
def _(t):
    return T.nearest_people(t.label_goal, t.embedding_all, 20)


@query("i1_knn_all_cosine", _ALL.format(d="1 - list_cosine_similarity(CAST(a.vector AS DOUBLE[]), CAST(g.vector AS DOUBLE[]))"))
def _(t):
    return T.nearest_people(t.label_goal, t.embedding_all, 20, metric="cosine")


@query("i1_knn_many_goals", _ALL.format(d="list_distance(CAST(a.vector AS DOUBLE[]), CAST(g.vector AS DOUBLE[]))"))
def _(t):
    return T.nearest_people(t.label_goal, t.embedding_all, 20, goals_in_task=0)


@query("e11_keyword_hits", "SELECT goal_id, network_id, channel, person_id, hits FROM hit")
def _(t):
    return T.keyword_hits(t.goal, t.person)


@query("i2_keyword_ranks", "SELECT goal_id, network_id, channel, person_id, hits, row_number() OVER (PARTITION BY goal_id, channel ORDER BY hits DESC, person_id) AS rank FROM hit")
def _(t):
    return T.keyword_ranks(t.goal, t.person)


_D2 = """SELECT DISTINCT network_id, person_id, term FROM (
  SELECT h.network_id, h.person_id, t.term FROM hay h JOIN (SELECT DISTINCT network_id, term FROM term) t ON t.network_id = h.network_id AND contains(h.text, t.term))"""


@query("d2_person_text_terms", _D2)
def _(t):
    from tieweave.operators.substring import contained_terms

    texts = A.contacts(t.person).select("network_id", "person_id", Q.search_haystack().alias("text"))
    return contained_terms(texts, T.goal_terms(t.goal), ["network_id"], ["person_id"])


@query("d2_person_text_terms_by_trigram", _D2)
def _(t):
    from tieweave.operators.substring import contained_terms

    texts = A.contacts(t.person).select("network_id", "person_id", Q.search_haystack().alias("text"))
    return contained_terms(texts, T.goal_terms(t.goal), ["network_id"], ["person_id"], limit=0)


@query("f1_channel_ranks", "SELECT goal_id, network_id, person_id, channel, rank FROM chan")
def _(t):
    near = T.nearest_people(t.goal, t.embedding, 60, me=t.me).withColumn("channel", F.lit("vector"))
    cols = ["goal_id", "network_id", "person_id", "channel", "rank"]
    return T.keyword_ranks(t.goal, t.person).select(*cols).unionByName(near.select(*cols))


@query("i3_rrf_fusion", "SELECT goal_id, network_id, person_id, round(score, 6) AS score, rank FROM cand")
def _(t):
    return T.hybrid_search(t.goal, t.person, t.embedding)


@query("i3_rrf_fusion_weighted", """SELECT goal_id, network_id, person_id, round(raw / max(raw) OVER (PARTITION BY goal_id), 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY goal_id ORDER BY raw DESC, person_id) AS rank FROM (
    SELECT goal_id, network_id, person_id, coalesce(max(CASE WHEN channel = 'vector' THEN 0.5e0 / (60 + rank) END), 0e0) + coalesce(max(CASE WHEN channel = 'topic' THEN 2.0e0 / (60 + rank) END), 0e0) AS raw
    FROM chan WHERE channel <> 'helper' GROUP BY ALL)) WHERE rank <= 30""")
def _(t):
    """Topics before vectors, helper words out of the search."""
    return T.hybrid_search(t.goal, t.person, t.embedding, weights={"vector": 0.5, "helper": 0.0, "topic": 2.0})


def _wild(t):
    """The goals with wildcards in their words: one for any letter i or U, any run for an e or an o."""
    some = lambda c, old, new: F.transform(c, lambda w: F.replace(w, F.lit(old), F.lit(new))).alias(c)
    kept = ["goal_id", "network_id", "original", "summary", "industries", "cities", "vector"]
    return t.goal.select(*kept, some("roles", "U", "_"), some("skills", "i", "_"), some("keywords", "e", "%"))


@query("e11_keyword_hits_wildcards", """WITH wild AS (SELECT goal_id, network_id, 'helper' AS channel, lower(trim(unnest([replace(w, 'U', '_') FOR w IN roles] || industries || [replace(w, 'i', '_') FOR w IN skills]))) AS term FROM goal
    UNION ALL SELECT goal_id, network_id, 'topic', lower(trim(unnest([replace(w, 'e', '%') FOR w IN keywords] || cities))) FROM goal),
  field AS (SELECT network_id, person_id, lower(unnest([name, bio, notes] || tags || skills || companies || cities)) AS value FROM contact),
  found AS (SELECT DISTINCT w.network_id, w.term, f.person_id FROM (SELECT DISTINCT network_id, term FROM wild WHERE term <> '') w JOIN field f ON f.network_id = w.network_id AND f.value LIKE '%' || w.term || '%')
  SELECT goal_id, network_id, channel, person_id, count(*) AS hits FROM wild JOIN found USING (network_id, term) GROUP BY ALL""")
def _(t):
    return T.keyword_hits(_wild(t), t.person, wildcards=True)


@query("f2_max_normalised", "SELECT goal_id, network_id, channel, person_id, round(hits / max(hits) OVER (PARTITION BY goal_id, channel), 6) AS score FROM hit")
def _(t):
    from tieweave.operators.ranking import max_normalise

    hits = T.keyword_hits(t.goal, t.person)
    rows = hits.select("goal_id", "network_id", "channel", "person_id", F.col("hits").cast("double").alias("score"))
    return max_normalise(rows, ["goal_id", "network_id", "channel"], "score")


@query("f7_top_k_per_goal", "SELECT goal_id, network_id, channel, person_id, hits, rank FROM (SELECT *, row_number() OVER (PARTITION BY goal_id, channel ORDER BY hits DESC, person_id) AS rank FROM hit) WHERE rank <= 5")
def _(t):
    from tieweave.operators.ranking import top_k

    return top_k(T.keyword_hits(t.goal, t.person), ["goal_id", "network_id", "channel"], [F.col("hits").desc(), F.col("person_id")], 5)


@query("g6_recall_width", """SELECT goal_id, network_id, count(*) AS vector_rows, (SELECT max(c) FROM (SELECT count(*) AS c FROM cand GROUP BY goal_id)) AS recalled
  FROM near GROUP BY ALL""")
def _(t):
    near = T.nearest_people(t.goal, t.embedding, 60, me=t.me).groupBy("goal_id", "network_id").agg(F.count(F.lit(1)).alias("vector_rows"))
    widest = T.hybrid_search(t.goal, t.person, t.embedding).groupBy("goal_id").agg(F.count(F.lit(1)).alias("c")).agg(F.max("c").alias("recalled"))
    # One row of one number: the widest candidate list.
    return near.withColumn("recalled", F.lit(widest.first()["recalled"]))


# ------------------------------------------------------------------------------- rerank

_VERDICT_SQL = """
  role_of AS (SELECT *, CASE WHEN person_id % 4 = 3 THEN NULL ELSE ['本人','桥梁','无关','?'][CAST(person_id % 4 + 1 AS BIGINT)] END AS role,
                (person_id % 10) / 10.0e0 AS verdict FROM cand),
  judged AS (SELECT *, CASE WHEN goal_id % 5 = 0 THEN NULL WHEN role IS NULL THEN score * 0.05e0
                ELSE (CASE role WHEN '本人' THEN 1.0e0 WHEN '桥梁' THEN 0.5e0 ELSE 0.05e0 END) * verdict END AS new FROM role_of),
  done AS (SELECT goal_id FROM judged WHERE goal_id % 5 <> 0 AND role IS NOT NULL GROUP BY 1),
  rescored AS (SELECT goal_id, network_id, person_id, score AS old, rank AS old_rank,
                CASE WHEN goal_id IN (FROM done) THEN new END AS new FROM judged)"""


def _responses(candidates):
    """Judge answers made from the candidates: some unknown roles, some broken answers."""
    role = F.element_at(F.array(F.lit("本人"), F.lit("桥梁"), F.lit("无关")), (F.col("person_id") % 4 + 1).cast("int"))
    known = R.head_tokens(candidates).filter("person_id % 4 <> 3")
    entry = F.struct(F.col("token").alias("id"), role.alias("role"), ((F.col("person_id") % 10) / 10).alias("score"))
    answers = known.groupBy("goal_id").agg(F.to_json(F.struct(F.collect_list(entry).alias("ranking"))).alias("raw"))
    return answers.withColumn("raw", F.when(F.col("goal_id") % 5 == 0, F.lit('{"ranking": broken')).otherwise(F.col("raw")))


@query("i4a_identity", "SELECT goal_id, network_id, person_id, round(score, 6) AS score, rank FROM cand")
def _(t):
    return R.identity(T.hybrid_search(t.goal, t.person, t.embedding))


@query("i4b_judge_blend", "WITH " + _VERDICT_SQL + """
  SELECT goal_id, network_id, person_id,
         round(coalesce(new / CASE WHEN max(new) OVER w = 0 THEN 1 ELSE max(new) OVER w END, old), 6) AS score,
         row_number() OVER (PARTITION BY goal_id ORDER BY new DESC NULLS LAST, CASE WHEN new IS NULL THEN old_rank ELSE 0 END, old DESC, person_id) AS rank
  FROM rescored WINDOW w AS (PARTITION BY goal_id)""")
def _(t):
    from tieweave.session import cut

    found = cut(T.hybrid_search(t.goal, t.person, t.embedding))
    return R.judge(found, _responses(found))


@query("d11_verdict_join", "WITH " + _VERDICT_SQL + """
  SELECT goal_id, person_id, coalesce(role, '无关') AS role, round(CASE WHEN role IS NULL THEN NULL ELSE verdict END, 6) AS verdict FROM role_of WHERE goal_id % 5 <> 0""")
def _(t):
    from tieweave.session import cut

    found = cut(T.hybrid_search(t.goal, t.person, t.embedding))
    verdicts = R.parse_verdicts(_responses(found))
    return R.head_tokens(found).filter("goal_id % 5 <> 0").join(verdicts, ["goal_id", "token"], "left").select(
        "goal_id", "person_id", F.coalesce("role", F.lit("无关")).alias("role"), "verdict"
    )


@query("i4c_pair_score_blend", """SELECT goal_id, network_id, person_id,
  round(s / max(s) OVER (PARTITION BY goal_id), 6) AS score, row_number() OVER (PARTITION BY goal_id ORDER BY s DESC, score DESC, person_id) AS rank
  FROM (SELECT *, (person_id * 37 % 101 + 1) / 101.0e0 AS s FROM cand) WHERE person_id % 7 <> 0""")
def _(t):
    from tieweave.session import cut

    found = cut(T.hybrid_search(t.goal, t.person, t.embedding))
    scores = found.filter("person_id % 7 <> 0").select(
        "goal_id", "person_id", ((F.col("person_id") * 37 % 101 + 1) / 101).alias("pair_score")
    )
    return R.pair_scores(found, scores)


# -------------------------------------------------------------------------------- paths

_FOREST_COLS = "network_id, person_id, hops, array_to_string(path, '|') AS path, array_to_string(strengths, '|') AS strengths, path_strength, kind"


@query("i5_weighted_graph", """--forest 3 4
SELECT network_id, from_id AS low_id, to_id AS high_id, strength, cost FROM leg WHERE from_id < to_id""")
def _(t):
    return P.weighted_graph(t.edge, t.me).select("network_id", "low_id", "high_id", "strength", "cost")


@query("i6_path_forest", f"--forest 3 4\nSELECT {_FOREST_COLS} FROM forest")
def _(t):
    return P.path_forest(t.edge, t.me)


@query("i6_path_forest_two_hops", f"--forest 2 4\nSELECT {_FOREST_COLS} FROM forest")
def _(t):
    return P.path_forest(t.edge, t.me, max_hops=2)


@query("i6_company_forest", f"--forest 3 4 hop_colleagues\nSELECT {_FOREST_COLS} FROM forest")
def _(t):
    """Colleagues meet through their company; the SQL spells out an edge for every pair of them."""
    return P.path_forest(t.edge, t.me, people=t.person, over_companies=True)


@query("i7_path_kinds", "--forest 3 2\nSELECT network_id, kind, hops, count(*) AS n FROM forest GROUP BY ALL")
def _(t):
    return t.forest(3, 2).groupBy("network_id", "kind", "hops").agg(F.count(F.lit(1)).alias("n"))


def _ranked(t, top=10):
    return G.ranked_results(R.cut_to(T.hybrid_search(t.goal, t.person, t.embedding), top), t.forest(), t.person)


@query("i8_combined_score", "--forest 3 4\nSELECT goal_id, network_id, person_id, hops, path_strength, kind, round(combined, 6) AS combined FROM ranked")
def _(t):
    return _ranked(t).select("goal_id", "network_id", "person_id", "hops", "path_strength", "kind", "combined")


@query("g1_result_order", "--forest 3 4\nSELECT goal_id, person_id, round(combined, 6) AS combined, row_number() OVER (PARTITION BY goal_id ORDER BY combined DESC, person_id) AS place FROM ranked")
def _(t):
    from tieweave.operators.ranking import top_k

    order = [F.col("combined").desc(), F.col("person_id")]
    return top_k(_ranked(t), ["goal_id", "network_id"], order, 10, "place").select("goal_id", "person_id", "combined", "place")


@query("b13_rationale", """--forest 3 4
SELECT goal_id, person_id, 'kind=' || kind || ', relevance=' || format('{:.2f}', score) || ', hops=' || hops || ', path_strength=' || path_strength ||
  CASE WHEN attrs = '' THEN '' ELSE ' [' || attrs || ']' END AS rationale
FROM (SELECT *, concat_ws(', ', CASE WHEN len(tags) > 0 THEN 'tags=' || array_to_string(tags[1:3], '/') END,
  CASE WHEN len(skills) > 0 THEN 'skills=' || array_to_string(skills[1:3], '/') END,
  CASE WHEN len(companies) > 0 THEN 'at=' || array_to_string(companies[1:2], '/') END) AS attrs FROM ranked)""")
def _(t):
    return _ranked(t).select("goal_id", "person_id", "rationale")


@query("g3_search_buckets", f"--forest 3 4\nWITH {BUCKETS} SELECT goal_id, bucket, place, person_id, kind, round(combined, 6) AS combined FROM buckets")
def _(t):
    return G.buckets(_ranked(t)).select("goal_id", "bucket", "place", "person_id", "kind", "combined")


@query("i9_goal_search", f"""--forest 3 4
WITH {BUCKETS} SELECT b.goal_id, b.network_id, bucket, place, b.person_id, b.name, round(score, 6) AS score, hops, array_to_string(path, '|') AS path,
  path_strength, kind, round(combined, 6) AS combined, CASE WHEN kind = 'indirect' AND bucket IN ('indirect', 'combined') THEN strength_to_me END AS direct_strength
FROM buckets b LEFT JOIN s2me s USING (network_id, person_id)""")
def _(t):
    rows = G.goal_search(t.goal, t.person, t.edge, t.embedding, forest=t.forest())
    return rows.select("goal_id", "network_id", "bucket", "place", "person_id", "name", "score", "hops", "path",
                       "path_strength", "kind", "combined", "direct_strength")


@query("h4_bucket_union", f"--forest 3 4\nWITH {BUCKETS} SELECT DISTINCT goal_id, person_id FROM buckets WHERE bucket IN ('indirect', 'contacted')")
def _(t):
    rows = G.buckets(_ranked(t)).filter(F.col("bucket").isin("indirect", "contacted"))
    return rows.select("goal_id", "person_id").distinct()


@query("i10_direct_instead", f"""--forest 3 4
WITH {BUCKETS} SELECT b.goal_id, b.network_id, b.person_id, path[1] || '|' || b.person_id AS path, CAST(strength_to_me AS VARCHAR) AS strengths,
  '直连：你与 ' || b.name || ' 关系强度 ' || strength_to_me || '/5，可直接联系。' AS rationale
FROM buckets b JOIN s2me s USING (network_id, person_id) WHERE bucket = 'indirect'""")
def _(t):
    rows = G.goal_search(t.goal, t.person, t.edge, t.embedding, forest=t.forest())
    return P.direct_instead(rows.filter("bucket = 'indirect'"))


_NAMED = """named AS (SELECT network_id, person_id, list(name ORDER BY pos) AS names, list(context ORDER BY pos) FILTER (WHERE context IS NOT NULL AND context <> '') AS contexts FROM (
  SELECT f.network_id, f.person_id, i AS pos, p.name, q.context FROM (SELECT *, unnest(generate_series(1, len(path))) AS i FROM forest) f
  JOIN person p ON p.network_id = f.network_id AND p.person_id = f.path[i]
  LEFT JOIN pair q ON i > 1 AND q.network_id = f.network_id AND q.low_id = least(f.path[i], f.path[i - 1]) AND q.high_id = greatest(f.path[i], f.path[i - 1])) GROUP BY ALL)"""


def _told(t):
    pairs = undirected(t.edge)
    return P.describe_paths(t.forest(), t.person, pairs, ["network_id", "person_id"])


@query("b14_path_narration", f"""--forest 3 4
WITH {_NAMED} SELECT network_id, person_id, CASE len(names) WHEN 2 THEN '下一步：直接联系 ' || names[-1] || '。'
  WHEN 3 THEN '下一步：找 ' || names[2] || '，请他引荐 ' || names[-1] || '。'
  ELSE '下一步：从 ' || names[2] || ' 起，沿 ' || array_to_string(names[2:len(names) - 1], ' → ') || ' 链路引荐到 ' || names[-1] || '。' END AS next_step,
  CASE len(names) WHEN 2 THEN names[1] || ' 与 ' || names[-1] || ' 直接相识，可一步打通。'
  WHEN 3 THEN '请 ' || names[2] || ' 居间引荐 ' || names[1] || ' ↔ ' || names[-1] || '。'
  ELSE '沿 ' || array_to_string(names[2:len(names) - 1], ' → ') || ' 链路居间引荐 ' || names[1] || ' ↔ ' || names[-1] || '。' END AS between_two,
  array_to_string(contexts, ' · ') AS context_line FROM named""")
def _(t):
    return _told(t).select(
        "network_id", "person_id", Q.next_step(F.col("names")).alias("next_step"),
        Q.next_step(F.col("names"), between_two=True).alias("between_two"),
        Q.context_line(F.col("contexts"), F.lit("")).alias("context_line"),
    )


@query("e17_highlights", f"""--forest 3 4
WITH {BUCKETS}, shown AS (SELECT * FROM buckets WHERE bucket = 'combined')
SELECT DISTINCT goal_id, network_id, 'node' AS kind, CAST(unnest(path) AS VARCHAR) AS element FROM shown
UNION ALL SELECT DISTINCT goal_id, network_id, 'edge', 'e_' || least(path[i], path[i + 1]) || '_' || greatest(path[i], path[i + 1])
FROM (SELECT *, unnest(generate_series(1, len(path) - 1)) AS i FROM shown)""")
def _(t):
    return P.highlights(G.buckets(_ranked(t)).filter("bucket = 'combined'"))


# ------------------------------------------------------------------- two-person requests


def _requests(t):
    """The customers of every two successive orders, where one network has both, and of such an order each with the owner."""
    o = t.raw("orders").select("o_orderkey", "o_custkey").join(t.raw("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    later = o.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("o_custkey").alias("target_id"), "c_nationkey")
    network = F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("network_id")
    both = o.join(later, ["o_orderkey", "c_nationkey"]).select(F.col("o_orderkey").alias("request_id"), network, F.col("o_custkey").alias("source_id"), "target_id")
    mine = both.join(t.me, "network_id").select((-F.col("request_id") - 1).alias("request_id"), "network_id", F.col("me_id").alias("source_id"), "target_id")
    return both.unionByName(mine)


_REQ = """ends AS (SELECT a.o_orderkey AS request_id, 'n' || x.c_nationkey AS network_id, a.o_custkey AS source_id, b.o_custkey AS target_id
    FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1 JOIN customer x ON x.c_custkey = a.o_custkey JOIN customer y ON y.c_custkey = b.o_custkey AND y.c_nationkey = x.c_nationkey),
  req AS (SELECT * FROM ends WHERE source_id <> target_id
          UNION ALL SELECT -request_id - 1, e.network_id, me_id, target_id FROM ends e JOIN me USING (network_id))"""
_BETWEEN = """walk(request_id, network_id, target_id, path, total) AS (
    SELECT request_id, network_id, target_id, [source_id], CAST(0 AS BIGINT) FROM req
    UNION ALL SELECT w.request_id, w.network_id, w.target_id, list_append(path, to_id), total + strength FROM walk w
    JOIN hop h ON h.network_id = w.network_id AND h.from_id = w.path[-1]
    WHERE len(path) <= 3 AND w.path[-1] <> w.target_id AND NOT list_contains(path, to_id)),
  reached AS (SELECT *, total / (len(path) - 1) AS combined FROM walk WHERE path[-1] = target_id)
  SELECT request_id, network_id, array_to_string(path, '|') AS path, total, len(path) - 1 AS hops, round(combined, 6) AS combined, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY combined DESC, len(path), path) AS rank FROM reached) WHERE rank <= 5"""


@query("i11_paths_between", f"WITH {_REQ}, {_BETWEEN}")
def _(t):
    return P.paths_between(_requests(t), t.edge)


_TYPED = """typed AS (SELECT c_custkey AS request_id, 'n' || c_nationkey AS network_id, upper(c_name) AS start_typed, 'NATION_1' AS end_typed FROM customer),
  both_ends AS (SELECT request_id, network_id, 'source_id' AS side, lower(trim(start_typed)) AS term FROM typed UNION ALL SELECT request_id, network_id, 'target_id', lower(trim(end_typed)) FROM typed),
  picked AS (SELECT request_id, b.network_id, side, arg_min(person_id, {l: lower(name) <> term, m: NOT is_me, n: name, p: person_id}) AS person_id,
             count(*) FILTER (lower(name) = term) > 1 AS amb FROM both_ends b JOIN person p ON p.network_id = b.network_id AND contains(lower(p.name), term) GROUP BY ALL)"""


@query("c12_resolve_endpoints", f"""WITH {_TYPED} SELECT s.request_id, s.network_id, s.person_id AS source_id, s.amb AS source_id_ambiguous, e.person_id AS target_id, e.amb AS target_id_ambiguous
  FROM picked s JOIN picked e ON s.request_id = e.request_id AND s.side = 'source_id' AND e.side = 'target_id' WHERE s.person_id <> e.person_id""")
def _(t):
    asked = t.raw("customer").select(
        F.col("c_custkey").alias("request_id"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("network_id"),
        F.upper("c_name").alias("start_typed"), F.lit("NATION_1").alias("end_typed"),
    )
    return P.resolve_endpoints(asked, t.person)


# ----------------------------------------------------------------------------- matching

_WANTS = """wants AS (SELECT DISTINCT network_id, person_id, name, lower(unnest(needs)) AS need FROM contact),
  offers AS (SELECT DISTINCT network_id, person_id, name, lower(unnest(tags || skills || companies)) AS offer FROM contact),
  fits AS (SELECT DISTINCT w.network_id, w.need, o.offer FROM (SELECT DISTINCT network_id, need FROM wants) w
           JOIN (SELECT DISTINCT network_id, offer FROM offers) o ON o.network_id = w.network_id AND (contains(o.offer, w.need) OR contains(w.need, o.offer))),
  told AS (SELECT c.network_id, c.person_id, c.name, w.need FROM contact c JOIN (SELECT DISTINCT network_id, need FROM wants) w ON w.network_id = c.network_id AND contains(lower(c.bio), w.need))"""


@query("d5_needs_offers", f"""WITH {_WANTS}, n AS (SELECT network_id, need, count(*) AS seekers FROM wants GROUP BY ALL)
  SELECT n.network_id, n.need, 'attribute' AS via, f.offer, p.providers, n.seekers FROM fits f JOIN n USING (network_id, need)
  JOIN (SELECT network_id, offer, count(*) AS providers FROM offers GROUP BY ALL) p USING (network_id, offer)
  UNION ALL SELECT n.network_id, n.need, 'bio', n.need, count(*), n.seekers FROM told t JOIN n USING (network_id, need) GROUP BY ALL""")
def _(t):
    return M.match_table(t.person)


_INTROS = """hits AS (SELECT f.network_id, f.need, o.person_id, o.name, 0 AS via, f.offer AS keyword FROM fits f JOIN offers o USING (network_id, offer)
     UNION ALL SELECT network_id, need, person_id, name, 1, need FROM told),
  matched AS (SELECT w.network_id, w.person_id AS seeker_id, w.name AS seeker, h.person_id AS provider_id, h.name AS provider,
     min({n: w.need, v: h.via, k: h.keyword}) AS m FROM wants w JOIN hits h ON h.network_id = w.network_id AND h.need = w.need AND h.person_id <> w.person_id GROUP BY ALL),
  intro AS (SELECT network_id, seeker_id, seeker, provider_id, provider, m.n AS need, m.k AS keyword,
     seeker || ' 需要「' || m.n || '」，' || provider || ' 在「' || m.k || '」上对得上' AS why, row_number() OVER (PARTITION BY network_id ORDER BY seeker, seeker_id, provider, provider_id) AS place FROM matched)"""


@query("i12_introductions", f"WITH {_WANTS}, {_INTROS} SELECT * FROM intro WHERE place <= 50")
def _(t):
    return M.introductions(t.person)


@query("g4_introductions_cap", f"WITH {_WANTS}, {_INTROS} SELECT network_id, count(*) AS shown, max(place) AS last_place FROM intro WHERE place <= 10 GROUP BY ALL")
def _(t):
    return M.introductions(t.person, limit=10).groupBy("network_id").agg(F.count(F.lit(1)).alias("shown"), F.max("place").alias("last_place"))


@query("i13_brokered_paths", f"""WITH {_WANTS}, {_INTROS} SELECT i.network_id, seeker_id, provider_id, provider_id || '|' || me_id || '|' || seeker_id AS path,
  '你直接认识|匹配「' || keyword || '」' AS contexts, '由你居间引荐 ' || provider || ' ↔ ' || seeker || '（匹配「' || keyword || '」）。' AS next_step, why AS rationale
  FROM intro i JOIN me USING (network_id) WHERE place <= 50""")
def _(t):
    return M.brokered_paths(M.introductions(t.person), t.person)


@query("e4_undirected", "SELECT network_id, low_id, high_id, edge_id, strength, context, frequency FROM pair")
def _(t):
    return undirected(t.edge).select("network_id", "low_id", "high_id", "edge_id", "strength", "context", "frequency")


@query("b17_edge_keys", "SELECT network_id, 'e_' || low_id || '_' || high_id AS edge_key, low_id, high_id FROM pair")
def _(t):
    return with_edge_key(undirected(t.edge)).select("network_id", "edge_key", "low_id", "high_id")


@query("e4_both_ways", "SELECT network_id, from_id, to_id, strength FROM hop")
def _(t):
    return both_ways(undirected(t.edge)).select("network_id", "from_id", "to_id", "strength")
