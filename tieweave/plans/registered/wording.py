"""Personal data, pseudonyms, model requests and answers, aliases."""

from pyspark.sql import functions as F

from tieweave.functions import people as Q
from tieweave.functions import text as X
from tieweave.functions import values as V
from tieweave.operators import aliases as L, analytics as A, enrichment as E, pseudonyms as N, retrieval as T
from tieweave.plans.registered.base import query
from tieweave.plans.registered.building import _EMBED
from tieweave.plans.registered.network import SCRUB
from tieweave.session import cut
from tieweave.sources.contacts import parse_alias_rules, read_alias_rules

_P = """ptok AS (SELECT network_id, person_id, name, 'P' || lpad(CAST(row_number() OVER (PARTITION BY network_id ORDER BY name, person_id) AS VARCHAR), 3, '0') AS token FROM contact
    UNION ALL SELECT network_id, me_id, me_name, 'P000' FROM me),
  ctok AS (SELECT network_id, name, 'C' || lpad(CAST(row_number() OVER (PARTITION BY network_id ORDER BY length(name) DESC, name) AS VARCHAR), 3, '0') AS token
    FROM (SELECT DISTINCT network_id, trim(unnest(companies)) AS name FROM contact) WHERE name <> '')"""


@query("b16_scrubbed_documents", f"SELECT doc_id, {SCRUB.format('text')} AS text FROM documents")
def _(t):
    return t.raw("documents").select("doc_id", X.scrub(F.col("text")).alias("text"))


@query("b16_scrubbed_conversations", f"SELECT conv_id, turn, {SCRUB.format('text')} AS text FROM conversations")
def _(t):
    return t.raw("conversations").select("conv_id", "turn", X.scrub(F.col("text")).alias("text"))


_PLANTED = "'id 11010519900307' || lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0') || 'X, tel 138' || lpad(CAST(event_id AS VARCHAR), 8, '0') || '; card 6222' || lpad(CAST(event_id AS VARCHAR), 13, '0') || ' mail u' || event_id || '@x-' || event_type || '.example.org ' || props"


@query("b16_scrubbed_planted", f"SELECT event_id, {SCRUB.format('(' + _PLANTED + ')')} AS text FROM events")
def _(t):
    e = F.col("event_id")
    s = e.cast("string")
    text = F.concat(
        F.lit("id 11010519900307"), F.lpad((e % 1000).cast("string"), 3, "0"), F.lit("X, tel 138"), F.lpad(s, 8, "0"), F.lit("; card 6222"),
        F.lpad(s, 13, "0"), F.lit(" mail u"), s, F.lit("@x-"), F.col("event_type"), F.lit(".example.org "), F.col("props"),
    )
    return t.raw("events").select("event_id", X.scrub(text).alias("text"))


@query("f3_person_tokens", f"WITH {_P} SELECT network_id, person_id, name, token FROM ptok")
def _(t):
    return N.person_tokens(t.person).drop("ord")


@query("f4_company_tokens", f"WITH {_P} SELECT network_id, name, token FROM ctok")
def _(t):
    return N.company_tokens(t.person).drop("ord")


@query("j13_roster", f"WITH {_P} SELECT network_id, token, substring(name, 1, 6) AS hint FROM ptok WHERE token <> 'P000'")
def _(t):
    return N.roster(t.person)


_HIDDEN = f"""hid AS (SELECT p.network_id, p.person_id, {_EMBED.replace('name,', "tok,", 1).replace("array_to_string(companies, ', ')", 'ct').replace("array_to_string(cities, ', ')", "'P000'")} AS text
  FROM (SELECT p.*, k.token AS tok, c.token AS ct FROM contact p JOIN ptok k USING (network_id, person_id) LEFT JOIN ctok c ON c.network_id = p.network_id AND c.name = p.companies[1]) p)"""


def _texts(t):
    return A.contacts(t.person).select("network_id", "person_id", Q.embed_text().alias("text"))


@query("b18_pseudonymised", f"WITH {_P}, {_HIDDEN} SELECT * FROM hid")
def _(t):
    return N.pseudonymise(_texts(t), N.dictionary(t.person), ["network_id"], ["person_id"])


@query("b18_pseudonymised_in_place", f"WITH {_P}, {_HIDDEN} SELECT * FROM hid")
def _(t):
    return N.pseudonymise(_texts(t), N.dictionary(t.person), ["network_id"], ["person_id"], leak_safe=False)


@query("b19_restored", f"SELECT network_id, person_id, {_EMBED} || ' P9999' AS text FROM contact")
def _(t):
    """Texts come back whole, and a token that the dictionary does not hold stays; in a network of 9,999 people it would hold this one."""
    names = N.dictionary(t.person).filter("token <> 'P9999'")
    hidden = N.pseudonymise(_texts(t), names, ["network_id"], ["person_id"]).withColumn("text", F.concat("text", F.lit(" P9999")))
    return N.restore(hidden, names, ["network_id"], ["person_id"])


@query("b20_tokenised_companies", f"""WITH {_P}, links AS (SELECT network_id, person_id, unnest(companies || ['Other ' || (person_id % 3)]) AS company FROM contact)
  SELECT l.network_id, person_id, company, coalesce(c.token, company) AS shown FROM links l LEFT JOIN ctok c ON c.network_id = l.network_id AND c.name = l.company""")
def _(t):
    links = A.contacts(t.person).select(
        "network_id", "person_id", F.explode(F.concat("companies", F.array(F.concat(F.lit("Other "), (F.col("person_id") % 3).cast("string"))))).alias("company")
    )
    return N.tokenise_companies(links, N.dictionary(t.person), ["network_id"])


# --------------------------------------------------------------------------- extraction


@query("c5_extraction_worklist", "SELECT network_id, person_id FROM contact WHERE len(companies) = 0 OR len(cities) = 0")
def _(t):
    return E.extraction_worklist(t.person).select("network_id", "person_id")


@query("c5_extraction_worklist_first", "SELECT network_id, person_id FROM (SELECT *, row_number() OVER (PARTITION BY network_id ORDER BY name, person_id) AS r FROM contact) WHERE r <= 66 AND (len(companies) = 0 OR len(cities) = 0)")
def _(t):
    return E.extraction_worklist(t.person, limit=66).select("network_id", "person_id")


@query("j1_extraction_requests", f"""WITH {_P} SELECT network_id, person_id, tok AS person_token, bio, array_to_string(tags, '|') AS tags, coalesce(ct, '') AS companies, 'P000' AS raw_cities, cities[1] AS cities
  FROM (SELECT p.*, k.token AS tok, c.token AS ct FROM contact p JOIN ptok k USING (network_id, person_id) LEFT JOIN ctok c ON c.network_id = p.network_id AND c.name = p.companies[1])""")
def _(t):
    rows = E.extraction_requests(A.contacts(t.person), N.dictionary(t.person))
    get = lambda p: F.get_json_object("payload", p)
    items = lambda p: F.from_json(get(p), "array<string>")
    return rows.select(
        "network_id", "person_id", get("$.person_token").alias("person_token"), get("$.raw_text_fields.bio").alias("bio"),
        items("$.raw_text_fields.raw_tags").alias("tags"), items("$.already_known.companies").alias("companies"),
        items("$.raw_text_fields.raw_cities")[0].alias("raw_cities"), items("$.already_known.cities")[0].alias("cities"),
    )


def _incoming(t):
    """Customers as people not yet known, told in a text that names a known supplier."""
    known = A.contacts(t.person).filter("person_id >= 1000000000").groupBy("network_id").agg(F.min("name").alias("friend"))
    rows = A.contacts(t.person).filter("person_id < 1000000000").join(known, "network_id", "left")
    return rows.select(
        "network_id", "person_id", F.lit("(unnamed)").alias("name"), F.concat_ws(" ", F.lit("works with"), "friend").alias("bio"), F.lit(None).cast("string").alias("notes"),
        "tags", F.concat("companies", F.array(F.lit("Newco"))).alias("companies"), "cities", F.col("tags").alias("known_tags"),
    )


@query("j1b_incoming_requests", f"""WITH {_P}, f AS (SELECT network_id, min(name) AS friend FROM contact WHERE person_id >= 1000000000 GROUP BY 1)
  SELECT p.network_id, p.person_id, 'P_NEW' AS person_token, concat_ws(' ', 'works with', k.token) AS bio, concat_ws('|', c.token, 'Newco') AS companies
  FROM contact p LEFT JOIN f USING (network_id) LEFT JOIN ptok k ON k.network_id = p.network_id AND k.name = friend
  LEFT JOIN ctok c ON c.network_id = p.network_id AND c.name = p.companies[1] WHERE p.person_id < 1000000000""")
def _(t):
    rows = E.extraction_requests(_incoming(t), N.dictionary(t.person), incoming=True)
    get = lambda p: F.get_json_object("payload", p)
    return rows.select("network_id", "person_id", get("$.person_token").alias("person_token"), get("$.raw_text_fields.bio").alias("bio"),
                       F.from_json(get("$.already_known.companies"), "array<string>").alias("companies"))




def _answers(t):
    text = F.concat(
        F.lit('{"companies": ["C001", "C999", "P003", " New '), (F.col("person_id") % 5).cast("string"),
        F.lit(' ", 7, "at C001"], "cities": ["中国", "Town", "C001"], "titles": ["Lead", "P001"], "extra_tags": "no list"}'),
    )
    k = F.col("person_id") % 7
    raw = F.when(k == 0, "").when(k == 1, "{oops").when(k == 2, "[1]").when(k == 3, F.concat(F.lit("```json\n"), text, F.lit("\n```"))).otherwise(text)
    return A.contacts(t.person).select("network_id", "person_id", raw.alias("raw"))


_DIFF = """diff AS (SELECT p.network_id, p.person_id, p.person_id % 7 AS k, CASE WHEN p.person_id % 7 < 3 THEN [] ELSE list_filter([c.name, 'New ' || (p.person_id % 5), CASE WHEN c.name IS NULL THEN 'at' ELSE 'at ' || c.name END], lambda x: x IS NOT NULL) END AS add_companies,
   CASE WHEN p.person_id % 7 < 3 THEN [] ELSE ['Town'] END AS add_cities, CASE WHEN p.person_id % 7 < 3 THEN [] ELSE ['Lead'] END AS add_titles,
   (['empty answer', 'not JSON', 'not an object'])[p.person_id % 7 + 1] AS error FROM contact p LEFT JOIN ctok c ON c.network_id = p.network_id AND c.token = 'C001')"""


@query("j2_parsed_extractions", f"WITH {_P}, {_DIFF} SELECT network_id, person_id, array_to_string(add_companies, '|') AS add_companies, array_to_string(add_cities, '|') AS add_cities, array_to_string(add_titles, '|') AS add_titles, '' AS add_tags, error FROM diff")
def _(t):
    return E.parse_extractions(_answers(t), N.dictionary(t.person))


@query("c7_cleaned_lists", f"WITH {_P}, {_DIFF} SELECT network_id, city, count(*) AS n FROM (SELECT network_id, unnest(add_cities) AS city FROM diff) GROUP BY ALL")
def _(t):
    rows = E.parse_extractions(_answers(t), N.dictionary(t.person))
    return rows.select("network_id", F.explode("add_cities").alias("city")).groupBy("network_id", "city").agg(F.count(F.lit(1)).alias("n"))


@query("j3_applied_extractions", f"""WITH {_P}, {_DIFF} SELECT p.network_id, p.person_id, array_to_string(p.companies || list_filter(add_companies, lambda x: NOT list_contains(p.companies, x)), '|') AS companies,
  array_to_string(p.cities || add_cities, '|') AS cities, array_to_string(p.tags || add_titles, '|') AS tags, k >= 3 AS touched FROM contact p JOIN diff d USING (network_id, person_id)""")
def _(t):
    done = E.apply_extractions(A.contacts(t.person), E.parse_extractions(_answers(t), N.dictionary(t.person)))
    return done.select("network_id", "person_id", "companies", "cities", "tags", "touched")


@query("e13_extraction_summary", f"WITH {_P}, {_DIFF} SELECT network_id, count(*) AS total, count(*) FILTER (WHERE k >= 3) AS with_additions, 0 AS no_op, count(*) FILTER (WHERE k < 3) AS failed, count(*) FILTER (WHERE k >= 3) AS touched FROM diff GROUP BY 1")
def _(t):
    from tieweave.session import cut

    diffs = cut(E.parse_extractions(_answers(t), N.dictionary(t.person)))
    return E.extraction_summary(diffs, E.apply_extractions(A.contacts(t.person), diffs))


# ------------------------------------------------------------------------ edge proposals


def _edge_answers(t):
    """Answers about each person and the ones before and after: odd values, repeats, P000."""
    ids = N.person_tokens(t.person).filter("ord > 0")
    other = lambda d: F.format_string("P%03d", F.col("ord") + d)
    edge = lambda b, s, f: F.concat(
        F.lit('{"a": "'), "token", F.lit('", "b": "'), b, F.lit(f'", "strength": {s}, "frequency": {f}, "context": "met '), "token", F.lit('", "rationale": " "}')
    )
    parts = [edge(other(1), "4", '"Monthly"'), edge(other(1), "1", "null"), edge(other(3), '"5"', '"daily"'), edge(F.lit("P000"), "2", "null"), edge(F.lit("P99999"), "true", "1"), edge(F.col("token"), "3", "null"), edge(other(4), "2.5", "null")]
    raw = F.concat(F.lit('{"edges": [7, '), F.concat_ws(", ", *parts), F.lit('], "unknown_mentions": ["Mike", " Mike ", 3, "Ann"]}'))
    return ids.select("network_id", F.col("person_id").alias("request_id"), raw.alias("raw"))


_PROP = f"""{_P}, num AS (SELECT network_id, person_id, name, row_number() OVER (PARTITION BY network_id ORDER BY name, person_id) AS n FROM contact),
  prop AS (SELECT a.network_id, a.person_id AS request_id, least(a.person_id, b.person_id) AS low_id, greatest(a.person_id, b.person_id) AS high_id, CASE d WHEN 1 THEN 4 WHEN 3 THEN 5 END AS strength,
    CASE d WHEN 1 THEN 'monthly' END AS frequency, 'met ' || a.name AS context, CAST(NULL AS VARCHAR) AS rationale
    FROM num a, (SELECT unnest([1, 3, 4]) AS d), num b WHERE b.network_id = a.network_id AND b.n = a.n + d)"""


@query("j4_edge_proposals", f"WITH {_PROP} SELECT * FROM prop")
def _(t):
    rows = E.parse_edge_answers(_edge_answers(t), cut(N.dictionary(t.person)))
    return rows.select("network_id", "request_id", "low_id", "high_id", "strength", "frequency", "context", "rationale")


@query("j4_unknown_mentions", f"WITH {_PROP} SELECT network_id, person_id AS request_id, unnest(['Mike', 'Ann']) AS mention FROM num")
def _(t):
    return E.unknown_mentions(_edge_answers(t))


@query("j4_edge_requests", f"""WITH {_P}, nx AS (SELECT a.network_id, a.person_id, a.token, a.name, row_number() OVER (PARTITION BY network_id ORDER BY token) AS n FROM ptok a WHERE token <> 'P000')
  SELECT a.network_id, a.person_id AS request_id, a.token || '和' || coalesce(b.token, '') || '是同事，P000介绍' AS text FROM nx a LEFT JOIN nx b ON b.network_id = a.network_id AND b.n = a.n + 1""")
def _(t):
    ids = N.person_tokens(t.person)
    here, there = ids.filter("ord > 0"), ids.filter("ord > 1").select("network_id", (F.col("ord") - 1).alias("ord"), F.col("name").alias("other"))
    me = ids.filter("ord = 0").select("network_id", F.col("name").alias("me_name"))
    texts = here.join(there, ["network_id", "ord"], "left").join(me, "network_id").select(
        "network_id", F.col("person_id").alias("request_id"),
        F.concat("name", F.lit("和"), F.coalesce("other", F.lit("")), F.lit("是同事，"), "me_name", F.lit("介绍")).alias("text"),
    )
    return E.edge_requests(texts, N.dictionary(t.person))


@query("d10_context_rows", f"""WITH {_PROP} SELECT h.network_id, from_id AS person_id, edge_id FROM hop h JOIN (SELECT DISTINCT network_id, unnest([low_id, high_id]) AS person_id FROM prop) p ON p.network_id = h.network_id AND p.person_id = from_id""")
def _(t):
    proposals = E.proposed_edges(_edge_answers(t), cut(N.dictionary(t.person)))
    return E.proposal_context(proposals, A.neighbourhood(t.edge, t.person)).select("network_id", "person_id", "edge_id")


def _accepted(t):
    """Accepted proposals: known pairs and new ones, self loops and unknown people."""
    return t.edge.select(
        "network_id", "source_id",
        F.when(F.col("edge_id") % 6 == 0, F.col("source_id")).when(F.col("edge_id") % 10 == 0, F.lit(-999)).otherwise(F.col("target_id")).alias("target_id"),
        F.lit(1).alias("strength"), F.lit("told").alias("context"), F.lit("rare").alias("frequency"), F.col("edge_id").alias("seq"),
    )


_ACC = "acc AS (SELECT network_id, source_id, CASE WHEN edge_id % 6 = 0 THEN source_id WHEN edge_id % 10 = 0 THEN -999 ELSE target_id END AS target_id, edge_id % 6 <> 0 AND edge_id % 10 <> 0 AS ok FROM edge)"


@query("j5_applied_proposals", f"""WITH {_ACC} SELECT e.network_id, e.source_id, e.target_id, CASE WHEN a.ok THEN 1 ELSE e.strength END AS strength, CASE WHEN a.ok THEN 'told' ELSE e.context END AS context
  FROM edge e LEFT JOIN (SELECT * FROM acc WHERE ok) a USING (network_id, source_id, target_id)""")
def _(t):
    return E.apply_proposals(t.edge, _accepted(t), t.person)[0].select("network_id", "source_id", "target_id", "strength", "context")


@query("j5_apply_counts", f"WITH {_ACC} SELECT network_id, count(*) FILTER (WHERE ok) AS applied, count(*) FILTER (WHERE NOT ok) AS skipped FROM acc GROUP BY 1")
def _(t):
    return E.apply_proposals(t.edge, _accepted(t), t.person)[1]


# --------------------------------------------------------------------------- goals, judge


@query("j6_parsed_goals", """SELECT goal_id, network_id, CASE goal_id % 4 WHEN 3 THEN original ELSE summary END AS summary, CASE goal_id % 4 WHEN 3 THEN '' ELSE roles[1] END AS roles,
  CASE goal_id % 4 WHEN 0 THEN industries[1] ELSE '' END AS industries, CASE goal_id % 4 WHEN 3 THEN original ELSE keywords[1] END AS keywords, CASE goal_id % 4 WHEN 0 THEN cities[1] ELSE '' END AS cities FROM goal""")
def _(t):
    k = F.col("goal_id") % 4
    today = F.to_json(F.struct(F.col("roles").alias("helper_roles"), F.col("industries").alias("helper_industries"), F.col("keywords").alias("topic_keywords"), F.col("summary").alias("helper_description"), "cities"))
    older = F.to_json(F.struct("roles", F.col("keywords")[0].alias("keywords"), "summary"))
    raw = F.when(k == 0, today).when(k == 3, F.lit("sorry, no")).otherwise(older)
    answers = t.goal.select("goal_id", "network_id", "original", raw.alias("raw"))
    return E.parse_goals(answers).select("goal_id", "network_id", "summary", "roles", "industries", "keywords", "cities")


@query("j12_judge_requests", "SELECT goal_id, count(*) AS n, min('P' || lpad(CAST(rank AS VARCHAR), 3, '0')) AS first_id, round(max(score), 4) AS best, any_value(g.original) AS goal FROM cand JOIN goal g USING (goal_id) GROUP BY 1")
def _(t):
    from tieweave.session import cut

    found = cut(T.hybrid_search(t.goal, t.person, t.embedding))
    rows = E.judge_requests(t.goal, found, t.person)
    get = lambda p: F.get_json_object("payload", p)
    return rows.select("goal_id", "n", get("$.candidates[0].id").alias("first_id"), get("$.candidates[0].hybrid_score").cast("double").alias("best"), get("$.goal").alias("goal"))


# -------------------------------------------------------------------------------- aliases


def _rules(t):
    """Brands 10..19 fold into Brand#1 and 20..29 into Brand#2; a later group also asks for some."""
    brand = t.raw("part").select("p_brand").distinct().withColumn("n", F.substring("p_brand", 7, 9).cast("int"))
    first = brand.filter("n between 10 and 29").select(
        F.concat(F.lit("Brand#"), F.floor(F.col("n") / 10).cast("string")).alias("canonical"), F.col("p_brand").alias("alias"), F.lit("file").alias("source"),
        F.floor(F.col("n") / 10).cast("int").alias("group_ord"), (F.col("n") % 10).cast("int").alias("member_ord"),
    )
    late = brand.filter("n between 3 and 6 or n between 10 and 12").select(
        F.lit("Big Brand").alias("canonical"), F.col("p_brand").alias("alias"), F.lit("model").alias("source"), F.lit(0).alias("group_ord"), F.col("n").alias("member_ord")
    )
    return first.unionByName(late)


_MERGE = """names AS (SELECT network_id, company, count(*) AS n, CAST(substring(company, 7) AS BIGINT) AS b FROM (SELECT DISTINCT network_id, person_id, unnest(companies) AS company FROM contact) GROUP BY ALL),
  g AS (SELECT network_id, company, n, b, CASE WHEN b BETWEEN 10 AND 19 OR b = 1 THEN 1 WHEN b BETWEEN 20 AND 29 OR b = 2 THEN 2 ELSE 3 END AS grp FROM names),
  fileplan AS (SELECT * FROM g WHERE grp < 3 QUALIFY count(*) OVER (PARTITION BY network_id, grp) >= 2),
  late AS (SELECT * FROM g WHERE (b BETWEEN 3 AND 6 OR b BETWEEN 10 AND 12) AND NOT EXISTS (FROM fileplan f WHERE f.network_id = g.network_id AND f.company = g.company) QUALIFY count(*) OVER (PARTITION BY network_id) >= 2),
  plan AS (SELECT network_id, 'Brand#' || grp AS canonical, company AS alias, 'file' AS source, sum(n) OVER (PARTITION BY network_id, grp)::BIGINT AS headcount, n FROM fileplan
    UNION ALL SELECT network_id, 'Big Brand', company, 'model', sum(n) OVER (PARTITION BY network_id)::BIGINT, n FROM late)"""


@query("j8_alias_plan", f"WITH {_MERGE} SELECT network_id, canonical, alias, source, headcount FROM plan WHERE alias <> canonical")
def _(t):
    return L.plan_merges(t.person, _rules(t)).select("network_id", "canonical", "alias", "source", "headcount")


@query("j9_merged_people", f"""WITH {_MERGE} SELECT p.network_id, p.person_id, coalesce(m.canonical, p.companies[1], '') AS companies FROM contact p LEFT JOIN plan m ON m.network_id = p.network_id AND m.alias = p.companies[1]""")
def _(t):
    return L.merge_companies(A.contacts(t.person), L.plan_merges(t.person, _rules(t))).select("network_id", "person_id", "companies")


@query("d14_merged_links", f"""WITH {_MERGE} SELECT p.network_id, p.person_id, coalesce(m.canonical, p.company) AS company FROM (SELECT network_id, person_id, unnest(companies) AS company FROM contact) p LEFT JOIN plan m ON m.network_id = p.network_id AND m.alias = p.company""")
def _(t):
    return L.merged_links(A.contacts(t.person), L.plan_merges(t.person, _rules(t))).drop("at")


def _company_links(t):
    """What the orders tell of a customer and a brand: the first date, the last priority, whether an order is open."""
    o = t.raw("orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    lines = t.raw("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey")).distinct()
    rows = lines.join(o, "o_orderkey").join(t.raw("part").select("p_partkey", "p_brand"), "p_partkey")
    of = t.raw("customer").select(F.col("c_custkey").alias("o_custkey"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("network_id"))
    return rows.groupBy("o_custkey", F.col("p_brand").alias("company")).agg(
        F.max("o_orderpriority").alias("role"), F.min("o_orderdate").cast("date").alias("since"), F.bool_or(F.col("o_orderstatus") == "O").alias("is_current")
    ).join(of, "o_custkey").select("network_id", F.col("o_custkey").alias("person_id"), "company", "role", "since", "is_current")


@query("d14_merged_link_rows", f"""WITH {_MERGE}, ordered AS (SELECT network_id, alias, canonical, CASE WHEN alias = canonical THEN -1 WHEN source = 'model' THEN CAST(substring(alias, 7) AS BIGINT) ELSE CAST(substring(alias, 7) AS BIGINT) % 10 END AS r FROM plan),
  link AS (SELECT 'n' || c_nationkey AS network_id, o_custkey AS person_id, p_brand AS company, max(o_orderpriority) AS role, CAST(min(o_orderdate) AS DATE) AS since, bool_or(o_orderstatus = 'O') AS is_current
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
  SELECT network_id, person_id, company, role, CAST(since AS VARCHAR) AS since, is_current FROM (
    SELECT l.network_id, l.person_id, coalesce(o.canonical, l.company) AS company, role, since, is_current FROM link l LEFT JOIN ordered o ON o.network_id = l.network_id AND o.alias = l.company
    QUALIFY row_number() OVER (PARTITION BY l.network_id, l.person_id, coalesce(o.canonical, l.company) ORDER BY coalesce(r, -1)) = 1)""")
def _(t):
    rows = L.merged_link_rows(_company_links(t), L.plan_merges(t.person, _rules(t)))
    return rows.withColumn("since", F.col("since").cast("string"))


# Firms as people write them: every spelling of the built-in rules, and brands.
_SPELLED = [name for canonical, names in V.BUILTIN_ALIASES.items() for name in (canonical, *names)]
_FILE = "国君系"


def _firm_people(t):
    """Customers with the firms that their orders name."""
    k = F.col("o_orderkey")
    firm = F.when(k % 3 == 0, F.concat(F.lit("Brand#"), (k % 30).cast("string"))).otherwise(F.element_at(F.array(*[F.lit(x) for x in _SPELLED]), (k % len(_SPELLED) + 1).cast("int")))
    network = F.concat(F.lit("n"), (F.col("o_custkey") % 400).cast("string"))
    return t.raw("orders").groupBy(network.alias("network_id"), F.col("o_custkey").alias("person_id")).agg(F.sort_array(F.collect_set(firm)).alias("companies")).withColumn("is_me", F.lit(False))


def _all_rules(t):
    """Rules of a file (brands by their first digit, and a group that takes two names from a built-in one) and the built-in rules."""
    import hashlib

    from tieweave.session import work_path

    brand = t.raw("part").select("p_brand", F.substring("p_brand", 7, 9).cast("int").alias("n")).distinct().filter("n between 10 and 29")
    groups = brand.groupBy(F.concat(F.lit("Brand#"), F.floor(F.col("n") / 10).cast("string")).alias("canonical")).agg(F.sort_array(F.collect_list("p_brand")).alias("aliases"))
    mine = t.spark.range(1).select(F.lit(_FILE).alias("canonical"), F.array(F.lit("国君"), F.lit(" 国君证券"), F.lit("")).alias("aliases"))
    text = groups.unionByName(mine).agg(F.to_json(F.collect_list(F.struct("canonical", "aliases"))).alias("value"))
    path = work_path(t.spark, "export", hashlib.sha1(t.sf.encode()).hexdigest()[:12], "alias_rules")
    text.write.mode("overwrite").text(path)
    return read_alias_rules(t.spark, path).unionByName(L.builtin_rules(t.spark))


_BUILTIN_ROWS = ", ".join(f"('{c}', '{a}')" for c, names in V.BUILTIN_ALIASES.items() for a in (c, *names))
_RULED = f"""firm AS (SELECT DISTINCT 'n' || (o_custkey % 400) AS network_id, o_custkey AS person_id,
    CASE WHEN o_orderkey % 3 = 0 THEN 'Brand#' || (o_orderkey % 30) ELSE ([{", ".join(f"'{x}'" for x in _SPELLED)}])[o_orderkey % {len(_SPELLED)} + 1] END AS company FROM orders),
  names AS (SELECT network_id, company, count(*) AS n FROM firm GROUP BY ALL),
  in_file AS (SELECT DISTINCT p_brand[1:7] AS canonical, p_brand AS company FROM part WHERE CAST(p_brand[7:] AS INT) BETWEEN 10 AND 29 UNION SELECT DISTINCT p_brand[1:7], p_brand[1:7] FROM part WHERE CAST(p_brand[7:] AS INT) BETWEEN 10 AND 29
    UNION ALL VALUES ('{_FILE}', '{_FILE}'), ('{_FILE}', '国君'), ('{_FILE}', '国君证券')),
  first AS (SELECT * FROM names JOIN in_file USING (company) QUALIFY count(*) OVER (PARTITION BY network_id, canonical) >= 2),
  built_in AS (FROM (VALUES {_BUILTIN_ROWS}) v(canonical, company)),
  second AS (SELECT * FROM names JOIN built_in USING (company) ANTI JOIN first f USING (network_id, company) QUALIFY count(*) OVER (PARTITION BY network_id, canonical) >= 2),
  plan AS (SELECT network_id, canonical, company AS alias, 'file' AS source, sum(n) OVER (PARTITION BY network_id, canonical)::BIGINT AS headcount FROM first
    UNION ALL SELECT network_id, canonical, company, 'builtin', sum(n) OVER (PARTITION BY network_id, canonical)::BIGINT FROM second)"""


@query("j8_file_and_builtin_plan", f"WITH {_RULED} SELECT network_id, canonical, alias, source, headcount FROM plan WHERE alias <> canonical")
def _(t):
    return L.plan_merges(_firm_people(t), _all_rules(t)).select("network_id", "canonical", "alias", "source", "headcount")


@query("j9_file_and_builtin_merge", f"WITH {_RULED} SELECT DISTINCT f.network_id, person_id, coalesce(canonical, company) AS company FROM firm f LEFT JOIN plan p ON p.network_id = f.network_id AND p.alias = f.company")
def _(t):
    people = _firm_people(t)
    return L.merged_links(people, L.plan_merges(people, _all_rules(t))).drop("at")


@query("h2_residual_names", f"WITH {_MERGE} SELECT network_id, company FROM names ANTI JOIN (SELECT network_id, alias AS company FROM plan) USING (network_id, company)")
def _(t):
    return L.residual_names(t.person, L.plan_merges(t.person, _rules(t)))


@query("e14_merge_summary", f"""WITH {_MERGE}, k AS (SELECT *, bool_or(alias = canonical) OVER w AS known, row_number() OVER (w ORDER BY CASE WHEN alias = canonical THEN -1 WHEN source = 'model' THEN CAST(substring(alias, 7) AS BIGINT) ELSE CAST(substring(alias, 7) AS BIGINT) % 10 END) AS r FROM plan WINDOW w AS (PARTITION BY network_id, canonical)),
  c AS (SELECT network_id, sum(n)::BIGINT AS links_moved, count(*) AS names_removed FROM k WHERE r > 1 GROUP BY 1)
  SELECT b.network_id, names_before, names_before - f.n AS names_after, links_moved, names_removed FROM (SELECT network_id, count(*) AS names_before FROM names GROUP BY 1) b
  JOIN (SELECT network_id, count(*) FILTER (WHERE alias <> canonical) AS n FROM plan GROUP BY 1) f USING (network_id) JOIN c USING (network_id)""")
def _(t):
    return L.merge_summary(t.person, L.plan_merges(t.person, _rules(t)))


@query("a6_alias_rules", """SELECT DISTINCT p_type AS canonical, p_brand AS alias FROM part WHERE p_brand <> 'Brand#1' UNION ALL SELECT 'Big', 'Brand#1'""")
def _(t):
    """Both shapes of rule text, made from the part table."""
    groups = t.raw("part").filter("p_brand <> 'Brand#1'").groupBy("p_type").agg(F.sort_array(F.collect_set("p_brand")).alias("l"))
    first = groups.select(F.to_json(F.map_from_arrays(F.array(F.concat(F.lit(" "), "p_type")), F.array("l"))).alias("raw"))
    brand = t.raw("part").filter("p_brand = 'Brand#1'").agg(F.max("p_brand").alias("b"))
    second = brand.select(F.concat(F.lit('[{"canonical": " Big", "aliases": ["'), "b", F.lit('", " "]}, {"canonical": "", "aliases": ["x"]}, 5]')).alias("raw"))
    return parse_alias_rules(first.unionByName(second)).select("canonical", "alias")


@query("j10_cluster_rules", "SELECT DISTINCT p_type AS canonical, p_brand AS alias FROM part")
def _(t):
    groups = t.raw("part").groupBy("p_type").agg(F.sort_array(F.collect_set("p_brand")).alias("l"))
    one = F.struct(F.concat("p_type", F.lit(" ")).alias("canonical"), F.concat("l", F.array("p_type")).alias("aliases"))
    raw = groups.select(F.to_json(F.struct(F.array(one).alias("groups"))).alias("raw"))
    return L.parse_clusters(raw).select("canonical", "alias")


