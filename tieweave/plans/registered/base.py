"""Registration, result normalisation and the shared SQL tables of the checks."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tieweave.sources import testbed as B

QUERIES: dict = {}
ORACLES: dict = {}


def flat(df: DataFrame) -> DataFrame:
    """Whole numbers as long, doubles to 6 digits, lists as text."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), 6)
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), "|")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def query(name: str, sql: str | None = None):
    """Register a query under ``name``; ``sql`` must give the same rows."""

    def add(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return flat(fn(Tables(spark, sf)))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_tables(sql)
        return fn

    return add


class Tables:
    """The derived tables of one test directory."""

    def __init__(self, spark: SparkSession, sf: str) -> None:
        self.spark, self.sf = spark, sf

    def raw(self, name: str) -> DataFrame:
        return B.raw(self.spark, self.sf, name)

    @property
    def person(self) -> DataFrame:
        return B.person(self.spark, self.sf)

    @property
    def owners(self) -> DataFrame:
        """The owners among ``person``, of whom nothing but the nations tells."""
        return B.owners(self.spark, self.sf)

    @property
    def edge(self) -> DataFrame:
        return B.edge(self.spark, self.sf)

    @property
    def goal(self) -> DataFrame:
        return B.goal(self.spark, self.sf)

    @property
    def embedding(self) -> DataFrame:
        return B.embedding(self.spark, self.sf)

    @property
    def embedding_all(self) -> DataFrame:
        return B.embedding(self.spark, self.sf, one_network=True)

    @property
    def label_goal(self) -> DataFrame:
        return B.label_queries(self.spark, self.sf)

    @property
    def changes(self) -> DataFrame:
        return B.edge_changes(self.spark, self.sf)

    @property
    def me(self) -> DataFrame:
        from tieweave.operators.analytics import me_rows

        return me_rows(self.person)

    def forest(self, max_hops: int = 3, floor: int = 4) -> DataFrame:
        """The path forest depends on the edges only, so it is written once and shared."""
        from tieweave.operators.paths import path_forest
        from tieweave.session import write_once

        build = lambda: path_forest(self.edge, self.me, max_hops, floor)
        return write_once(self.spark, self.sf, f"forest_{max_hops}_{floor}", build)


def _list(words: list[str]) -> str:
    return "[" + ",".join(f"'{w}'" for w in words) + "]"


def _pick(words: list[str]) -> str:
    return f"({_list(words)})[label % {len(words)} + 1]"


_NONE = "CAST([] AS VARCHAR[])"

# name -> (tables it reads, SQL)
_CTES: dict[str, tuple[list[str], str]] = {
    "dear": ([], """
        SELECT o_custkey, arg_min(l_partkey, {x: -l_extendedprice, o: l_orderkey, l: l_linenumber}) AS pk
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey"""),
    "need_rows": ([], """
        SELECT o_custkey, list_sort(list(DISTINCT p_type)) AS needs
        FROM (SELECT o_custkey, arg_max(o_orderkey, {d: o_orderdate, k: o_orderkey}) AS ok FROM orders GROUP BY o_custkey)
        JOIN lineitem ON l_orderkey = ok JOIN part ON l_partkey = p_partkey GROUP BY o_custkey"""),
    "shipped": ([], """
        SELECT l_suppkey, list_sort(list(DISTINCT p_type)) AS tags, list_sort(list(DISTINCT split_part(p_name, ' ', 2))) AS skills
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey"""),
    "person": (["dear", "need_rows", "shipped"], f"""
        SELECT 'n' || n_nationkey AS network_id, CAST(-(n_nationkey + 1) AS BIGINT) AS person_id, n_name AS name,
               CAST(NULL AS VARCHAR) AS bio, CAST(NULL AS VARCHAR) AS notes, TRUE AS is_me, FALSE AS is_wishlist,
               {_NONE} AS tags, {_NONE} AS skills, {_NONE} AS companies, {_NONE} AS cities, {_NONE} AS needs
        FROM nation
        UNION ALL
        SELECT 'n' || c_nationkey, c_custkey, c_name, d.text, v.text, FALSE, c_acctbal < 0,
               [c_mktsegment], {_NONE}, CASE WHEN p_brand IS NULL THEN {_NONE} ELSE [p_brand] END, [n_name],
               coalesce(need_rows.needs, {_NONE})
        FROM customer JOIN nation ON c_nationkey = n_nationkey
        LEFT JOIN documents d ON d.doc_id = c_custkey
        LEFT JOIN (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id) v ON v.conv_id = c_custkey
        LEFT JOIN dear ON dear.o_custkey = c_custkey LEFT JOIN part ON p_partkey = dear.pk
        LEFT JOIN need_rows ON need_rows.o_custkey = c_custkey
        UNION ALL
        SELECT 'n' || s_nationkey, 1000000000 + s_suppkey, s_name, NULL, NULL, FALSE, FALSE,
               coalesce(tags, {_NONE}), coalesce(skills, {_NONE}), {_NONE}, [n_name], {_NONE}
        FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN shipped ON l_suppkey = s_suppkey"""),
    "edge": ([], """
        SELECT 'n' || c_nationkey AS network_id, c_custkey AS edge_id, CAST(-(c_nationkey + 1) AS BIGINT) AS source_id,
               c_custkey AS target_id, CAST(least(5, floor(c_acctbal / 2000) + 1) AS BIGINT) AS strength,
               'client' AS context, 'yearly' AS frequency, 'manual' AS source
        FROM customer WHERE c_acctbal >= 0
        UNION ALL
        SELECT 'n' || c_nationkey, 1000000000000 + c_custkey * 100000000 + s_suppkey, c_custkey, 1000000000 + s_suppkey,
               least(5, n), 'orders:' || n,
               CASE WHEN n >= 5 THEN 'weekly' WHEN n = 4 THEN 'monthly' WHEN n = 3 THEN 'quarterly' ELSE 'yearly' END, 'manual'
        FROM (SELECT o_custkey, l_suppkey, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)
        JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey = s_nationkey"""),
    "emb": ([], """
        SELECT coalesce('n' || c_nationkey, 'all') AS network_id, vec_id AS person_id, embedding AS vector
        FROM embeddings LEFT JOIN customer ON c_custkey = vec_id"""),
    "emb_all": ([], "SELECT 'all' AS network_id, vec_id AS person_id, embedding AS vector, label FROM embeddings"),
    "label_goal": ([], """
        SELECT CAST(label AS BIGINT) AS goal_id, 'all' AS network_id, min(vec_id) AS vec_id, arg_min(embedding, vec_id) AS vector
        FROM embeddings GROUP BY label"""),
    "goal": (["label_goal"], f"""
        SELECT label * 100 + n_nationkey AS goal_id, 'n' || n_nationkey AS network_id,
               'find a ' || lower({_pick(B.ROLES)}) || ' partner in ' || n_name AS original,
               'partner for ' || {_pick(B.SKILLS)} AS summary,
               [{_pick(B.ROLES)}] AS roles, [{_pick(B.KINDS)}] AS industries, [{_pick(B.SKILLS)}] AS skills,
               [{_pick(B.TOPICS)}] AS keywords, ['NATION_' || (n_nationkey % 3)] AS cities, vector
        FROM nation, (SELECT goal_id AS label, vector FROM label_goal)"""),
    "me": (["person"], "SELECT network_id, person_id AS me_id, name AS me_name FROM person WHERE is_me"),
    "contact": (["person"], "SELECT * FROM person WHERE NOT is_me"),
    "pair": (["edge"], """
        SELECT network_id, least(source_id, target_id) AS low_id, greatest(source_id, target_id) AS high_id,
               arg_max(strength, edge_id) AS strength, arg_max(context, edge_id) AS context,
               arg_max(frequency, edge_id) AS frequency, max(edge_id) AS edge_id
        FROM edge GROUP BY ALL"""),
    "hop": (["pair"], """
        SELECT network_id, low_id AS from_id, high_id AS to_id, strength, context, frequency, edge_id FROM pair
        UNION ALL SELECT network_id, high_id, low_id, strength, context, frequency, edge_id FROM pair"""),
    "hop_colleagues": (["hop", "contact"], """
        SELECT network_id, from_id, to_id, strength FROM hop
        UNION ALL SELECT DISTINCT a.network_id, a.person_id, b.person_id, 4
        FROM (SELECT network_id, person_id, trim(unnest(companies)) AS company FROM contact) a
        JOIN (SELECT network_id, person_id, trim(unnest(companies)) AS company FROM contact) b USING (network_id, company)
        WHERE company <> '' AND a.person_id <> b.person_id
          AND NOT EXISTS (SELECT 1 FROM hop h WHERE h.network_id = a.network_id AND h.from_id = a.person_id AND h.to_id = b.person_id)"""),
    "s2me": (["hop", "me"], """
        SELECT h.network_id, to_id AS person_id, strength AS strength_to_me FROM hop h JOIN me ON me.network_id = h.network_id AND from_id = me_id"""),
    "term": (["goal"], """
        SELECT goal_id, network_id, channel, term, count(*) AS times FROM (
          SELECT goal_id, network_id, 'helper' AS channel, lower(trim(unnest(roles || industries || skills))) AS term FROM goal
          UNION ALL SELECT goal_id, network_id, 'topic', lower(trim(unnest(keywords || cities))) FROM goal)
        WHERE term <> '' GROUP BY ALL"""),
    "hay": (["contact"], r"""
        SELECT network_id, person_id, lower(concat_ws(chr(1), name, bio, notes, array_to_string(tags, chr(1)),
               array_to_string(skills, chr(1)), array_to_string(companies, chr(1)), array_to_string(cities, chr(1)))) AS text FROM contact"""),
    "hit": (["term", "hay"], """
        SELECT t.goal_id, t.network_id, channel, person_id, CAST(sum(times) AS BIGINT) AS hits
        FROM term t JOIN hay h ON h.network_id = t.network_id AND contains(text, term) GROUP BY ALL"""),
    "near": (["goal", "emb"], """
        SELECT * FROM (SELECT g.goal_id, g.network_id, person_id, list_distance(CAST(e.vector AS DOUBLE[]), CAST(g.vector AS DOUBLE[])) AS distance,
               row_number() OVER (PARTITION BY g.goal_id ORDER BY distance, person_id) AS rank
        FROM goal g JOIN emb e ON e.network_id = g.network_id) WHERE rank <= 60"""),
    "chan": (["hit", "near"], """
        SELECT goal_id, network_id, person_id, channel, row_number() OVER (PARTITION BY goal_id, channel ORDER BY hits DESC, person_id) AS rank FROM hit
        UNION ALL SELECT goal_id, network_id, person_id, 'vector', rank FROM near"""),
    "fused": (["chan"], """
        SELECT goal_id, network_id, person_id,
               coalesce(max(CASE WHEN channel = 'vector' THEN 1.5e0 / (60 + rank) END), 0e0)
             + coalesce(max(CASE WHEN channel = 'helper' THEN 1.5e0 / (60 + rank) END), 0e0)
             + coalesce(max(CASE WHEN channel = 'topic' THEN 0.3e0 / (60 + rank) END), 0e0) AS raw
        FROM chan GROUP BY ALL"""),
    "cand": (["fused"], """
        SELECT * FROM (SELECT goal_id, network_id, person_id, raw / max(raw) OVER (PARTITION BY goal_id) AS score,
               row_number() OVER (PARTITION BY goal_id ORDER BY raw DESC, person_id) AS rank FROM fused) WHERE rank <= 30"""),
}


def forest_ctes(max_hops: int = 3, floor: int = 4, hops: str = "hop") -> str:
    """Cheapest and fewest-hop paths from the owner over the legs in ``hops``, by keyed recursion."""
    penalty = max_hops * max_hops * 4

    def recursion(name: str, cost: str, cap: str) -> str:
        return f"""{name}(network_id, node, k) USING KEY (network_id, node) AS (
          SELECT network_id, me_id, {{'cost': CAST(0 AS BIGINT), 'hops': 0, 'path': [me_id], 'st': CAST([] AS BIGINT[])}} FROM me
          UNION
          SELECT n.network_id, n.node, n.k FROM (
            SELECT f.network_id, l.to_id AS node, min({{'cost': f.k.cost + {cost}, 'hops': f.k.hops + 1,
                   'path': list_append(f.k.path, l.to_id), 'st': list_append(f.k.st, l.strength)}}) AS k
            FROM {name} f JOIN leg l ON l.network_id = f.network_id AND l.from_id = f.node WHERE {cap} GROUP BY ALL) n
          LEFT JOIN recurring.{name} r ON r.network_id = n.network_id AND r.node = n.node
          WHERE r.node IS NULL OR n.k < r.k)"""

    return f"""leg AS (
          SELECT h.network_id, from_id, to_id, strength,
                 CAST((60 // greatest(strength, 1)) * CASE WHEN (from_id = me_id OR to_id = me_id) AND strength < {floor} THEN {penalty} ELSE 1 END AS BIGINT) AS cost
          FROM {hops} h LEFT JOIN me ON me.network_id = h.network_id),
        {recursion('cheapest', 'l.cost', 'TRUE')},
        {recursion('fewest', '1', f'f.k.hops < {max_hops}')},
        forest AS (
          SELECT network_id, node AS person_id, k.hops AS hops, k.path AS path, k.st AS strengths,
                 CAST(list_sum(k.st) AS BIGINT) AS path_strength,
                 CASE WHEN k.hops > 1 THEN 'indirect' WHEN k.st[1] < {floor} THEN 'weak' ELSE 'direct' END AS kind
          FROM (SELECT c.network_id, c.node, CASE WHEN c.k.hops <= {max_hops} THEN c.k ELSE f.k END AS k
                FROM cheapest c LEFT JOIN fewest f ON f.network_id = c.network_id AND f.node = c.node)
          WHERE k.hops BETWEEN 1 AND {max_hops})"""


def ranked_ctes(candidates: str = "cand", people: str = "contact") -> str:
    return f"""ranked AS (
          SELECT c.goal_id, c.network_id, c.person_id, c.score, c.rank, f.hops, f.path, f.strengths, f.path_strength, f.kind,
                 c.score * (0.9e0 + 0.1e0 * ((f.path_strength / f.hops) / 5.0e0)) * (1.0e0 / pow(CAST(f.hops AS DOUBLE), 1.3e0)) AS combined,
                 p.name, p.is_wishlist, p.tags, p.skills, p.companies
          FROM {candidates} c JOIN forest f USING (network_id, person_id) JOIN {people} p USING (network_id, person_id) WHERE c.rank <= 10)"""


BUCKETS = """buckets AS (
  WITH ind AS (SELECT *, row_number() OVER (PARTITION BY goal_id ORDER BY combined DESC, person_id) AS place FROM ranked WHERE kind = 'indirect'),
       con AS (SELECT *, row_number() OVER (PARTITION BY goal_id ORDER BY strengths[1] DESC, combined DESC, person_id) AS place FROM ranked WHERE kind <> 'indirect'),
       wish AS (SELECT *, row_number() OVER (PARTITION BY goal_id ORDER BY combined DESC, person_id) AS place FROM ranked WHERE is_wishlist),
       com AS (SELECT * REPLACE (row_number() OVER (PARTITION BY goal_id ORDER BY combined DESC, person_id) AS place)
               FROM (SELECT * FROM ind WHERE place <= 5 UNION ALL SELECT * FROM con))
  SELECT 'indirect' AS bucket, * FROM ind WHERE place <= 5 UNION ALL SELECT 'contacted', * FROM con WHERE place <= 10
  UNION ALL SELECT 'wishlist', * FROM wish WHERE place <= 5 UNION ALL SELECT 'combined', * FROM com WHERE place <= 5)"""


def with_tables(sql: str) -> str:
    """Put the shared tables a query names in front of it.

    A line ``--forest hops floor [legs]`` and the word ``ranked`` bring in the path tables.
    """
    import re

    head = re.match(r"\s*--forest (\d+) (\d+)(?: (\w+))?\n", sql)
    forest = ""
    needed: list[str] = []
    if head:
        sql = sql[head.end():]
        forest = forest_ctes(int(head[1]), int(head[2]), head[3] or "hop")
        if re.search(r"\branked\b", sql):
            forest += ", " + ranked_ctes()

    def visit(name: str) -> None:
        if name in needed:
            return
        for dep in _CTES[name][0]:
            visit(dep)
        needed.append(name)

    text = sql + " " + forest
    for name in _CTES:
        if re.search(rf"\b{name}\b", text):
            visit(name)
    parts = [f"{n} AS ({_CTES[n][1]})" for n in needed]
    if forest:
        parts.append(forest)
    extra = re.match(r"\s*WITH (RECURSIVE )?(.*)", sql, re.S)
    if extra:
        return "WITH RECURSIVE " + ", ".join([*parts, extra[2]])
    return ("WITH RECURSIVE " + ", ".join(parts) + "\n" if parts else "") + sql
