"""Work that follows the input: the rows that a plan makes on its way, on inputs with large groups."""

from conftest import edge_frame, people_frame

from tieweave.operators import paths as P


def made_rows(df):
    """Rows out of every step of the plan that ran for ``df``, by the name of the step."""
    df.collect()

    def steps(plan):
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            yield from steps(plan.executedPlan())
        elif name.endswith("QueryStageExec"):
            yield from steps(plan.plan())
        else:
            rows = plan.metrics().get("numOutputRows")
            yield name, rows.get().value() if rows.isDefined() else 0
            for i in range(plan.children().size()):
                yield from steps(plan.children().apply(i))

    return list(steps(df._jdf.queryExecution().executedPlan()))


def test_a_name_typed_often_is_looked_up_once(spark):
    """60 namesakes and 60 requests for them: no step pairs the one with the other."""
    people = people_frame(spark, [{"person_id": i, "name": "Ann" if i < 60 else f"Bob {i}"} for i in range(120)])
    schema = "request_id long, network_id string, typed string"
    asked = spark.createDataFrame([(i, "n", "ANN" if i < 60 else "bob") for i in range(120)], schema)
    rows = P.resolve_names(asked, people)
    assert {(r.typed, r.person_id, r.exact, r.same_name) for r in rows.collect()} == {("ANN", 0, True, 60), ("bob", 100, False, 0)}
    assert max(n for _, n in made_rows(rows)) <= 240


def test_endpoints_are_not_broadcast_by_the_size_of_their_files(spark, tmp_path):
    """Files of names are small: 60,000 people would be sent through the driver for every join."""
    many = spark.range(60_000).selectExpr("'n' AS network_id", "id AS person_id", "concat('Person ', id) AS name", "false AS is_me")
    many.write.parquet(str(tmp_path / "people"))
    people = spark.read.parquet(str(tmp_path / "people"))
    asked = people.selectExpr("person_id AS request_id", "network_id", "upper(name) AS start_typed", "'person 7' AS end_typed")
    ends = P.resolve_endpoints(asked, people)
    assert ends.count() == 59_999
    assert not [(s, n) for s, n in made_rows(ends) if s == "BroadcastExchangeExec" and n > 100]


def test_the_contacts_of_a_hub_are_not_listed_for_every_request(spark):
    """An owner with 400 contacts asks for 100 of them: as many rows as the contacts' own few edges give."""
    edges = [(0, i, 3) for i in range(1, 401)] + [(i, i + 1, 4) for i in range(1, 400)]
    schema = "request_id long, network_id string, source_id long, target_id long"
    asked = [(i, "n", 0, i) for i in range(1, 101)]
    ahead = P.paths_between(spark.createDataFrame(asked, schema), edge_frame(spark, edges))
    back = P.paths_between(spark.createDataFrame([(i, n, b, a) for i, n, a, b in asked], schema), edge_frame(spark, edges))
    key = lambda rows, turn: sorted((r.request_id, r.total, tuple(r.path)[::turn]) for r in rows if len(r.path) == 2)
    assert key(ahead.collect(), 1) == key(back.collect(), -1)
    assert {r.path[0] for r in ahead.collect()} == {0} and {r.path[-1] for r in back.collect()} == {0}
    assert max(n for _, n in made_rows(ahead)) < 5_000


def test_an_import_makes_no_edges_before_they_are_asked_for(spark, monkeypatch):
    """500 people of one firm: 124,750 pairs, which people, statistics and unresolved peers do not need."""
    from tieweave.plans import building
    from tieweave.sources import contacts as C

    monkeypatch.setattr(building, "with_edge_ids", lambda *_: (_ for _ in ()).throw(AssertionError("edges made")))
    rows = spark.range(500).selectExpr("'n' AS network_id", "id AS seq", "concat('P', id) AS `姓名`", "'Firm' AS `公司`", "if(id = 3, 'Zed', null) AS `认识`")
    out = building.build_network(C.clean_profiles(C.normalise_headers(rows)[0]), people_frame(spark, [{"person_id": 1, "is_me": True, "name": "Me"}]))
    assert [(r.name, r.peer) for r in out.unresolved.collect()] == [("P3", "Zed")] and out.people.count() == 501
    assert (out.stats.first().people, out.stats.first().colleague_edges) == (500, 124_750)
    assert max(n for _, n in made_rows(out.stats)) < 10_000


def test_equal_sets_of_many_companies_are_paired_once(spark):
    """300 people with the same 12 companies and 2 with one of them: one pair of sets, not one for every two people."""
    from tieweave.operators import analytics as A

    many = [f"c{i}" for i in range(12)]
    people = people_frame(spark, [{"person_id": i, "companies": many if i < 300 else ["c3"]} for i in range(302)])
    row = A.clique_summary(people)
    assert (row.first().companies, row.first().pairs) == (12, 302 * 301 // 2)
    assert max(n for _, n in made_rows(row)) < 10_000


def test_restored_texts_of_a_network_that_numbers_ten_thousand(spark, tmp_path):
    """There P9999 is somebody's token, and the SQL has it stay as one that the dictionary does not hold."""
    import os
    import sys

    sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
    import check
    from __spark_entry__ import oracle_sql

    for t in check.TABLES:
        if t != "customer":
            (tmp_path / f"{t}.parquet").symlink_to(f"/root/testdata/sf0.001/{t}.parquet")
    con = check.duckdb.connect()
    con.execute(f"""COPY (SELECT i AS c_custkey, 'Customer#' || lpad(CAST(i AS VARCHAR), 9, '0') AS c_name, 2::INTEGER AS c_nationkey, 1.0e0 AS c_acctbal, 'FURNITURE' AS c_mktsegment
        FROM range(10050) r(i)) TO '{tmp_path}/customer.parquet' (FORMAT parquet)""")
    text, _, fine = check.compare(spark, check.duck(str(tmp_path)), str(tmp_path), "b19_restored", oracle_sql()["b19_restored"])
    assert fine, text


def test_pairs_of_colleagues_are_made_without_telling_them_apart_afterwards(spark):
    """400 people of one firm, half of them of a second one: 79,800 pairs, none of which is grouped."""
    from tieweave.operators import analytics as A

    pairs = A.colleague_pairs(people_frame(spark, [{"person_id": i, "companies": ["Firm", "Club"][: 1 + i % 2]} for i in range(400)]))
    assert pairs.distinct().count() == pairs.count() == 79_800
    assert max(n for s, n in made_rows(pairs) if "Aggregate" in s or "Exchange" in s) < 2_000


def test_order_lines_are_paired_once_and_only_within_a_nation(spark):
    """60,000 lines: with no broadcast one join of the person table sees them all, and no grouping of the edge table."""
    from tieweave.sources import testbed as B

    sf, before = "/root/testdata/sf0.01", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    lines = B.raw(spark, sf, "lineitem").count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        person, edge = made_rows(B._person(spark, sf)), made_rows(B._edge(spark, sf))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sum(n > 0.8 * lines for s, n in person if s.endswith("JoinExec")) == 1
    assert max(n for s, n in edge if "Aggregate" in s) < 0.2 * lines


def test_texts_are_taken_apart_once_for_many_words(spark):
    """200 texts of 600 letters (F20): what is kept of their runs are those that a word has."""
    from pyspark.sql import functions as F
    from tieweave.operators.substring import contained_terms

    texts = spark.range(200).select(F.lit("n").alias("network_id"), "id", F.concat_ws("", F.transform(F.sequence(F.lit(1), F.lit(600)), lambda i: F.char(97 + F.pmod(F.xxhash64("id", i), F.lit(26))))).alias("text"))
    terms = spark.createDataFrame([("n", "abc"), ("n", "xyz")], "network_id string, term string")
    found = contained_terms(texts, terms, ["network_id"], ["id"], limit=0)
    assert sum(n for s, n in made_rows(found) if s == "GenerateExec") < 1_000
    assert sorted(map(tuple, found.collect())) == sorted(("n", r.id, t) for r in texts.collect() for t in ("abc", "xyz") if t in r.text)


def test_long_texts_of_few_people_do_not_share_a_file(spark):
    """The suppliers' texts (F20, F22): every task that reads people gets some of them."""
    from pyspark.sql import functions as F
    from tieweave.sources import testbed as B

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        people = B.person(spark, "/root/testdata/./sf0.01")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert people.filter(F.col("person_id") >= B.SUPPLIER_BASE).select(F.input_file_name()).distinct().count() == 4


def test_paths_and_people_that_no_goal_asks_for_do_not_move(spark):
    """20,000 people, 30 of them found (F21, F25, F28)."""
    from tieweave.plans.goal_search import ranked_results

    people = spark.range(20_000).selectExpr(
        "'n' AS network_id", "id AS person_id", "concat('P', id) AS name", "id = 0 AS is_me", "false AS is_wishlist",
        *[f"array('x') AS {c}" for c in ("tags", "skills", "companies")])
    forest = spark.range(20_000).selectExpr("'n' AS network_id", "id AS person_id", "1 AS hops", "array(0L, id) AS path", "array(4) AS strengths", "4 AS path_strength", "'direct' AS kind")
    found = spark.range(1, 31).selectExpr("7L AS goal_id", "'n' AS network_id", "id AS person_id", "1.0D AS score", "id AS rank")
    rows = ranked_results(found, forest, people)
    assert rows.count() == 30
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = ranked_results(found, forest, people)
        assert max(n for s, n in made_rows(rows) if "Exchange" in s or s == "SortExec" or "Join" in s) <= 60
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_highlights_read_the_results_once(spark):
    """The search behind them is not run for people and again for edges (F25)."""
    results = spark.range(5).selectExpr("id AS goal_id", "'n' AS network_id", "array(0L, id + 1) AS path")
    rows = P.highlights(results)
    assert rows.count() == 15
    assert not [s for s, _ in made_rows(rows) if s == "RangeExec"]


def test_values_of_one_person_are_told_apart_without_a_shuffle(spark):
    """Needs and offers (F24): a person is one row."""
    from tieweave.operators import matching as M

    people = people_frame(spark, [{"person_id": i, "tags": ["A", "a", ""], "skills": ["b"], "needs": ["N", "n"]} for i in range(50)])
    for rows, n in ((M.offers_of(people), 100), (M.needs_of(people), 50)):
        assert rows.count() == n
        assert not [s for s, _ in made_rows(rows) if "Exchange" in s or "Aggregate" in s]


def test_answers_are_parsed_once(spark):
    """Both texts of proposed edges get their names back without a second look at the answers (F23, F27)."""
    from tieweave.operators import enrichment as E, pseudonyms as N

    people = people_frame(spark, [{"person_id": 1, "name": "Me", "is_me": True}, {"person_id": 2, "name": "A"}, {"person_id": 3, "name": "B"}])
    raw = '{"edges": [{"a": "P001", "b": "P002", "context": "met P001", "rationale": "P002 and P777"}, {"a": "P001", "b": "P001"}]}'
    answers = spark.createDataFrame([("n", 9, raw)], "network_id string, request_id long, raw string")
    rows = E.parse_edge_answers(answers, N.dictionary(people))
    row = rows.collect()[0]
    assert rows.count() == 1 and (row.low_id, row.high_id, row.context, row.rationale) == (2, 3, "met A", "B and P777")
    assert "parse_json" not in rows._jdf.queryExecution().optimizedPlan().toString()
