"""Edges between colleagues: the same ids as sorting all of them gives, without moving the pairs."""

import random

import pytest
from conftest import edge_frame, people_frame
from pyspark.sql import functions as F
from test_growth import made_rows

from tieweave.operators import analytics as A, colleagues as C
from tieweave.plans import building as P


def expected(people, edges):
    """Ids by plain Python: known directions keep theirs, free pairs follow in the order of both ids."""
    known = {(s, t): i for i, (s, t, *_) in enumerate(edges, 1)}
    pairs = sorted((a, b) for a in people for b in people if a < b and set(people[a]) & set(people[b]))
    fresh = [p for p in pairs if p not in known]
    return known | {p: len(edges) + i for i, p in enumerate(fresh, 1)}


@pytest.mark.parametrize("block, listed", [(2_048, 64), (3, 64), (3, 2), (2_048, 0)])
def test_ids_of_pairs_follow_the_sorted_order(spark, monkeypatch, block, listed):
    monkeypatch.setattr(A, "BLOCK", block)
    monkeypatch.setattr(C, "LISTED", listed)
    rng = random.Random(block + listed)
    people = {i: rng.sample(["a", "b", "c", " a"], rng.choice([0, 1, 1, 1, 2, 3])) for i in range(1, 31)}
    trimmed = {i: [c.strip() for c in cs] for i, cs in people.items()}
    edges = sorted({(rng.randint(1, 30), rng.randint(1, 30), 3) for _ in range(60)})
    frame = people_frame(spark, [{"person_id": i, "companies": c} for i, c in people.items()])
    got = {(r.source_id, r.target_id): r.edge_id for r in P.infer_colleagues(frame, edge_frame(spark, edges)).collect()}
    assert got == expected(trimmed, edges)
    folded = P.fold_colleagues(frame, edge_frame(spark, edges)).collect()
    assert sorted((r.source_id, r.target_id) for r in folded) == sorted(got)
    assert [(r.low_id, r.high_id) for r in A.colleague_pairs(frame).orderBy("low_id", "high_id").collect()] == sorted(
        (a, b) for a in people for b in people if a < b and set(trimmed[a]) & set(trimmed[b]))


@pytest.mark.parametrize("block, listed", [(2_048, 64), (3, 2)])
def test_written_and_inferred_edges_are_numbered_together(spark, monkeypatch, block, listed):
    """New directions, to colleagues and to others, before and behind them, with and without known edges."""
    monkeypatch.setattr(A, "BLOCK", block)
    monkeypatch.setattr(C, "LISTED", listed)
    rng = random.Random(7)
    people = {i: rng.sample(["a", "b", "c"], rng.choice([0, 1, 1, 1, 2])) for i in range(1, 25)}
    frame = people_frame(spark, [{"person_id": i, "companies": c} for i, c in people.items()])
    new = sorted({(rng.randint(-1, 24), rng.randint(1, 24)) for _ in range(40)})
    writes = spark.createDataFrame([("n", s, t, 3, "x", "yearly", rng.choice(["manual", "ai_inferred"]), (0, i)) for i, (s, t) in enumerate(new)],
                                   "network_id string, source_id long, target_id long, strength int, context string, frequency string, source string, seq struct<step int, at long>")
    pairs = {(a, b) for a in people for b in people if a < b and set(people[a]) & set(people[b])}
    out = P.Built(frame, writes, 4, None, None, None, None)
    rows = out.edges.collect()
    assert [(r.source_id, r.target_id) for r in sorted(rows, key=lambda r: r.edge_id)] == sorted(pairs | set(new))
    assert sorted(r.edge_id for r in rows) == list(range(1, len(rows) + 1))
    manual = {(r.source_id, r.target_id) for r in writes.filter("source = 'manual'").collect()}
    assert {(r.source_id, r.target_id) for r in rows if r.source == "colleague_inferred"} == pairs - manual
    assert sorted((r.source_id, r.target_id, r.source) for r in out.folded.collect()) == sorted((r.source_id, r.target_id, r.source) for r in rows)


def test_pairs_of_colleagues_are_not_shuffled(spark):
    """400 people of one firm: 79,800 pairs, of which no step that writes or sorts sees one."""
    frame = people_frame(spark, [{"person_id": i, "companies": ["Firm"]} for i in range(400)])
    edges = edge_frame(spark, [(0, 5, 3), (3, 2, 3), (7, 900, 2)])
    for df in (A.colleague_pairs(frame), P.fold_colleagues(frame, edges), P.infer_colleagues(frame, edges)):
        moved = [n for s, n in made_rows(df.withColumn("v", F.lit(1))) if not s.endswith("JoinExec") and s not in ("FilterExec", "ProjectExec")]
        assert max(moved) < 2_000


def test_pairs_of_people_with_several_companies_are_not_sorted(spark):
    """400 people of one firm, each in a club of ten too (F1): only colleagues of the clubs move, as lists."""
    frame = people_frame(spark, [{"person_id": i, "companies": ["Firm", f"Club {i % 40}"]} for i in range(400)] + [{"person_id": 400 + i, "companies": [f"Club {i}"]} for i in range(40)])
    edges = edge_frame(spark, [(0, 5, 3), (3, 2, 3), (7, 900, 2), (9, 49, 1)])
    out = P.infer_colleagues(frame, edges)
    got = {(r.source_id, r.target_id): r.edge_id for r in out.collect()}
    people = {i: ["Firm", f"Club {i % 40}"] for i in range(400)} | {400 + i: [f"Club {i}"] for i in range(40)}
    assert got == expected(people, [(0, 5), (3, 2), (7, 900), (9, 49)])
    assert max(n for s, n in made_rows(out) if "Exchange" in s or "Sort" in s or "Window" in s or "Aggregate" in s) < 2_000


def test_lists_longer_than_a_block_are_laid_out_whole(spark, monkeypatch):
    """Colleagues of other companies of one block may be more than a block or a piece (F1)."""
    monkeypatch.setattr(A, "BLOCK", 4)
    monkeypatch.setattr(A, "PIECE", 3)
    people = {i: [f"c{j}" for j in range(5) if i % (j + 2) == 0] for i in range(1, 41)}
    frame = people_frame(spark, [{"person_id": i, "companies": c} for i, c in people.items()])
    edges = [(2, 3, 1), (4, 6, 1), (4, 100, 1), (38, 40, 2), (40, 1, 2)]
    got = {(r.source_id, r.target_id): r.edge_id for r in P.infer_colleagues(frame, edge_frame(spark, edges)).collect()}
    assert got == expected(people, edges)


def test_an_import_leaves_compressed_tables_behind(spark):
    """Rows, people and the best writes (F2) are written by column, and shuffles behind them are let go."""
    from tieweave.session import kept

    people = spark.range(1_000).selectExpr("'n' AS network_id", "id % 7 AS person_id", "repeat('text', 50) AS bio")
    table = kept(people.groupBy("network_id", "person_id", "bio").count())
    assert table.agg(F.sum("count")).first()[0] == 1_000 and table.count() == 7
    assert "FileScan parquet" in table._jdf.queryExecution().executedPlan().toString()


def test_the_owners_are_those_of_the_person_table(spark):
    """An import asks for the owners only (F2): no order and no line is read for them."""
    from tieweave.plans.registered.base import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    plan = t.owners._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, t.owners.collect())) == sorted(map(tuple, t.person.filter("is_me").select(*t.owners.columns).collect()))
    assert "o_orderkey" not in plan and "Join" not in plan


def test_tasks_follow_the_pairs_and_not_the_size_of_the_lists(spark, monkeypatch):
    """300 people of one firm in each of 40 networks, 1,794,000 pairs (F3): their lists are small, their pairs are not put into one task."""
    monkeypatch.setattr(A, "PAIRS", 50_000)
    rows = people_frame(spark, [{"person_id": i, "companies": ["Firm"]} for i in range(300)]).crossJoin(spark.range(40).selectExpr("concat('n', id) AS net"))
    pairs = A.colleague_pairs(rows.drop("network_id").withColumnRenamed("net", "network_id"))
    each = pairs.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in each) == 40 * 300 * 299 // 2
    assert len(each) > 10 and max(r["count"] for r in each) < 400_000
