import os
import random

from conftest import edge_frame, people_frame
from test_paths import reference_forest

from tieweave.operators.forest import path_forest
from tieweave.session import work_path

ME = 1


def _me(spark):
    return spark.createDataFrame([("n", ME)], "network_id string, me_id long")


def _rows(df):
    return {r.person_id: (list(r.path), list(r.strengths), r.path_strength, r.kind) for r in df.collect()}


def test_companies_stand_for_all_their_pairs(spark):
    rng = random.Random(8)
    n = 40
    companies = {i: rng.sample(["a", "b", "c", "d", " e "], rng.choice([0, 1, 1, 2])) for i in range(2, n)}
    edges = {}
    for _ in range(30):
        a, b = sorted(rng.sample(range(2, n), 2))
        edges[(a, b)] = rng.randrange(1, 6)
    for i in rng.sample(range(2, n), 6):
        edges[(ME, i)] = rng.randrange(1, 6)
    stored = [((b, a) if rng.random() < 0.5 else (a, b), s) for (a, b), s in edges.items()]
    pairs = [
        (a, b, 4) for a in range(2, n) for b in range(a + 1, n)
        if (a, b) not in edges and {c.strip() for c in companies[a]} & {c.strip() for c in companies[b]}
    ]
    people = people_frame(spark, [{"person_id": ME, "is_me": True, "companies": ["a"]}, *[{"person_id": i, "companies": c} for i, c in companies.items()]])
    rows = [(*p, s) for p, s in stored]
    for hops, floor in ((3, 4), (2, 2)):
        over = path_forest(edge_frame(spark, rows), _me(spark), hops, floor, legs_per_slice=3, people=people, over_companies=True)
        spelled = path_forest(edge_frame(spark, rows + pairs), _me(spark), hops, floor)
        assert _rows(over) == _rows(spelled)
        assert {k: v[0] for k, v in _rows(over).items()} == {k: list(v[0]) for k, v in reference_forest(rows + pairs, hops, floor).items()}


def test_chain_ends_where_its_cost_does(spark):
    chain = [(i, i + 1, 5) for i in range(1, 10_000)]
    got = _rows(path_forest(edge_frame(spark, chain), _me(spark)))
    assert sorted(got) == [2, 3, 4] and got[4][0] == [1, 2, 3, 4]


def test_costly_contact_looks_beyond_the_limit(spark):
    # The weak contact has a cheaper way of six legs, which is too long: fewest legs take its place.
    rows = [(1, 9, 1), (1, 2, 5), (2, 3, 5), (3, 4, 5), (4, 5, 5), (5, 6, 5), (6, 9, 5)]
    got = _rows(path_forest(edge_frame(spark, rows), _me(spark)))
    assert got[9] == ([1, 9], [1], 1, "weak") and got[6][0] == [1, 9, 6]


def test_nobody_leads_through_missing_people(spark):
    people = people_frame(spark, [{"person_id": ME, "is_me": True}, *[{"person_id": i} for i in (3, 4, 5)]])
    rows = [(1, 2, 5), (2, 3, 5), (1, 4, 3), (4, 5, 3)]
    assert sorted(_rows(path_forest(edge_frame(spark, rows), _me(spark), people=people))) == [4, 5]
    assert path_forest(edge_frame(spark, rows), _me(spark), people=people.filter("person_id > 3"), over_companies=True).count() == 0


def test_written_rounds_are_removed(spark):
    path_forest(edge_frame(spark, [(1, 2, 5), (2, 3, 4)]), _me(spark)).count()
    folder = work_path(spark, "scratch")
    assert not os.path.isdir(folder) or not os.listdir(folder)


def test_no_edges_and_no_owner(spark):
    assert path_forest(edge_frame(spark, []), _me(spark)).count() == 0
    assert path_forest(edge_frame(spark, [(1, 2, 3)]), _me(spark).filter("false")).count() == 0
