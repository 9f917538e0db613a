import heapq
import itertools
import random

import pytest
from conftest import edge_frame, people_frame
from pyspark.sql import functions as F

from tieweave.operators import paths as P
from tieweave.operators.folding import undirected
from tieweave.plans.goal_search import ranked_results

ME = 1


def forest(spark, edges, hops=3, floor=4, **kw):
    me = spark.createDataFrame([("n", ME)], "network_id string, me_id long")
    rows = P.path_forest(edge_frame(spark, edges), me, hops, floor, **kw).collect()
    return {r.person_id: (list(r.path), r.path_strength, r.kind) for r in rows}


def test_two_hops(spark):
    assert forest(spark, [(1, 2, 5), (2, 3, 4)])[3] == ([1, 2, 3], 9, "indirect")


def test_unreachable_person_is_left_out(spark):
    assert 3 not in forest(spark, [(1, 2, 3)])


def test_kinds(spark):
    got = forest(spark, [(1, 2, 4), (1, 3, 1), (1, 4, 3), (4, 5, 3)])
    assert (got[2][2], got[3][2], got[5][2]) == ("direct", "weak", "indirect")


def test_strong_direct_contact_ranks_first(spark):
    f = P.path_forest(edge_frame(spark, [(1, 2, 4), (1, 3, 3), (3, 4, 3)]), spark.createDataFrame([("n", ME)], "network_id string, me_id long"))
    people = people_frame(spark, [{"person_id": 1, "is_me": True}, *[{"person_id": i} for i in (2, 3, 4)]])
    cand = spark.createDataFrame([(1, "n", 2, 0.9, 1), (1, "n", 4, 0.9, 2)], "goal_id long, network_id string, person_id long, score double, rank long")
    rows = ranked_results(cand, f, people).orderBy(F.desc("combined")).collect()
    assert [r.person_id for r in rows] == [2, 4]


def test_weak_edge_is_avoided_where_a_detour_exists(spark):
    assert forest(spark, [(1, 2, 1), (1, 3, 4), (3, 2, 4)], floor=2)[2] == ([1, 3, 2], 8, "indirect")


def test_weak_edge_is_used_where_nothing_else_exists(spark):
    assert forest(spark, [(1, 2, 1)], floor=2)[2] == ([1, 2], 1, "weak")


def test_raised_floor(spark):
    assert forest(spark, [(1, 2, 2), (1, 3, 4), (3, 2, 4)], floor=3)[2][0] == [1, 3, 2]


def test_too_long_chain_falls_back_to_fewest_hops(spark):
    chain = [(1, 2, 1), (1, 3, 5), (3, 4, 5), (4, 5, 5), (5, 6, 5), (6, 2, 5)]
    got = forest(spark, chain, floor=2)
    assert got[2] == ([1, 2], 1, "weak")
    assert 6 in got and got[6][0] in ([1, 2, 6],)


def test_cheaper_of_two_bridges(spark):
    assert forest(spark, [(1, 2, 5), (2, 4, 4), (1, 3, 5), (3, 4, 3)])[4][0] == [1, 2, 4]


def test_latest_stored_direction_wins(spark):
    rows = undirected(edge_frame(spark, [(1, 2, 5), (2, 1, 2)])).collect()
    assert [(r.low_id, r.high_id, r.strength) for r in rows] == [(1, 2, 2)]


def reference_forest(edges, hops, floor):
    """Plain Dijkstra over (cost, hops, path), then breadth first where it is too long."""
    adj = {}
    for a, b, s in edges:
        cost = 60 // s * (hops * hops * 4 if ME in (a, b) and s < floor else 1)
        adj.setdefault(a, {})[b] = adj.setdefault(b, {})[a] = (cost, s)

    def search(weight):
        best, heap = {}, [((0, 0, (ME,)), ME)]
        while heap:
            key, node = heapq.heappop(heap)
            if node in best:
                continue
            best[node] = key
            for other, (cost, _) in adj.get(node, {}).items():
                if other not in best:
                    heapq.heappush(heap, ((key[0] + weight(cost), key[1] + 1, key[2] + (other,)), other))
        return best

    cheap, few = search(lambda c: c), search(lambda c: 1)
    out = {}
    for node, key in cheap.items():
        key = key if key[1] <= hops else few[node]
        if 1 <= key[1] <= hops:
            out[node] = (list(key[2]), sum(adj[a][b][1] for a, b in zip(key[2], key[2][1:])))
    return out


@pytest.mark.parametrize("seed,hops,floor", [(1, 3, 4), (2, 2, 4), (3, 4, 5)])
def test_random_graphs_match_plain_search_even_with_sliced_hubs(spark, seed, hops, floor):
    rng = random.Random(seed)
    pairs = {(1, i) for i in range(2, 30) if rng.random() < 0.5}
    while len(pairs) < 70:
        a, b = sorted(rng.sample(range(1, 40), 2))
        pairs.add((a, b))
    edges = [(a, b, rng.randint(1, 5)) for a, b in sorted(pairs)]
    got = forest(spark, edges, hops, floor, legs_per_slice=3)
    assert {k: (v[0], v[1]) for k, v in got.items()} == reference_forest(edges, hops, floor)


@pytest.mark.parametrize("hops", [1, 2, 3, 4, 5])
def test_paths_between_match_full_enumeration(spark, hops):
    rng = random.Random(hops)
    edges = [(a, b, rng.randint(1, 5)) for a, b in itertools.combinations(range(1, 10), 2) if rng.random() < 0.5]
    strength = {frozenset(e[:2]): e[2] for e in edges}

    def walk(path):
        if path[-1] == 9:
            yield path
        elif len(path) <= hops:
            for n in range(1, 10):
                if n not in path and frozenset((path[-1], n)) in strength:
                    yield from walk([*path, n])

    scored = []
    for p in walk([2]):
        total = sum(strength[frozenset(x)] for x in zip(p, p[1:]))
        scored.append((-total / (len(p) - 1), len(p), p, total))
    want = [(p, t) for _, _, p, t in sorted(scored)[:4]]
    asked = spark.createDataFrame([(7, "n", 2, 9), (8, "n", 3, 3)], "request_id long, network_id string, source_id long, target_id long")
    rows = P.paths_between(asked, edge_frame(spark, edges), hops, 4).orderBy("rank").collect()
    assert [(list(r.path), r.total) for r in rows] == want


def test_names_resolve_exactly_then_by_part(spark):
    people = people_frame(spark, [{"person_id": 1, "is_me": True, "name": "Zed"}, {"person_id": 2, "name": "Ann Lee"}, {"person_id": 3, "name": "ann"}, {"person_id": 4, "name": "ANN"}])
    asked = spark.createDataFrame([(1, "n", "ann"), (2, "n", " Lee "), (3, "n", "nobody")], "request_id long, network_id string, typed string")
    rows = {r.request_id: (r.person_id, r.exact, r.same_name) for r in P.resolve_names(asked, people).collect()}
    assert rows == {1: (4, True, 2), 2: (2, False, 0)}
