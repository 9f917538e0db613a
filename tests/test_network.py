import itertools
import random

from conftest import edge_frame, people_frame
from pyspark.sql import functions as F

from tieweave.sources.contacts import parse_alias_rules
from tieweave.operators import aliases as L, analytics as A, enrichment as E, matching as M, pseudonyms as N, validation as D
from tieweave.operators.folding import EDGE_KEY, upsert_edges


def test_edge_fold_does_not_depend_on_order_or_grouping(spark):
    rng = random.Random(1)
    prio = {"manual": 2, "colleague_inferred": 1, "ai_inferred": 0}
    log = [("n", rng.randint(1, 3), rng.randint(4, 6), rng.randint(1, 5), f"c{i}", "yearly", rng.choice(list(prio)), i) for i in range(200)]
    want = {}
    for row in log:  # one after the other, as a store would
        old = want.get(row[1:3])
        if old is None or prio[row[6]] >= prio[old[6]]:
            want[row[1:3]] = row
    schema = "network_id string, source_id long, target_id long, strength int, context string, frequency string, source string, seq int"
    rng.shuffle(log)
    df = spark.createDataFrame(log, schema)
    once = upsert_edges(df)
    parts = upsert_edges(df.filter("seq % 2 = 0"), True).unionByName(upsert_edges(df.filter("seq % 2 = 1"), True))
    for out in (once, upsert_edges(parts)):
        assert {(r.source_id, r.target_id): (r.strength, r.context, r.source) for r in out.collect()} == {k: (v[3], v[4], v[6]) for k, v in want.items()}
    assert EDGE_KEY == ["network_id", "source_id", "target_id"]


def companies(spark, seed, most):
    rng = random.Random(seed)
    return {i: rng.sample([f"c{j}" for j in range(14)], rng.randint(0, most)) for i in range(2, 60)}


def brute_pairs(held):
    return {(a, b) for a, b in itertools.combinations(sorted(held), 2) if set(held[a]) & set(held[b])}


def test_colleague_pairs_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(A, "BLOCK", 4)
    held = companies(spark, 2, 3)
    people = people_frame(spark, [{"person_id": 1, "is_me": True, "companies": ["c1"]}, *[{"person_id": i, "companies": c} for i, c in held.items()]])
    got = [(r.low_id, r.high_id) for r in A.colleague_pairs(people).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(held)


def test_clique_counts_by_inclusion_and_exclusion(spark, monkeypatch):
    for limit, most in ((10, 4), (2, 6)):
        monkeypatch.setattr(A, "MAX_LIGHT", limit)
        held = companies(spark, limit, most)
        people = people_frame(spark, [{"person_id": i, "companies": c} for i, c in held.items()])
        row = A.clique_summary(people).first()
        sizes = [sum(c in v for v in held.values()) for c in {c for v in held.values() for c in v}]
        assert (row.companies, row.pairs) == (sum(s >= 2 for s in sizes), len(brute_pairs(held)))


def test_introductions_match_brute_force(spark):
    rng = random.Random(4)
    words = ["ai", "fund", "funds", "chip", "law"]
    rows = [{"person_id": i, "name": f"N{rng.randint(0, 30):02d}", "needs": rng.sample(words, rng.randint(0, 2)), "tags": [w.upper() for w in rng.sample(words, rng.randint(0, 2))],
             "bio": rng.choice([None, "does LAW and chip things"])} for i in range(2, 40)]
    people = people_frame(spark, [{"person_id": 1, "is_me": True, "needs": ["ai"], "tags": ["ai"]}, *rows])
    order = sorted(rows, key=lambda r: (r["name"], r["person_id"]))
    want = []
    for s in order:
        for p in order:
            if s is p:
                continue
            best = None
            for need in s["needs"]:
                for attr in p["tags"]:
                    if need in attr.lower() or attr.lower() in need:
                        best = min(best or (need, 0, attr.lower()), (need, 0, attr.lower()))
                if p["bio"] and need in p["bio"].lower():
                    best = min(best or (need, 1, need), (need, 1, need))
            if best:
                want.append((s["person_id"], p["person_id"], best[0], best[2]))
    for limit in (5, 50):
        got = [(r.seeker_id, r.provider_id, r.need, r.keyword) for r in M.introductions(people, limit).orderBy("place").collect()]
        assert got == want[:limit]


def test_alias_groups_claim_names_in_turn(spark):
    people = people_frame(spark, [{"person_id": i, "companies": [c]} for i, c in enumerate(["国泰君安", "海通证券", "国君", "中金", "X", "Y", "Y", "Z"], 2)])
    file = spark.createDataFrame([("国君集团", "国君", "file", 0, 0), ("国君集团", "X", "file", 0, 1), ("lonely", "Z", "file", 1, 0)], "canonical string, alias string, source string, group_ord int, member_ord int")
    model = spark.createDataFrame([("Y", "X", "model", 0, 0), ("Y", "Z", "model", 0, 1)], file.schema)
    plan = L.plan_merges(people, file.unionByName(L.builtin_rules(spark)).unionByName(model))
    groups = {}
    for r in plan.collect():
        groups.setdefault((r.canonical, r.source, r.headcount), set()).add(r.alias)
    assert groups == {("国君集团", "file", 2): {"国君", "X"}, ("国泰海通证券", "builtin", 2): {"国泰君安", "海通证券"}, ("Y", "model", 3): {"Z"}}
    s = L.merge_summary(people, plan).first()
    assert (s.names_before, s.names_after, s.links_moved, s.names_removed) == (7, 2, 3, 3)
    merged = {r.person_id: r.companies for r in L.merge_companies(people, plan).collect()}
    assert merged[4] == ["国君集团"] and merged[2] == ["国泰海通证券"] and merged[5] == ["中金"] and merged[9] == ["Y"]
    assert [r.company for r in L.residual_names(people, plan).collect()] == ["中金"]


def test_edge_answers(spark):
    people = people_frame(spark, [{"person_id": 1, "is_me": True, "name": "me"}, *[{"person_id": i, "name": n} for i, n in ((2, "Ann"), (3, "Bob"), (4, "Cy"))]])
    raw = """```json
    {"edges": [{"a": "P001", "b": "P002", "strength": 4, "context": "P001 knows P002", "frequency": "Weekly", "rationale": "P001和P002"},
      {"a": "P002", "b": "P001", "strength": 1}, {"a": "P000", "b": "P001"}, {"a": "P003", "b": "P003"}, {"a": "P003", "b": "P777"},
      {"a": "P003", "b": "P001", "strength": true, "frequency": "daily", "context": " "}], "unknown_mentions": ["Mike", "Mike", 3, ""]}
    ```"""
    answers = spark.createDataFrame([("n", 1, raw), ("n", 2, '{"edges": {}}'), ("n", 3, "[]"), ("n", 4, "{")], "network_id string, request_id long, raw string")
    got = E.parse_edge_answers(answers, N.dictionary(people)).orderBy("high_id").collect()
    assert [(r.low_id, r.high_id, r.strength, r.frequency, r.context) for r in got] == [(2, 3, 4, "weekly", "Ann knows Bob"), (2, 4, None, None, None)]
    assert [r.mention for r in E.unknown_mentions(answers).collect()] == ["Mike"]
    assert {r.request_id: r.error for r in E.parsed(answers).collect()} == {1: None, 2: None, 3: "not an object", 4: "not JSON"}


def test_snapshot_scrubs_and_keeps_missing_ids(spark):
    people = people_frame(spark, [{"person_id": 1, "is_me": True}, {"person_id": 2, "name": "Alice", "bio": "tel 13812348888"}, {"person_id": 3, "name": "Bob"}])
    edges = edge_frame(spark, [(1, 2, 4, "mail a.b@c.org"), (2, 3, 3)])
    asked = spark.createDataFrame([(9, "n", 2), (9, "n", 77)], "ticket_id long, network_id string, person_id long")
    rows = {r.person_id: r for r in A.snapshot_people(asked, people, edges).collect()}
    assert (rows[2].bio, rows[2].me_strength, rows[2].me_context, rows[77].missing) == ("tel 138****8888", 4, "mail a***@c.org", True)
    assert [(r.person_id, r.neighbour) for r in A.snapshot_neighbours(asked, people, edges).collect()] == [(2, "Bob")]


def test_edge_page_order(spark):
    people = people_frame(spark, [{"person_id": 1, "is_me": True, "name": "Z"}, {"person_id": 2, "name": "B"}, {"person_id": 3, "name": "A"}])
    named = A.named_edges(edge_frame(spark, [(2, 3, 5), (1, 2, 1), (1, 3, 4), (1, 99, 5)]), people)
    rows = A.edge_page(named, 0, 2).orderBy("place").collect()
    assert [(r.source_id, r.target_id, r.total) for r in rows] == [(1, 3, 3), (1, 2, 3)]
    assert A.filter_edges(named, text=" a ", include_me=False).count() == 1


def test_feedback_rules(spark):
    form = {"type": "feature", "title": "long enough", "submitter": "x", "severity": "nice", "involved": [1], "screenshots": [], "want_to_do": None, "did": None, "actual": None,
            "expected": None, "history": None, "user_story": "当我打开图的时候，我希望看到全部", "acceptance": ["- shows all"]}
    bad = {**form, "type": "bug", "title": "short", "screenshots": ["text/html"], "want_to_do": "a", "did": "b", "actual": "c", "expected": "d", "history": "never"}
    schema = "type string, title string, submitter string, severity string, involved array<bigint>, screenshots array<string>, want_to_do string, did string, actual string, expected string, history string, user_story string, acceptance array<string>"
    rows = spark.createDataFrame([tuple(f.values()) for f in (form, bad)], schema)
    assert [r.violations for r in D.check_feedback(rows).orderBy(F.desc("type")).collect()] == [[], ["title_length", "screenshot_type", "history"]]


def test_groups_of_two_answers_and_files_stay_apart(spark):
    people = people_frame(spark, [{"person_id": i, "companies": [c]} for i, c in enumerate(["AA", "aa1", "BB", "bb1", "CC", "cc1"], 1)])
    other = people.withColumn("network_id", F.lit("m"))
    answers = spark.createDataFrame(
        [("n", '{"groups": [{"canonical": "AA", "aliases": ["aa1"]}]}'), ("n", '{"groups": [{"canonical": "BB", "aliases": ["bb1"]}]}'), ("m", '{"groups": [{"canonical": "CC", "aliases": ["cc1"]}]}')],
        "network_id string, raw string",
    )
    plan = L.plan_merges(people.unionByName(other), L.parse_clusters(answers)).collect()
    assert {(r.network_id, r.canonical, r.alias) for r in plan} == {("n", "AA", "aa1"), ("n", "BB", "bb1"), ("m", "CC", "cc1")}
    files = spark.createDataFrame([('{"AA": ["aa1"]}',), ('{"BB": ["bb1"]}',)], "raw string")
    rules = parse_alias_rules(files).unionByName(L.builtin_rules(spark))
    plan = L.plan_merges(people, rules).collect()
    assert {(r.canonical, r.alias) for r in plan} == {("AA", "aa1"), ("BB", "bb1")}


def test_link_rows_keep_what_the_canonical_link_tells(spark):
    from tieweave.operators.aliases import merged_link_rows

    links = spark.createDataFrame(
        [("n", 1, "Acme", "cto", False), ("n", 1, "Acme Inc", "cfo", True), ("n", 2, "Acme Ltd", None, None), ("n", 2, "Acme Inc", "ceo", True),
         ("n", 3, "Other", "x", True), ("n", 3, None, "y", True), ("m", 1, "Acme Inc", "z", True), ("n", 4, "Acme Inc", "b", True), ("n", 4, "Acme Inc", "a", True)],
        "network_id string, person_id long, company string, role string, is_current boolean")
    plan = spark.createDataFrame([("n", "Acme", "Acme Inc", "file", 3, True, 0), ("n", "Acme", "Acme Ltd", "file", 3, True, 1)],
                                 "network_id string, canonical string, alias string, source string, headcount long, canonical_present boolean, member_ord int")
    got = {(r.network_id, r.person_id, r.company): r.role for r in merged_link_rows(links, plan).collect()}
    assert got == {("n", 1, "Acme"): "cto", ("n", 2, "Acme"): "ceo", ("n", 3, "Other"): "x", ("n", 3, None): "y", ("m", 1, "Acme Inc"): "z", ("n", 4, "Acme"): "a"}
    assert merged_link_rows(links.limit(0), plan).count() == 0
