import random

import numpy as np
import pytest
from conftest import people_frame

from tieweave.operators import rerank as R, retrieval as T
from tieweave.operators.ranking import positions
from tieweave.operators.substring import contained_terms
from tieweave.schema import GOAL
from pyspark.sql import functions as F

CAND = "goal_id long, network_id string, person_id long, score double, rank long"


def goals_frame(spark, rows):
    base = {"goal_id": 1, "network_id": "n", "original": "find", "summary": "", "roles": [], "industries": [], "skills": [], "keywords": [], "cities": [], "vector": None}
    return spark.createDataFrame([tuple({**base, **r}[f] for f in GOAL.fieldNames()) for r in rows], GOAL)


@pytest.mark.parametrize("limit", [5000, 0])
@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_nearest_people_match_brute_force(spark, limit, metric):
    rng = np.random.default_rng(3)
    ids = [*range(40), *range(10**9, 10**9 + 40), *range(65_530, 65_545)]
    vecs = rng.normal(size=(len(ids), 4)).astype("float32")
    nets = ["a" if i % 3 else "b" for i in range(len(ids))]
    emb = spark.createDataFrame([(n, i, v.tolist()) for n, i, v in zip(nets, ids, vecs)], "network_id string, person_id long, vector array<float>")
    asked = [(g, "ab"[g % 2], rng.normal(size=4).astype("float32")) for g in range(6)]
    goals = goals_frame(spark, [{"goal_id": g, "network_id": n, "vector": v.tolist()} for g, n, v in asked])
    got = {}
    for r in T.nearest_people(goals, emb, 7, metric, goals_in_task=limit).orderBy("rank").collect():
        got.setdefault(r.goal_id, []).append(r.person_id)
    for g, n, q in asked:
        d = []
        for net, i, v in zip(nets, ids, vecs):
            if net == n:
                v, w = v.astype(float), q.astype(float)
                d.append((np.sqrt(((v - w) ** 2).sum()) if metric == "l2" else 1 - v @ w / np.linalg.norm(v) / np.linalg.norm(w), i))
        assert got[g] == [i for _, i in sorted(d)[:7]]


@pytest.mark.parametrize("limit", [1000, 0])
def test_contained_terms_match_brute_force_in_both_ways(spark, limit):
    rng = random.Random(5)
    texts = [("xy"[i % 2], i, "".join(rng.choice("ab张é ") for _ in range(rng.randint(0, 60)))) for i in range(60)]
    terms = [("xy"[i % 2], "".join(rng.choice("ab张é") for _ in range(rng.randint(1, 6)))) for i in range(60)] + [("x", "")]
    t = spark.createDataFrame(texts, "network_id string, id long, text string")
    w = spark.createDataFrame(terms, "network_id string, term string")
    got = {(r.network_id, r.id, r.term) for r in contained_terms(t, w, ["network_id"], ["id"], limit).collect()}
    assert got == {(n, i, term) for n, i, text in texts for m, term in terms if n == m and term and term in text}


def test_positions_number_one_huge_group_over_many_slices(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "small").otherwise("hot").alias("g"), (F.col("id") * 7919 % 5003).alias("v"))
    rows = positions(df, ["g"], [F.col("v").desc()], "n").collect()
    for g in ("hot", "small"):
        mine = sorted((r for r in rows if r.g == g), key=lambda r: r.n)
        assert [r.n for r in mine] == list(range(1, len(mine) + 1))
        assert [r.v for r in mine] == sorted((r.v for r in mine), reverse=True)


def test_best_score_is_one_and_needs_do_not_match(spark):
    people = people_frame(spark, [
        {"person_id": 1, "is_me": True, "name": "fund owner"},
        {"person_id": 2, "tags": ["Fund Manager"], "skills": ["quant"]}, {"person_id": 3, "bio": "knows a FUND"}, {"person_id": 4, "needs": ["fund"]},
    ])
    goals = goals_frame(spark, [{"roles": ["fund"], "skills": ["quant", "quant"]}, {"goal_id": 2}])
    rows = T.hybrid_search(goals, people, None).orderBy("rank").collect()
    assert [(r.goal_id, r.person_id) for r in rows] == [(1, 2), (1, 3)]
    assert rows[0].score == 1.0
    hits = {r.person_id: r.hits for r in T.keyword_hits(goals, people).collect()}
    assert hits == {2: 3, 3: 1}


def test_fusion_weights(spark):
    rows = [(1, "n", 10, "vector", 1), (1, "n", 11, "helper", 1), (1, "n", 11, "topic", 2), (1, "n", 12, "topic", 1)]
    got = T.fuse(spark.createDataFrame(rows, "goal_id long, network_id string, person_id long, channel string, rank long"), 10).orderBy("rank").collect()
    top = 1.5 / 61 + 0.3 / 62
    assert [r.person_id for r in got] == [11, 10, 12]
    assert got[1].score == pytest.approx(1.5 / 61 / top) and got[2].score == pytest.approx(0.3 / 61 / top)


def judged(spark, raw, n=3, head=30):
    cand = spark.createDataFrame([(1, "n", 10 + i, 1.0 - i / 10, i + 1) for i in range(n)], CAND)
    answers = spark.createDataFrame([(1, raw)], "goal_id long, raw string")
    return [(r.person_id, round(r.score, 4)) for r in R.judge(cand, answers, head).orderBy("rank").collect()]


def test_judge_promotes_the_right_role(spark):
    raw = '{"ranking": [{"id": "P001", "role": "无关", "score": 0.8}, {"id": "P003", "role": "本人", "score": 0.8}, {"id": "P002", "role": "桥梁", "score": 2}]}'
    assert judged(spark, raw) == [(12, 1.0), (11, 0.625), (10, 0.05)]


@pytest.mark.parametrize("raw", ["not json", "{}", '{"ranking": "x"}', '{"ranking": [{"id": "P999", "role": "本人", "score": 1}]}', None])
def test_unusable_answers_keep_the_order(spark, raw):
    assert judged(spark, raw) == [(10, 1.0), (11, 0.9), (12, 0.8)]


def test_missing_verdicts_and_tail(spark):
    raw = '{"ranking": [{"id": "P001", "role": "??", "score": "0.5"}, {"id": "P002", "score": null, "role": "本人"}, {"id": "P002", "role": "本人", "score": 0.5}, 4]}'
    got = judged(spark, raw, n=4, head=3)
    assert [p for p, _ in got] == [11, 12, 10, 13]
    assert got[3] == (13, 0.7)


def test_pair_scores_drop_unscored_heads_only_in_scored_goals(spark):
    cand = spark.createDataFrame([(g, "n", 10 + i, 1.0 - i / 10, i + 1) for g in (1, 2) for i in range(3)], CAND)
    scores = spark.createDataFrame([(1, 12, 0.9), (1, 10, 0.3)], "goal_id long, person_id long, pair_score double")
    rows = R.pair_scores(cand, scores).orderBy("goal_id", "rank").collect()
    assert [(r.goal_id, r.person_id) for r in rows] == [(1, 12), (1, 10), (2, 10), (2, 11), (2, 12)]


@pytest.mark.parametrize("limit", [5000, 0])
def test_wildcards_of_a_term_stay_within_a_field(spark, limit):
    import re

    texts = {1: "anna\u0001works at acme\u0001oslo", 2: "bob (a.c.m.e)\u0001100% sure\nof it", 3: "", 4: "a_b\u0001axb", 5: "x" * 30_000 + "\u0001ab", 6: "ab\u0001cd"}
    terms = ["a%e", "a_me", "a.c", "b%c", "%", "_", "__%__", "100%it", "a_b", "x%y", "anna", "(a", "works", "acme%oslo", "%%", "a%b%"]
    frame = spark.createDataFrame([("n", k, v) for k, v in texts.items()], "network_id string, person_id long, text string")
    asked = spark.createDataFrame([("n", t) for t in terms] + [("m", "anna")], "network_id string, term string")
    got = {(r.person_id, r.term) for r in contained_terms(frame, asked, ["network_id"], ["person_id"], limit, wildcards=True).collect()}
    like = lambda t: re.compile("".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in t), re.S)
    want = {(k, t) for k, v in texts.items() for t in terms for f in v.split("\u0001") if like(t).search(f)}
    assert got == want
    plain = {(r.person_id, r.term) for r in contained_terms(frame, asked, ["network_id"], ["person_id"], limit).collect()}
    assert plain == {(k, t) for k, v in texts.items() for t in terms if t in v}


def test_weights_of_the_channels(spark):
    people = people_frame(spark, [{"person_id": 1, "tags": ["law"]}, {"person_id": 2, "tags": ["oslo"]}, {"person_id": 3, "tags": ["law", "oslo"]}])
    goals = goals_frame(spark, [{"roles": ["law"], "keywords": ["oslo"]}])
    found = lambda **w: [(r.person_id, round(r.score, 4)) for r in T.hybrid_search(goals, people, None, weights=w or None).orderBy("rank").collect()]
    assert [p for p, _ in found()] == [3, 1, 2]
    assert [p for p, _ in found(topic=3.0)] == [3, 2, 1]
    assert [p for p, _ in found(helper=0.0)] == [2, 3]
    with pytest.raises(ValueError):
        found(words=1.0)
