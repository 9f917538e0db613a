import hashlib
import random

import pytest

from helpers import alnum_words, documents, edited, fold, odd_texts, prose, words
from tieweave.llm import decontamination as dc, ngram_join as nj
from tieweave.llm.components import components


def _hits(texts, items, window=10):
    out = []
    for t in texts:
        ws, hit, found = alnum_words(t), set(), set()
        for item, text in items:
            iw = alnum_words(text)
            n = min(window, len(iw))
            grams = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if n else set()
            for i in range(len(ws) - n + 1):
                if n and tuple(ws[i : i + n]) in grams:
                    hit |= set(range(i, i + n))
                    found.add(item)
        out.append((len(ws), len(hit), sorted(str(i) for i in found if i is not None)))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 120])
def test_contamination_against_plain_search(spark, block_bytes):
    items = [(i, " ".join(prose(i, 24))) for i in range(8)] + [(8, "Zebra"), (9, "the the the"), (10, ""), (11, None), (8, "zebra ZEBRA!"), (12, " ".join(prose(0, 24)))]
    texts = odd_texts() + ["the the the the", "a zebra, a", "zebra" * 2]
    rng = random.Random(3)
    for k in range(40):
        ws, item = prose(500 + k, 60), prose(k % 8, 24)
        cut = rng.randrange(0, 14)
        texts.append(" ".join(ws[:20] + item[cut : cut + rng.randrange(8, 20)] + ws[20:]).upper())
    # A window must not reach from one text into the next.
    texts += [" ".join(prose(2, 24)[:6]), " ".join(prose(2, 24)[6:12])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, texts, clashing=True)
    got = {r.doc_id: r for r in dc.matches(docs, bench, block_bytes=block_bytes).collect()}
    for i, (n, hit, found) in enumerate(_hits(texts, items)):
        assert (got[i].n_words, got[i].n_hit, got[i]["items"]) == (n, hit, found), repr(texts[i])[:80]
    rows = {r.doc_id: r for r in dc.contamination(docs, bench).collect()}
    assert all(rows[i].items_sha256 == hashlib.sha256(",".join(f).encode()).hexdigest() and rows[i].contaminated == (h > 0) for i, (_, h, f) in enumerate(_hits(texts, items)))
    kept = dc.decontaminated(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, (_, h, _f) in enumerate(_hits(texts, items)) if not h}


def test_proximity_and_repeated_rows(spark):
    item = "alpha beta gamma delta epsilon"
    docs = documents(spark, ["alpha beta new gamma delta epsilon", "alpha q q q q q q beta gamma delta epsilon", "alpha beta new gamma delta epsilon"], ids=[1, 2, 1])
    bench = spark.createDataFrame([(5, item)], "item_id long, text string")
    assert [r.n_hit for r in dc.matches(docs, bench).collect()] == [0, 0, 0]
    near = dc.matches(docs, bench, slop=1).collect()
    assert sorted((r.doc_id, bool(r["items"])) for r in near) == [(1, True), (1, True), (2, False)]
    assert dc.contamination(documents(spark, []), bench).count() == 0
    assert [r.n_hit for r in dc.contamination(docs, bench.filter("false")).collect()] == [0, 0, 0]


def _linked(texts, n, percent):
    sets = []
    for t in texts:
        ws = [fold(w) for w in words(t)]
        sets.append({tuple(ws)} - {()} if len(ws) < n else {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)})
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_join_against_all_pairs(spark, n, percent):
    texts = odd_texts() + ["one", "ONE", "one two"]
    for g in range(6):
        base = prose(g, 60 + 30 * g)
        texts += [" ".join(base), " ".join(base).upper(), "  ".join(base)]
        texts += [" ".join(edited(base, 10 * g + k, 1 + k % 4)) for k in range(12)]
        texts.append(" ".join(base[: len(base) - 5 - g]))
    chain = prose(77, 80)
    for k in range(12):
        texts.append(" ".join(chain[2 * k : 2 * k + 60]))
    sizes, roots = _linked(texts, n, percent)
    got = {r.doc_id: r for r in nj.near_copies(documents(spark, texts, clashing=True), n, percent).collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert [got[i].component_id for i in range(len(texts))] == roots


def test_one_of_each_keeps_one_row(spark):
    a, b = " ".join(prose(1, 80)), " ".join(prose(2, 80))
    docs = documents(spark, [b, a, a + " end", None, "", b, b], ids=[5, 3, 2, 8, 9, 5, None], clashing=True)
    kept = nj.one_of_each(docs, 4, 85)
    assert kept.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(str(r) for r in rows if r[1]) == sorted(map(str, [(None, b), (2, a + " end")])) and {r[0] for r in rows if not r[1]} == {8, 9}
    assert nj.near_copies(documents(spark, []), 4, 85).count() == 0


def test_bitmap_never_exceeds_the_difference():
    import numpy as np

    rng = np.random.default_rng(2)
    for _ in range(200):
        pool = rng.integers(0, 2**63, 400, dtype=np.uint64)
        x, y = (np.unique(pool[rng.random(400) < rng.random()]) for _ in range(2))
        if len(x) and len(y):
            assert nj.least_difference(nj.parity_bitmap(x), nj.parity_bitmap(y)) <= len(np.setxor1d(x, y))


def test_components_of_paths_stars_and_nothing(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 100)] + [(7, 3), (3, 7), (5000, 5000)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(100)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_few_edges_are_not_dealt_out_over_all_partitions(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)], "a long, b long")
    sc, conf = spark.sparkContext, {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}

    def run(name, *few_edges):
        sc.setJobGroup(name, name)
        rows = sorted(map(tuple, components(links, "a", "b", *few_edges).collect()))
        status = sc.statusTracker()
        stages = {s for j in status.getJobIdsForGroup(name) for s in status.getJobInfo(j).stageIds}
        return rows, sum(info.numCompletedTasks for s in stages if (info := status.getStageInfo(s)))

    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        (rows, tasks), (dealt, most) = run("few edges"), run("many edges", 0)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert rows == dealt == sorted([(i, 0) for i in range(41)] + [(100 + i, 100) for i in range(30)])
    assert 3 * tasks < most


def test_pairs_across_meet_once_not_on_every_ngram(spark):
    import numpy as np

    base = prose(3, 300)
    docs = documents(spark, [" ".join(edited(base, k, 2)) for k in range(6)] + [" ".join(prose(4, 50))])
    classes = nj._classes(docs, spark.sparkContext.broadcast(np.zeros(1 << nj.SKETCH_BITS, np.int64)), 4, 85)
    met = nj._met_across(nj._shared_entries(classes, 85), classes, spark.createDataFrame([], "a long, b long"), 85)
    rows = [tuple(sorted((r.x.node, r.y.node))) for r in met.collect()]
    assert len(set(rows)) == len(rows) == 15
