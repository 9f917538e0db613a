import random

import numpy as np
import regex

from helpers import documents
from pyspark.sql import functions as F
from tieweave.llm import fuzzy_lines as fl
from tieweave.llm.components import components
from tieweave.session import Scratch

DOCUMENTS = "/root/testdata/sf0.01/documents.parquet"


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _alike(lines):
    """All pairs of word lists by edit similarity alone; numbers of words and of bags of words only skip what cannot be."""
    order = sorted(range(len(lines)), key=lambda i: len(lines[i]))
    sizes = np.array([len(lines[i]) for i in order])
    bags = np.zeros((len(lines), 256), np.int16)
    for k, i in enumerate(order):
        np.add.at(bags[k], [hash(w) % 256 for w in lines[i]], 1)
    for k, i in enumerate(order):
        end = np.searchsorted(sizes, 5 * sizes[k] / 4, "right")
        near = np.abs(bags[k + 1 : end] - bags[k]).sum(1) <= 2 * (sizes[k + 1 : end] // 5)
        for j in np.flatnonzero(near) + k + 1:
            if 5 * _edits(lines[i], lines[order[j]]) <= sizes[j]:
                yield i, order[j]


def _components(spark, docs):
    """Component by normalised line."""
    with Scratch(spark) as scratch:
        lines = fl.marked_lines(scratch, docs)
        distinct = fl.distinct_lines(lines)
        found = distinct.join(components(fl.links(distinct, lines)), "node").join(lines.select("h1", "norm").distinct(), "h1")
        return {r.norm: r.component for r in found.collect()}


def _texts(spark, texts):
    return [r.text for r in sorted(fl.without_fuzzy_lines(documents(spark, texts)).collect())]


def test_recall_on_a_table_against_all_pairs_by_edit_similarity(spark):
    docs = spark.read.parquet(DOCUMENTS)
    texts = [r.text for r in docs.select("text").filter("text IS NOT NULL").collect()]
    norms = {regex.sub(r"[^\p{L}\p{M}\p{N}]+", " ", x.lower()).strip() for t in texts for x in t.split("\n")}
    lines = sorted(x.split(" ") for x in norms if x.count(" ") >= 4)
    pairs = [(" ".join(lines[i]), " ".join(lines[j])) for i, j in _alike(lines)]
    found = _components(spark, docs)
    met = [a in found and found[a] == found.get(b) for a, b in pairs]
    assert len(pairs) > 200 and sum(met) >= 0.9 * len(met)
    # No group holds a line that all pairs leave alone.
    assert set(found) <= {x for pair in pairs for x in pair}


def test_few_edits_are_always_found(spark):
    rng = random.Random(5)
    lines = []
    for n in (6, 7, 9, 12, 15, 16, 18, 19, 25, 60, 200):
        base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        for kind in range(3):
            at = rng.randrange(n)
            lines.append(base[:at] + [f"x{rng.randrange(10**6)}"] * (kind < 2) + base[at + (kind > 0) :])
        lines.append(base)
    pairs = [(" ".join(lines[i]), " ".join(lines[j])) for i, j in _alike(lines)]
    found = _components(spark, documents(spark, [" ".join(x) for x in lines]))
    one = [(a, b) for a, b in pairs if _edits(a.split(), b.split()) == 1]
    assert len(one) >= 30 and all(found[a] == found[b] for a, b in one)


def test_lines_that_differ_in_digits_or_marks_only(spark):
    texts = [
        "On 3 May the price in Paris was 12 euro", "On 17 May the price in Paris was 940 dollar", "3 12 4 55", "3 12 4 56", "कि का", "कु का",
        "on 3 may the price in that town was 12", "on 4 may the price in that town was 12",
    ]
    assert _texts(spark, texts) == [*texts[:7], ""]


def test_short_lines_lines_of_signs_and_scripts_without_blanks(spark):
    long = "今日天气很好我们一起去公园散步"
    texts = ["Read more", "read more!", "-----", " -----", "=====", "12,5", "12.5", long, long.replace("公", "花"), "完全不同的一行文字没有重复", "\n \n", "read less"]
    assert _texts(spark, texts) == ["Read more", "", "-----", "", "=====", "12,5", "", long, "", texts[9], "\n \n", "read less"]


def test_nulls_equal_rows_clashing_columns_and_long_lines(spark):
    many = " ".join(f"w{i}" for i in range(9000))
    line = "one two three four five six seven"
    rows = [(None, line), (None, None), (1, None), (2, ""), (3, line + " eight\nown line"), (3, line + " eight\nown line"), (4, many), (5, many.replace("w77 ", "v77 ")), (6, "a\n" + line)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id AS node", "'k' AS _key", "'x' AS _gone", "text AS norm", "7 AS n_lines", "doc_id AS component")
    got = fl.without_fuzzy_lines(docs)
    assert got.columns == ["doc_id", "text", "node", "_key", "_gone", "norm", "component", "n_lines", "n_removed"]
    want = [(None, line, 1, 0), (None, None, 0, 0), (1, None, 0, 0), (2, "", 1, 0), (3, "own line", 2, 1), (3, "own line", 2, 1), (4, many, 1, 0), (5, "", 1, 1), (6, "a", 2, 1)]
    assert sorted(map(repr, [(r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()])) == sorted(map(repr, want))
    assert all(r.norm == dict(rows).get(r.doc_id) for r in got.filter("doc_id > 3").collect())


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert fl.without_fuzzy_lines(docs).collect() == []


def test_majorities_of_small_and_large_shares(spark):
    for n in (0, 1, 6, 511, 512, 1400):
        rng = np.random.default_rng(n)
        hashes = [int(x) for x in rng.integers(-(1 << 63), (1 << 63) - 1, n)]
        got = spark.createDataFrame([(hashes,)], "h array<long>").select(fl.simhash_blocks(F.col("h"), 4, 14).alias("b")).first().b
        step, want = 1 << 62, []
        for i in range(4):
            own = [h for h in hashes if -(1 << 63) + i * step <= h < -(1 << 63) + (i + 1) * step]
            width, lanes, apart = (9, 7, 2) if len(own) < 512 else (31, 2, 7)
            want.append(sum(1 << (lane * apart + k) for k in range(apart) for lane in range(lanes) if 2 * sum(h >> (k + lane * width) & 1 for h in own) > len(own)))
        assert got == want


def test_entries_across_need_another_component_and_a_fitting_length(spark):
    rows = [
        (1, 10, 20, 1), (1, 11, 24, 2), (1, 12, 40, 3),  # the last has nobody near its length
        (2, 20, 20, 5), (2, 21, 21, 5), (2, 22, 20, 5),  # one component
        (3, 30, 10, 6), (3, 31, 30, 7), (3, 32, 90, 8),  # nobody near anybody
        (4, 40, 30, 9), (4, 41, 30, 9), (4, 42, 36, 10), (4, 43, 44, 9),
    ]
    placed = spark.createDataFrame(rows, "key long, node long, n_words int, component long")
    got = fl._across_entries(placed)
    assert got.columns == placed.columns
    assert sorted(r.node for r in got.collect()) == [10, 11, 40, 41, 42, 43]
