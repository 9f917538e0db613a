import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from helpers import documents, fold, odd_texts, prose
from tieweave.llm import phrases as ph


def _split(text):
    return [re.findall(r"[^ \t]+", p) for p in re.split("[.,;:!?\n-\r]", fold(text))]


def _expected(rows, least, top):
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = lang or "und"
        for ws in _split(text or ""):
            n[lang] += len(ws)
            for k in range(1, 5):
                for i in range(len(ws) - k + 1):
                    f[lang][tuple(ws[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = defaultdict(int)
        for p, a in candidates.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], a)
        scored = []
        for p, a in candidates.items():
            if 100 * inside[p] >= 80 * a:
                continue
            score, _, left, right = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def _rows(seed):
    rng = random.Random(seed)
    rows = []
    passage = "the very same passage of many words, that comes again. and again"
    for k in range(120):
        vocabulary = [f"w{i}" for i in range(12)] + ["the", "of", "Éa", "x-y", "字", "don't"]
        words = [rng.choice(vocabulary) if rng.random() < 0.4 else rng.choice(["the", "of", "w1", "w2", "New York", "a b c d e"]) for _ in range(60)]
        text = "".join(w.upper() * (rng.random() < 0.1) or w + rng.choice([" "] * 8 + [", ", ".\n", "\t", "! ", "\r\n", "\x0b"]) for w in words)
        rows.append((rng.choice(["en", "en", "de", None]), text + passage * (k % 3)))
    return rows + [("en", t) for t in odd_texts()] + [("fr", None), ("fr", ""), (None, None), ("es", "too few words")]


@pytest.mark.parametrize(("least", "top", "group", "task"), [(30, 2000, 1 << 20, 1 << 20), (5, 40, 300, 2000), (5, 2000, 40, 500)])
def test_against_plain_counting(spark, monkeypatch, least, top, group, task):
    monkeypatch.setattr(ph, "TASK_SUFFIXES", task)
    rows = _rows(3)
    docs = documents(spark, [t for _, t in rows], clashing=True).drop("lang")
    langs = spark.createDataFrame([(i, lang) for i, (lang, _) in enumerate(rows)], "doc_id long, lang string")
    got = ph.collocations(docs.join(langs, "doc_id"), least, top, group).collect()
    want = _expected(rows, least, top)
    assert sorted(map(tuple, got)) == want and len(want) > 20
    assert got[0].asDict().keys() == {"lang", "rank", "phrase", "a", "l", "r", "n", "score"}


def test_groups_stay_within_the_budget(spark):
    rows = _rows(5)
    docs = documents(spark, [t for _, t in rows])
    words, seed = ph.hashed_words(docs)
    frequent = words.filter("n >= 5")
    known = spark.sparkContext.broadcast(ph.WordFilter.of(frequent))
    vertical, heavy = ph.vertical_partition(docs, frequent, seed, known, 300)
    assert len(vertical.heavy) > 1 and all(len(h) for h in vertical.heavy[:2]) and heavy.count() > 0
    sent = ph.sent_suffixes(docs, seed, known, spark.sparkContext.broadcast(vertical)).toArrow().to_pylist()
    load, groups_of = Counter(), defaultdict(set)
    for r in sent:
        n, depth = np.frombuffer(r["n"], "<i8"), np.frombuffer(r["depth"], "<i1")
        own = np.frombuffer(r["words"], "<u8")[np.frombuffer(r["codes"], "<u2").reshape((-1, 4), order="F")]
        load[r["grp"]] += int(n[depth < 4].sum())
        for s, d in zip(own.tolist(), depth.tolist(), strict=True):
            groups_of[tuple(s[:d])].add(r["grp"])
    # Suffixes with one prefix are in one group; buckets that are over alone hold several prefixes.
    assert all(len(g) == 1 for g in groups_of.values()) and len(load) > 10
    assert sorted(load.values())[len(load) // 2] <= 300


def test_squeezed_numbers_come_back():
    rng = np.random.default_rng(1)
    for kind in (np.uint8, np.uint16, np.uint32, np.uint64):
        for size in (0, 1, 5000):
            numbers = rng.integers(0, np.iinfo(kind).max, size, kind, endpoint=True)
            assert (ph.spread(ph.squeezed(numbers), size) == numbers).all()


def test_equal_hashes_draw_new_ones(spark, monkeypatch):
    docs = documents(spark, ["good day sir " * 40, None])
    true = ph.word_counts
    monkeypatch.setattr(ph, "word_counts", lambda docs, seed: true(docs, seed) if seed else true(docs, seed).selectExpr("1L AS h", "lang", "word", "n"))
    words, seed = ph.hashed_words(docs)
    assert seed == 1 and sorted(r.word for r in words.collect()) == ["day", "good", "sir"]


def test_words_and_pieces():
    texts = pa.array(["A b,c\td", "", "  ", "e", ".f. g", "É x y"])
    words, owner, piece = ph.pieces(texts)
    assert words.to_pylist() == ["a", "b", "c", "d", "e", "f", "g", "É x", "y"] and owner.tolist() == [0, 0, 0, 0, 3, 4, 4, 5, 5]
    assert [bool(x) for x in piece[1:] == piece[:-1]] == [True, False, True, False, False, False, False, True]


def test_exact_scores_of_large_counts(spark):
    big = 9_000_000_000_000_000
    frequent = spark.createDataFrame([(1, "en", "p", big + 1), (2, "en", "q", big)], "h long, lang string, word string, n long")
    counts = spark.createDataFrame([(1, 2, 0, 0, big - 1)], "w1 long, w2 long, w3 long, w4 long, a long")
    assert [tuple(r)[4:] for r in ph.scored(counts, frequent).collect()] == [(big - 1, big + 1, big, 2000000 * (big - 1) // (2 * big + 1))]


def test_no_rows(spark):
    assert ph.collocations(documents(spark, [])).count() == 0
    assert ph.collocations(documents(spark, [None, "", "a few words"])).count() == 0


def test_prose_without_phrases(spark):
    assert ph.collocations(documents(spark, [" ".join(prose(k, 300)) for k in range(5)])).count() == 0
