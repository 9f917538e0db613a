import random
import re

import pytest

from helpers import documents, edited, odd_texts, prose
from tieweave.llm import licences, line_dedup as ld


def _norm(line):
    return re.sub(r"[\W\d_]+", " ", line.lower()).strip()


def _simhash(text):
    xxhash = pytest.importorskip("xxhash")
    hs = [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in text.split(" ")]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hs) > len(hs))


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _kept(docs):
    """docs: (id, text); lines kept by all pairs."""
    lines = [(i, k, _norm(x)) for i, t in docs if t is not None for k, x in enumerate(t.split("\n"))]
    lines = [x for x in lines if len(x[2].split(" ")) >= ld.MIN_WORDS]
    norms = sorted({x[2] for x in lines})
    sims, root = [_simhash(n) for n in norms], {n: n for n in norms}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in range(len(norms)):
        for b in range(a):
            if bin(sims[a] ^ sims[b]).count("1") <= ld.MAX_BITS and 5 * _edits(norms[a].split(), norms[b].split()) <= max(len(norms[a].split()), len(norms[b].split())):
                root[find(norms[a])] = find(norms[b])
    first = {}
    for i, k, n in lines:
        first[find(n)] = min(first.get(find(n), (i, k)), (i, k))
    gone = {(i, k) for i, k, n in lines if first[find(n)] != (i, k)}
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in docs}, gone


def test_lines_against_all_pairs(spark):
    rng = random.Random(8)
    common = [" ".join(prose(s, 14 + 9 * (s % 5), 300)) for s in range(12)]
    texts = odd_texts()[:7] + ["a b c\na b c\n\n", " ".join(prose(5, 40)) + "\n" + " ".join(prose(5, 40)).upper() + "!"]
    for d in range(30):
        lines = []
        for _ in range(6):
            line = rng.choice(common)
            if rng.random() < 0.5:
                line = " ".join(edited(line.split(), rng.randrange(10**6), 1))
            lines.append(line.title() + " 12." if rng.random() < 0.2 else line)
        texts.append("\n".join([*lines, "short line", " ".join(prose(900 + d, 12))]))
    docs = documents(spark, texts, clashing=True)
    want, gone = _kept(list(enumerate(texts)))
    out = ld.without_repeated_lines(docs)
    assert set(docs.columns) - {"n_lines", "n_removed"} <= set(out.columns)
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(texts) and gone
    for i, t in enumerate(texts):
        assert got[i].text == want[i]
        assert (got[i].n_lines, got[i].n_removed) == (0 if t is None else len(t.split("\n")), sum(g[0] == i for g in gone))


def test_simhash_of_words_and_of_long_rows(spark):
    from pyspark.sql import functions as F

    texts = ["a b c d e", " ".join(f"w{i}" for i in range(400)), "x x x y"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", F.split("t", " ").alias("words"))
    want = [_simhash(t) for t in texts]
    assert [r.simhash % 2**64 for r in sorted(ld._word_sums(rows, ["i"]).collect())] == want
    assert [r[1] % 2**64 for r in sorted(rows.select("i", ld._long_simhash(F.col("words"))).collect())] == want


def test_equal_rows_and_no_rows(spark):
    line = "one two three four five six"
    rows = ld.without_repeated_lines(documents(spark, [line, line, line + "\n" + line, line], ids=[4, 4, 7, None])).collect()
    assert sorted((r.doc_id or 0, r.text) for r in rows) == [(0, line), (4, ""), (4, ""), (7, "")]
    assert ld.without_repeated_lines(documents(spark, [])).count() == 0


def _grams(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    ws = re.findall(r"[a-z0-9\x80-\U0010ffff]+", folded)
    return set(zip(ws, ws[1:], strict=False))


def test_licences_against_plain_dice(spark):
    mit = licences.TEMPLATES["MIT"][1]
    texts = odd_texts() + [
        "Text here.\nReleased under the MIT License.\nMore.", mit, mit.replace("copies", "pieces").replace(". ", ".\n"), mit + " " + " ".join(prose(1, 200)),
        "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0", "This work is licensed under the GNU General Public License, version 3.", "RELEASED under -- the MIT licence",
    ]
    got = {r.doc_id: r for r in licences.licence_report(documents(spark, texts, clashing=True)).collect()}
    for i, t in enumerate(texts):
        best = []
        units = (t or "").split("\n")
        for u in [*units, *([" ".join(units)] if len(units) > 1 else [])]:
            g = _grams(u)
            scores = [(-2 * len(g & _grams(x)) / (len(g) + len(_grams(x))), n) for n, xs in licences.TEMPLATES.items() for x in xs if g]
            if scores and -min(scores)[0] >= licences.THRESHOLD:
                best.append(min(scores))
        want = (min(best)[1], len(best), ",".join(sorted({n for _, n in best}))) if best else (None, 0, "")
        assert (got[i].licence, got[i].n_matches, got[i].licences) == want, t
        assert not best or abs(got[i].dice + min(best)[0]) < 1e-12
    assert licences.licence_report(documents(spark, [])).count() == 0


def test_repeated_rows_are_reported_each(spark):
    rows = licences.licence_report(documents(spark, ["Released under the MIT License."] * 3, ids=[1, 1, None])).collect()
    assert [r.licence for r in rows] == ["MIT"] * 3
