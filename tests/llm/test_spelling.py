import random
import re
import zlib
from collections import Counter

import pytest

from helpers import documents, fold
from tieweave.llm import spelling as sp


def _words(docs):
    found = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = fold(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= 2}


def _near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def _expected(docs):
    words = _words(docs)
    rows, forms = {}, {}
    for w, n in words.items():
        near = [x for x in words if _near(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= 10 * n:
            forms[w] = best
        rows[w] = (n, len(near))
    out = {}
    for w, (n, n_near) in rows.items():
        root = w
        while root in forms:
            root = forms[root]
        out[w] = (n, n_near, forms.get(w), words.get(forms.get(w)), root)
    return out


def _texts(seed):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("aeionrtlé") for _ in range(rng.randrange(7, 10))) for _ in range(25)]
    texts = []
    for _ in range(60):
        words = []
        for _ in range(60):
            w = rng.choice(stems[: 1 + int(24 * rng.random() ** 3)])
            k = rng.randrange(len(w))
            for _ in range(rng.choice([0] * 6 + [1, 1, 2])):
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("aeioÉß") + w[k:], w[:k] + rng.choice("aeionÀ") + w[k + 1 :]])
            words.append(w.upper() if rng.random() < 0.05 else w)
        texts.append("".join(w + rng.choice([" ", ", ", "\n", "1", "-"]) for w in words))
    return texts


@pytest.mark.parametrize(("block", "part"), [(1024, 2048), (3, 2)])
def test_against_all_pairs(spark, monkeypatch, block, part):
    monkeypatch.setattr(sp, "BLOCK_WORDS", block)
    monkeypatch.setattr(sp, "PART_WORDS", part)
    texts = _texts(4) + [None, "", "short words only", "×multiply× ×multiply×", "Ünïcodé 字字字字字字字字 ünïcodé", "aaaaaaa aaaaaaaa " * 40]
    # A chain of forms: each ten times as frequent as the one before.
    texts += ["chainword " * 300, "chainwore " * 25, "chainworee " * 2, "x" * 5000 + " " + "x" * 5001, "x" * 5000 + " " + "x" * 5001]
    ids = [None if k == 7 else k // 2 for k in range(len(texts))]
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in sp.variants(documents(spark, texts, ids=ids, clashing=True)).collect()}
    want = _expected(zip(ids, texts, strict=True))
    assert got == want
    assert want["chainworee"][4] == "chainword" and any(len(w) == 5000 for w in want) and sum(r[1] for r in want.values()) > 100


def test_no_words(spark):
    assert sp.variants(documents(spark, [])).count() == 0
    assert sp.variants(documents(spark, [None, "few", "onlyonce"])).count() == 0


def test_letter_groups_are_even():
    import numpy as np

    counts = np.zeros(sp.LETTERS)
    counts[97:123] = np.arange(1, 27) ** 2
    for n in sp.GROUPS:
        groups = sp.letter_groups(counts, n)
        load = np.bincount(groups, weights=counts, minlength=n)
        assert set(groups) == set(range(n)) and load.max() <= max(counts.max(), 1.34 * counts.sum() / n)
