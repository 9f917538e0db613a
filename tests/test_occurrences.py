import random
import re

import pytest

from tieweave.operators.occurrences import occurrences
from tieweave.operators.pseudonyms import pseudonymise


@pytest.mark.parametrize(("block", "part"), [(1 << 20, 1 << 20), (60, 200)])
def test_every_place_of_every_word(spark, block, part):
    rng = random.Random(1)
    alphabet = "ab c王李é😀"
    words = sorted({(f"n{k % 2}", "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 4)))) for k in range(60)})
    texts = [(f"n{k % 3}", k, "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 40)))) for k in range(40)] + [("n0", 100, None), ("n0", 101, "a" * 5000)]
    got = occurrences(
        spark.createDataFrame(texts, "scope string, id long, text string"), spark.createDataFrame(words + words[:3], "scope string, term string"),
        ["scope"], ["id"], block_bytes=block, part_bytes=part,
    )
    want = sorted(
        (s, i, w, m.start()) for s, i, t in texts for ws, w in words if ws == s and w and t for m in re.finditer(f"(?={re.escape(w)})", t)
    )
    assert sorted(map(tuple, got.collect())) == want


def test_no_texts_or_no_words(spark):
    texts, words = spark.createDataFrame([("n", 1, "abc")], "scope string, id long, text string"), spark.createDataFrame([("n", "b")], "scope string, term string")
    assert occurrences(texts.filter("false"), words, ["scope"], ["id"]).count() == 0
    assert occurrences(texts, words.filter("false"), ["scope"], ["id"]).count() == 0
    assert occurrences(texts, words.filter("false"), ["scope"], ["id"]).columns == ["scope", "id", "term", "start"]


def _one_after_another(text, names):
    """Names replaced by placeholders in turn, longest first."""
    hidden = {}
    for name, token in sorted(names, key=lambda x: (-len(x[0]), x[1])):
        mark = chr(0xE100 + len(hidden))
        hidden[mark] = token
        text = re.sub(f"(?<![A-Za-z0-9]){re.escape(name)}(?![A-Za-z0-9])", mark, text)
    for mark, token in hidden.items():
        text = text.replace(mark, token)
    return text


def test_names_as_if_replaced_in_turn(spark):
    rng = random.Random(2)
    pool = ["Bob", "Bob Li", "王", "王李", "李", "-Bob", "Li", "A", "Li Bob", "b"]
    names = [(n, f"P{k:03d}") for k, n in enumerate(pool)]
    texts = ["".join(rng.choice([*pool, " ", "-", "x", "9", ", "]) for _ in range(rng.randrange(1, 14))) for _ in range(150)] + ["-Bob-Bob", "BobBob", ""]
    rows = spark.createDataFrame([("n", i, t) for i, t in enumerate(texts)] + [("n", -1, None)], "network_id string, id long, text string")
    book = spark.createDataFrame([("n", "person", n, t, k) for k, (n, t) in enumerate(names)], "network_id string, kind string, name string, token string, ord long")
    got = {r.id: r.text for r in pseudonymise(rows, book, ["network_id"], ["id"]).collect()}
    assert got.pop(-1) is None
    assert [got[i] for i in range(len(texts))] == [_one_after_another(t, names) for t in texts]
