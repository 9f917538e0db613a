import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from helpers import CLASHING, documents, odd_texts, prose
from tieweave.llm import packing, text as tx
from tieweave.llm.registered import tokenizer_path


@pytest.fixture(scope="module")
def tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    pytest.importorskip("public_tokenizers")
    return tokenizers.Tokenizer.from_file(tokenizer_path())


def test_words_of_sliced_arrays_with_nulls():
    texts = tx.as_strings(pa.array(["x", None, " a  b ", "", "é ü\n"])).slice(1)
    found, bounds = tx.words(texts, tx.BLANK_SEPARATED)
    assert found.to_pylist() == ["a", "b", "é", "ü"] and bounds.tolist() == [0, 0, 2, 2, 4]


def test_word_tokens_equal_the_whole_tokenizer(tokenizer):
    rng = random.Random(4)
    signs = ["a", "B", "é", "Ñ", "ß", "İ", "Σ", "ς", "1", "½", ".", ",", "'", "'s", "’", "<|endoftext|>", "<|", "́", "J̌", "K", "×", "…", "字", "😀", " ", "\n", " ", " ", "\x1c", "don't", "I'LL"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 30))) for _ in range(1500)] + ["", " ", ",a", "a.", "é.,"]
    ids, bounds = packing.WordTokens(tokenizer_path()).encode(tx.as_strings(pa.array(texts)))
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_forgetting_words_changes_nothing(tokenizer):
    texts = tx.as_strings(pa.array([" ".join(prose(s, 50)) for s in range(20)]))
    small, large = packing.WordTokens(tokenizer_path(), cached=60), packing.WordTokens(tokenizer_path())
    for i in range(20):
        assert small.encode(texts.slice(i, 1))[0].tolist() == large.encode(texts.slice(i, 1))[0].tolist()


def test_first_fit_is_leftmost_fit():
    rng = random.Random(1)
    for _ in range(30):
        sizes = sorted((rng.randrange(1, 21) for _ in range(rng.randrange(1, 60))), reverse=True)
        room, want = [], []
        for s in sizes:
            k = next((i for i, r in enumerate(room) if r >= s), len(room))
            if k == len(room):
                room.append(20)
            room[k] -= s
            want.append(k)
        assert packing.first_fit_decreasing(sizes, 20) == want


def test_packing_round_trip(spark, tokenizer):
    texts = odd_texts() + [" ".join(prose(s, 20 + 37 * s)) for s in range(40)]
    docs = documents(spark, texts, clashing=True)
    rows = packing.packed_documents(docs, tokenizer_path(), group_pieces=32).collect()
    own, seqs = {}, {}
    for r in rows:
        own.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    assert set(own) == set(range(len(texts)))
    for i, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(own[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.asarray(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for rs in seqs.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.LENGTH


def test_sequences_hold_their_tokens(spark, tokenizer):
    docs = documents(spark, [" ".join(prose(s, 900)) for s in range(6)])
    packed = packing.packed_documents(docs, tokenizer_path())
    sizes = {(r.sequence_id, r.offset): r.length for r in packed.collect()}
    rows = packing.sequence_tokens(docs, packed, tokenizer_path()).collect()
    assert {(r.sequence_id, r.offset): len(r.ids) for r in rows} == sizes


def test_packing_of_repeated_and_no_rows(spark, tokenizer):
    rows = packing.packed_documents(documents(spark, ["a b"] * 7, ids=[3] * 6 + [None]), tokenizer_path()).collect()
    assert len(rows) == 7 and len({(r.sequence_id, r.offset) for r in rows}) == 7
    assert packing.packed_documents(documents(spark, []), tokenizer_path()).count() == 0
    assert CLASHING
