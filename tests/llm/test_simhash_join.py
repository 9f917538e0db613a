import math
import random

import numpy as np
import pytest
import xxhash

from helpers import documents, edited, fold, odd_texts, prose, words
from tieweave.llm import simhash_join as sj


def _fingerprint(text, n=4):
    ws = [fold(w) for w in words(text)]
    grams = [" ".join(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1))] if ws else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _roots(fps, bits=4):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= bits:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [find(i) for i in range(len(fps))]


def test_against_all_pairs(spark):
    texts = odd_texts() + ["one", "ONE", "a b c", "A  B\tc", "a b c d a b c d a b c d"]
    for g in range(5):
        base = prose(g, 150)
        texts += [" ".join(base), " ".join(base).upper()] + [" ".join(edited(base, 10 * g + k, 1 + k % 5)) for k in range(14)]
    fps = [_fingerprint(t) for t in texts]
    got = {r.doc_id: r for r in sj.near_duplicates(documents(spark, texts, clashing=True)).collect()}
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{f:016x}" for f in fps]
    assert [got[i].component_id for i in range(len(texts))] == _roots(fps)
    assert len(set(_roots(fps))) < len(set(fps))


def _ball(rng, centre, k):
    """Fingerprints in a chain of few bits around a centre: many share their parts."""
    out = {centre}
    while len(out) < k:
        x = rng.choice(sorted(out))
        for b in rng.sample(range(64), rng.choice([1, 3, 4, 5, 6])):
            x ^= 1 << b
        out.add(x)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_links_join_what_all_pairs_join(spark, seed):
    rng = random.Random(seed)
    fps = {rng.getrandbits(64) for _ in range(150)} | {0, 1, (1 << 64) - 1} | _ball(rng, 0, 60) | _ball(rng, rng.getrandbits(64), 250)
    # Few distinct values in 40 of the bits: slots that many share.
    fps |= {(rng.getrandbits(2) << 62) | (rng.getrandbits(24)) for _ in range(300)}
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    links = [(r.a, r.b) for r in sj.links_across(df).collect()]
    assert all(((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4 for a, b in links)
    at, root = {f: i for i, f in enumerate(signed)}, list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = sorted((find(at[a]), find(at[b])))
        root[y] = x
    assert [find(i) for i in range(len(fps))] == _roots(fps)


@pytest.mark.parametrize("m", [2, 3, 4, 5])
def test_probes_reach_every_near_value(m):
    rng = np.random.default_rng(m)
    values = np.unique(np.concatenate([rng.integers(0, 2**63, 300, dtype=np.uint64), rng.integers(0, 2**12, 100, dtype=np.uint64)]))
    groups = sj.bit_groups(sj._pair_counts(values).reshape(64, 64), len(values), m)
    assert sorted(b for g in groups for b in g) == list(range(64)) and max(map(len, groups)) - min(map(len, groups)) <= 1
    holes = sj.Pigeonhole(groups, sj.Pigeonhole.counted(groups, values), len(values))
    chosen = holes.thresholds(values)
    assert (chosen.sum(axis=1) == 4 - m + 1).all() and chosen.min() >= -1
    near = values.copy()
    for i in range(len(near)):
        for b in rng.choice(64, rng.integers(0, 5), replace=False):
            near[i] ^= np.uint64(1 << int(b))
    rows, slots = holes.probes(values)
    looked_for = set(zip(rows.tolist(), slots.tolist(), strict=True))
    met = {row for row, slot in zip(*(x.tolist() for x in holes.stored(near)), strict=True) if (row, slot) in looked_for}
    assert met == set(range(len(values)))


def test_estimates_are_exact_for_one_piece():
    values = np.unique(np.random.default_rng(5).integers(0, 2**63, 500, dtype=np.uint64) & np.uint64(0xFFFF00FF00FF0FF0))
    groups = [list(range(k, k + 8)) for k in range(0, 40, 8)] + [list(range(40, 64))]
    holes = sj.Pigeonhole(groups, sj.Pigeonhole.counted(groups, values), len(values))
    cost = holes.costs(values)
    own = sj.gathered(values, groups[0])
    for t in range(3):
        near = (np.bitwise_count(own[:, None] ^ own[None, :]) <= t).sum(axis=1)
        probes = sum(math.comb(8, d) for d in range(t + 1))
        assert np.allclose(cost[0, t + 1], probes * sj.PROBE_COST + near, atol=1e-6)


def test_repeated_rows_no_ids_no_rows(spark):
    docs = documents(spark, ["x y z", "x y z", None, "", "x y z"], ids=[7, 7, 3, None, None])
    rows = sorted(((r.doc_id is None, r.doc_id or 0), r.fingerprint, r.component_id) for r in sj.near_duplicates(docs).collect())
    f = f"{_fingerprint('x y z'):016x}"
    assert rows == sorted([((False, 7), f, 7), ((False, 7), f, 7), ((False, 3), "0" * 16, 3), ((True, 0), "0" * 16, 3), ((True, 0), f, 7)])
    assert sj.near_duplicates(documents(spark, [])).count() == 0
