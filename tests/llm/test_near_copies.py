"""Near copies against exact shingle similarity."""

import random

import numpy as np
import pytest

from gridloom.llm import simhash_dedup

KIND = "doc_id long, text string"


def jaccard(a, b):
    a, b = (set(zip(*(w[k:] for k in range(5)))) for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


def changed(rng, text, n):
    """text with n words in a row made new, inside it: n + 4 of its shingles change."""
    w = text.split()
    at = rng.randrange(5, len(w) - n - 5)
    w[at : at + n] = [f"n{rng.randrange(10**9)}" for _ in range(n)]
    return " ".join(w)


@pytest.fixture(scope="module")
def pairs():
    """(text, copy) of 300 pairs at 0.8125 and 300 at 0.7059."""
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(10**9)}" for _ in range(120)) for _ in range(600)]
    out = [(t, changed(rng, t, 8 if i < 300 else 16)) for i, t in enumerate(texts)]
    assert {round(jaccard(*p), 4) for p in out[:300]} == {0.8125} and {round(jaccard(*p), 4) for p in out[300:]} == {0.7059}
    return out


def kept(spark, texts):
    return {r["doc_id"] for r in simhash_dedup.deduplicated(spark.createDataFrame(list(enumerate(texts)), KIND)).collect()}


def test_copies_above_the_likeness_go_and_texts_below_it_stay(spark, pairs):
    stay = kept(spark, [t for p in pairs for t in p])
    assert stay >= set(range(0, 1200, 2))
    assert len([i for i in range(1, 600, 2) if i in stay]) <= 12
    assert stay >= set(range(601, 1200, 2))


def test_a_large_group_is_compared_in_tiles(spark, pairs, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "EXACT_TILE", 16)
    monkeypatch.setattr(simhash_dedup, "SHARD_TILE", 40)
    rng = random.Random(6)
    text = pairs[0][0]
    assert kept(spark, [text, *(changed(rng, text, 1) for _ in range(150)), pairs[1][0]]) == {0, 151}


def test_exact_pairs_equal_brute_force(pairs):
    texts = [t for p in pairs[290:310] for t in p]
    sets = [simhash_dedup.shingle_set(t, 5) for t in texts]
    got = {(int(i[k]), int(j[k])) for i, j in simhash_dedup.alike(sets, np.zeros(len(sets), bool), 0.8) for k in range(len(i))}
    assert got == {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i != j and jaccard(a, b) >= 0.8}


@pytest.mark.parametrize("most", [7, 1 << 20])
def test_probed_blocks_equal_brute_force(most):
    block = np.random.default_rng(8).integers(0, 65536, 700).astype(np.uint64) & np.uint64(0x0FF7)
    at = np.arange(0, 700, 3)
    got = [(int(i), int(j)) for a, b in simhash_dedup._probed(block, at, np.arange(700), 2, most) for i, j in zip(a, b, strict=True)]
    want = {(int(i), int(j)) for i in at for j in np.flatnonzero(np.bitwise_count(block ^ block[i]) <= 2)}
    assert len(got) == len(set(got)) and set(got) == want
