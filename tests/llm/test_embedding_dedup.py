"""Filters of vectors and the links that they find."""

import numpy as np
import pytest

from tracelake.llm import embedding_dedup as E
from tracelake.llm.embedding_dedup import ProductCode


def units(n, seed=1, size=64):
    x = np.random.default_rng(seed).standard_normal((n, size))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_each_vector_has_a_filter():
    lists = ProductCode(64, 12).decode(units(3000))
    print("empty", sum(len(x) == 0 for x in lists))
    assert all(len(x) for x in lists)


def planted(n, cosine):
    """n vectors and one for each at that cosine."""
    a, b = units(n, 2), units(n, 3)
    b -= (a * b).sum(1, keepdims=True) * a
    return a, cosine * a + np.sqrt(1 - cosine**2) * b / np.linalg.norm(b, axis=1, keepdims=True)


@pytest.mark.parametrize("total", [500, 2000, 200_000, 2_000_000, 100_000_000])
def test_near_vectors_share_a_filter(total):
    codes = [ProductCode(64, E.code_words(total), t) for t in range(E.TURNS)]
    for cosine in (0.9501, 0.98):
        lists = [E.filters(codes, x) for x in planted(500, cosine)]
        met = np.mean([len(np.intersect1d(p, q)) > 0 for p, q in zip(*lists)])
        print("total", total, "cosine", cosine, "met", met)
        assert met >= 0.99


@pytest.mark.parametrize("total", [500, 1_000_000, 100_000_000])
@pytest.mark.parametrize("size", [2, 3, 8, 16, 32, 384])
def test_near_vectors_meet_in_any_dimension(size, total):
    codes = E.codes_of(size, total, 0.95)
    a = units(500, 2, size)
    b = units(500, 3, size)
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.9501 * a + np.sqrt(1 - 0.9501**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    met = np.mean([len(np.intersect1d(p, q)) > 0 for p, q in zip(E.filters(codes, a), E.filters(codes, b))])
    print("size", size, "total", total, "words", codes[0].words, "met", met)
    assert met >= 0.96


def test_planted_links_are_found(spark):
    groups = [planted(300, c) for c in (0.9501, 0.97, 0.99)]
    x = np.concatenate([np.concatenate([a + 0 if k == 0 else np.roll(a, k, axis=1), b if k == 0 else np.roll(b, k, axis=1)]) for k, (a, b) in enumerate(groups)])
    want = (x @ x.T >= 0.95).sum(1) - 1
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in E.near_duplicates(rows).collect()}
    found = sum(got[i] for i in range(len(x))) / want.sum()
    print("links found", found)
    assert all(got[i] <= w for i, w in enumerate(want)) and found >= 0.99
