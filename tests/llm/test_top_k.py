import math

import numpy as np
import pytest

from lectern.llm import top_k


def plain(rows, k, keep):
    good = {i: np.array([math.floor(64 * float(x)) for x in v]) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in filter(keep, good):
        s = sorted((-int(v @ good[q]), i) for i, v in good.items() if i != q and len(v) == len(good[q]))[:k]
        out += [(q, r, i, -n) for r, (n, i) in enumerate(s, 1)]
    return sorted(out)


def found(df, k, keep):
    v = top_k.integer_vectors(df)
    return sorted(tuple(r) for r in top_k.top_k(v, v.where(keep), k).collect())


VECTORS = "vec_id long, embedding array<float>, score int, rank string, block int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "r", 2) for i, v in rows], VECTORS)


@pytest.mark.parametrize("cells", [256, 1 << 20])
def test_matches_brute_force(spark, monkeypatch, cells):
    monkeypatch.setattr(top_k, "BLOCK_CELLS", cells)
    monkeypatch.setattr(top_k, "TRIED", 5)
    monkeypatch.setattr(top_k, "QUERIES", 9)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(120)]  # a very common vector
    assert found(frame(spark, rows), 20, "vec_id % 20 = 0") == plain(rows, 20, lambda i: i % 20 == 0)


def test_real_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.select("vec_id", "embedding").collect()]
    assert found(df, 20, "vec_id % 20 = 0") == plain(rows, 20, lambda i: i % 20 == 0)


def test_edges(spark):
    rows = [(0, [1.0, 2.0]), (20, [1.0, None]), (40, None), (60, [float("nan"), 1.0]), (80, [float("inf"), 1.0]), (1, [0.5, -1.0]), (2, [0.5, -1.0]), (3, []), (100, [1.0, 2.0, 3.0]), (4, [-1e-9, 0.0])]
    assert found(frame(spark, rows), 20, "vec_id % 20 = 0") == plain(rows, 20, lambda i: i % 20 == 0)
    assert found(frame(spark, []), 5, "true") == []
    assert found(frame(spark, [(0, [1.0])]), 5, "true") == []
    assert found(frame(spark, [(None, [1.0]), (1, [1.0]), (2, [2.0])]), 5, "true") == [(1, 1, 2, 8192), (2, 1, 1, 8192)]


def test_levels_are_exact():
    """Segments of a level hold just the postings whose impacts are above its bound."""
    rng = np.random.default_rng(3)
    vectors = rng.integers(-9, 10, (200, 6))
    index = top_k.Index(np.arange(200), vectors)
    for _ in range(50):
        q = rng.integers(-7, 8, 6)
        floor = np.minimum(index.least * q, index.most * q)
        bounds = np.array([40, 17, 5, 1])
        assert index._levels(q, floor, bounds).tolist() == [((vectors * q - floor) > b).sum(0).tolist() for b in bounds]


def test_bounds_prove_and_prune():
    rng = np.random.default_rng(4)
    vectors = np.rint(rng.normal(size=(4000, 32)) * 10).astype(np.int64)
    index, left = top_k.Index(np.arange(4000), vectors), []
    for q in vectors[:40]:
        possible, score = index.possible(q, np.zeros(0, int), 10), vectors @ q
        assert set(np.flatnonzero(score >= np.sort(score)[-10])) <= set(possible)
        left.append(len(possible))
    assert np.mean(left) < 1200  # segments were skipped for most


@pytest.mark.parametrize("dims", [1, 8, 1024])
def test_large_values_and_stops(dims):
    rng = np.random.default_rng(2)
    for scale in (3, 1000, 1_000_000):
        vectors = rng.integers(-scale, scale + 1, (3000, dims))
        ids = rng.permutation(3000)
        index = top_k.Index(ids, vectors)
        for (got_ids, got), q in zip(index.search(ids[:5], vectors[:5], 7), range(5)):
            s = vectors @ vectors[q]
            order = [k for k in np.lexsort((ids, -s)) if ids[k] != ids[q]][:7]
            assert got_ids.tolist() == ids[order].tolist() and got.tolist() == s[order].tolist()


def test_repeated_ids(spark):
    rows = [(0, [1.0, 1.0]), (0, [2.0, 2.0]), (5, [1.0, 0.0]), (5, [1.0, 0.0])]
    out = found(frame(spark, rows), 3, "vec_id = 5")
    assert out == [(5, 1, 0, 8192), (5, 2, 0, 4096)]


def test_a_common_id_is_spread(spark, monkeypatch):
    monkeypatch.setattr(top_k, "BLOCK_CELLS", 600)
    rows = [(7, [float(k % 9), 1.0]) for k in range(3000)] + [(k, [1.0, 0.5]) for k in range(100, 140)]
    v = top_k.integer_vectors(frame(spark, rows))
    sizes = [r["n"] for r in top_k._packed(v, 300, True, "t").selectExpr("length(ids) / 8 AS n").collect()]
    assert sum(sizes) == 3040 and max(sizes) < 600
    assert found(frame(spark, rows), 4, "vec_id = 100") == [(100, r, 7, 64 * 64 * 8 + 32 * 64) for r in (1, 2, 3, 4)]


def test_scores_that_do_not_fit():
    with pytest.raises(OverflowError):
        top_k.Index(np.arange(2), np.full((2, 2), 1 << 40)).search(np.arange(2), np.full((2, 2), 1 << 40), 1)
