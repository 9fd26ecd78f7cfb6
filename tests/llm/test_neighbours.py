"""Additive quantisation, pairs and searches against brute force."""

import numpy as np
from pyspark.sql import functions as F

from tessitura.llm import neighbours as N

VEC = "vec_id long, stat1 array<float>"


def vectors(n=1500, dim=64, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    for i in range(0, n // 3, 3):  # near copies and copies
        x[i + 1] = x[i] + rng.normal(size=dim).astype(np.float32) * rng.choice([0, 0.1, 0.3, 0.45])
    x[-9:] = x[-9]  # a group of equal vectors larger than k
    return x


def frame(spark, x):
    bad = [None, [], [0.0] * 64, [float("nan")] * 64, [None] + [1.0] * 63, [1.0] * 63, [float("inf")] + [1.0] * 63]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(10_000 + i, v) for i, v in enumerate(bad)] + [(None, [1.0] * 64)]
    return spark.createDataFrame(rows, VEC)


def brute(x, k, least):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    out = set()
    for i in range(len(x)):
        c = np.flatnonzero(s[i] >= least)
        for j in c[np.lexsort((c, -np.round(s[i, c], 12)))][:k]:
            out.add((min(i, j), max(i, j)))
    return out, s


def test_pairs(spark, monkeypatch):
    x = vectors()
    want, _ = brute(x, 5, 0.9)
    got = {(r.vec_a, r.vec_b) for r in N.Neighbours(frame(spark, x), "vec_id", "stat1", 64).similar_pairs(0.9).collect()}
    assert not got - want and len(want - got) <= 0.01 * len(want)
    monkeypatch.setattr(N, "BLOCK", 100)  # every cell in several blocks
    again = {(r.vec_a, r.vec_b) for r in N.Neighbours(frame(spark, x), "vec_id", "stat1", 64).similar_pairs(0.9).collect()}
    assert again == got


def test_search_recall(spark):
    x = vectors(3000)
    _, s = brute(x, 5, 0.9)
    index = N.Neighbours(frame(spark, x), "vec_id", "stat1", 64)
    got = index.search(F.col("id") % 100 == 0, 5).toPandas()
    hits = total = 0
    for q, g in got.groupby("vec_id"):
        best = np.argsort(-s[q])[:5]
        hits += sum(s[q, j] >= s[q, best[-1]] - 1e-9 for j in g["neighbour"])
        total += 5
        assert q not in set(g["neighbour"])
    assert total == 150 and hits / total >= 0.9


def test_nothing_usable(spark):
    empty = N.Neighbours(frame(spark, np.zeros((0, 64), dtype=np.float32)).where("vec_id >= 10000"), "vec_id", "stat1", 64)
    assert empty.similar_pairs(0.9).count() == 0 and empty.search(F.lit(True)).count() == 0
    one = N.Neighbours(spark.createDataFrame([(1, [1.0] * 64)], VEC), "vec_id", "stat1", 64)
    assert one.similar_pairs(0.9).count() == 0 and one.search(F.lit(True)).count() == 0


def test_beam_search_is_no_worse_than_greedy_and_scores_are_lookups():
    x = vectors(800)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    aq = N.AdditiveQuantizer.fit(x, 32, 32, 4)
    error = [((x - aq.decode(aq.encode(x, b))) ** 2).sum() for b in (1, 4)]
    assert error[1] < error[0] < (x**2).sum()
    codes = aq.encode(x)
    sums = aq.decode(codes)
    assert np.allclose(N.lookup_scores(aq.tables(x[:5]), codes), sums @ x[:5].T, atol=1e-5)


def test_levels_grow_with_the_rows(spark, monkeypatch):
    """Cells of 20 rows and books of 8 codewords: three levels, the same pairs."""
    x = vectors(2400)
    want, _ = brute(x, 5, 0.9)
    monkeypatch.setattr(N, "CELL_ROWS", 20)
    monkeypatch.setattr(N, "MAX_BOOK", 8)
    index = N.Neighbours(frame(spark, x), "vec_id", "stat1", 64)
    assert index.levels == 3 and index.book <= 8
    got = {(r.vec_a, r.vec_b) for r in index.similar_pairs(0.9).collect()}
    assert not got - want and len(want - got) <= 0.03 * len(want)


def test_candidates_of_a_dense_cluster_grow_with_its_rows(spark):
    rng = np.random.default_rng(5)
    centre, counts = rng.normal(size=64), []
    for m in (500, 2000):
        x = np.concatenate([centre + 0.05 * rng.normal(size=(m, 64)), rng.normal(size=(400, 64))]).astype(np.float32)
        want, s = brute(x, 5, 0.9)
        index = N.Neighbours(frame(spark, x), "vec_id", "stat1", 64)
        reps = index.encoded().drop("h1", "h2")
        counts.append(index._candidates(reps, 0.9, 5 + N.SPARE).count() / m)
        got = {(r.vec_a, r.vec_b) for r in index.similar_pairs(0.9).collect()}
        assert len(want - got) <= 0.01 * len(want) and len(got - want) <= 0.01 * len(want)
    assert max(counts) <= 5 + N.SPARE


def test_a_third_of_the_rows_are_copies(spark):
    x = vectors(900)
    x[:300] = x[0]
    want = {(q, j) for q in range(300) for j in [i for i in range(7) if i != q][:5]}
    got = {(r.vec_a, r.vec_b) for r in N.Neighbours(frame(spark, x), "vec_id", "stat1", 64).similar_pairs(0.9).collect()}
    assert {(min(p), max(p)) for p in want} == {p for p in got if p[0] < 300 and p[1] < 300}


def test_recall_of_the_search(spark):
    r = N.search_recall(frame(spark, vectors(3000)), "vec_id", "stat1", 64, F.col("id") % 100 == 0).first()
    assert (r.n_queries, r.n_wanted) == (30, 150) and 135 <= r.n_found <= 150
