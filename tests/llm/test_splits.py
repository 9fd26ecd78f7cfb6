"""Components and grouped stratification against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessitura.llm import splits
from tessitura.workspace import Workspace

IDMAP = "pos long, list_name string, leftids string, rightids string"


def components(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    return {x: find(x) for x in list(parent)}


@pytest.mark.parametrize("kind", ["chain", "star", "random", "cycle"])
def test_connected(spark, kind):
    r = random.Random(1)
    edges = {
        "chain": [(f"n{i:03}", f"n{i + 1:03}") for i in range(120)],
        "star": [("z", f"n{i:03}") for i in range(200)],
        "random": [(f"n{r.randrange(150):03}", f"n{r.randrange(150):03}") for _ in range(100)],
        "cycle": [(f"n{i:03}", f"n{(i + 7) % 91:03}") for i in range(91)] + [("x", "x")],
    }[kind]
    r.shuffle(edges)
    got = {n.node: n.root for n in splits.connected(spark.createDataFrame(edges, "u string, v string"), Workspace(spark, "t")).collect()}
    comp, smallest = components(edges), {}
    for n, c in comp.items():
        smallest[c] = min(smallest.get(c, n), n)
    assert got == {n: smallest[c] for n, c in comp.items()}


def idmap(seed=0, n=400):
    r = random.Random(seed)
    left = lambda: r.choice([None, "", " ", *[f"spk{r.randrange(60)}"] * 4])
    right = lambda: r.choice([None, " ", *[r.choice(["S{}.wav", "s{}", " d/s{}.SPH"]).format(r.randrange(150))] * 6])
    return [(i, r.choice(["enrol", "ubm", "nap", None]), left(), right()) for i in range(n)]


def bare(x):
    x = (x or "").strip().rsplit("/", 1)[-1].lower()
    return x.removesuffix(".wav").removesuffix(".sph") or None


def groups(data):
    ties = []
    for pos, _, left, right in data:
        a, b = (left if left and left.strip() else None), bare(right)
        ties.append((("row", pos), ("l", a) if a else ("row", pos)))
        if b:
            ties.append((("row", pos), ("s", b)))
    return components(ties)


def test_found(spark):
    for seed in range(3):
        data = idmap(seed)
        comp, by = groups(data), defaultdict(set)
        for n, c in comp.items():
            if n[0] == "l":
                by[c].add(n[1])
        # rows without a left id tie segments to nothing else, so they never join two groups
        want = {(min(m), x) for m in by.values() for x in m if x != min(m)}
        assert {tuple(r) for r in splits.tied_groups(spark.createDataFrame(data, IDMAP)).collect()} == want
    assert splits.tied_groups(spark.createDataFrame([], IDMAP)).count() == 0


def test_related_rows_share_a_split_and_every_row_has_one(spark):
    data = idmap(5, 600)
    t = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1), ("none", 0.0), ("null", None)], "split_name string, target_share double")
    s = splits.GroupedSplits(spark.createDataFrame(data, IDMAP), t)
    of = {r.pos: r.split_name for r in s.assignment().collect()}
    assert len(of) == len(data) and None not in of.values()
    by = defaultdict(set)
    comp = groups(data)
    for pos, *_ in data:
        by[comp[("row", pos)]].add(of[pos])
    assert all(len(v) == 1 for v in by.values())
    report = {r.split_name: r for r in s.report().collect()}
    assert sum(r.n_rows for r in report.values()) == len(data) and set(report) == {"train", "validation", "test"}


def test_shares_are_near_the_targets_when_groups_are_small(spark):
    data = [(i, "abc"[i % 3], f"spk{i // 4}", f"s{i}") for i in range(4000)]
    t = spark.createDataFrame([("train", 8.0), ("validation", 1.0), ("test", 1.0)], "split_name string, target_share double")
    s = splits.GroupedSplits(spark.createDataFrame(data, IDMAP), t)
    assert all(abs(r.actual_share - r.target_share) < 0.01 for r in s.report().collect())
    label = {p: x for p, x, *_ in data}
    got = Counter((r.split_name, label[r.pos]) for r in s.assignment().collect())
    for x in "abc":
        assert abs(got["train", x] / sum(got[q, x] for q in ("train", "validation", "test")) - 0.8) < 0.02


def test_splits_of_nothing(spark):
    t = spark.createDataFrame([("train", 1.0)], "split_name string, target_share double")
    s = splits.GroupedSplits(spark.createDataFrame([], IDMAP), t)
    assert s.assignment().count() == 0 and s.report().first().n_rows == 0


def test_stratify_places_the_rarest_label_evenly():
    rng = np.random.default_rng(0)
    counts = np.zeros((400, 3))
    counts[np.arange(400), rng.choice(3, 400, p=[0.8, 0.17, 0.03])] = 1
    s = splits.stratify(counts, np.array([0.5, 0.25, 0.25]))
    for k in range(3):
        n = counts[:, k].sum()
        assert np.abs(np.bincount(s, counts[:, k], 3) - n * np.array([0.5, 0.25, 0.25])).max() <= 2


def test_targets_are_met_beside_large_components(spark):
    """Components of very different size: rows are what counts, and small ones make good what large ones leave."""
    rng, rows, pos = np.random.default_rng(3), [], 0
    for g, size in enumerate([900, 700, 500, 300, *rng.integers(1, 12, 400)]):
        for i in range(size):
            rows.append((pos, "abcd"[g % 4] if size > 100 else "abc"[i % 3], f"spk{g:04}", f"seg{pos}"))
            pos += 1
    df = spark.createDataFrame(rows, IDMAP)
    t = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1)], "split_name string, target_share double")
    s = splits.GroupedSplits(df, t)
    assert all(abs(r.actual_share - r.target_share) < 0.002 for r in s.report().collect())
    assert [tuple(r) for r in splits.split_check(df, t, s.assignment()).collect()] == [(0, 0, 0, 0)]
    assert sum(r.n_rows for r in s.label_report().collect()) == len(rows)
    # what the check finds
    wrong = s.assignment().where("pos > 2").unionByName(spark.createDataFrame([(2, "test"), (2, "train")], "pos long, split_name string"))
    assert tuple(splits.split_check(df, t, wrong).first())[:3] == (3, 1, 1)


def test_one_component_with_most_rows_takes_the_largest_split(spark):
    rows = [(i, "a", "hub", f"s{i}") for i in range(900)] + [(900 + i, "b", f"x{i}", f"t{i}") for i in range(100)]
    t = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1)], "split_name string, target_share double")
    got = {r.split_name: r.n_rows for r in splits.GroupedSplits(spark.createDataFrame(rows, IDMAP), t).report().collect()}
    assert got["train"] >= 900 and abs(got["validation"] - got["test"]) <= 2


def test_repair_exchanges_units_where_no_single_one_fits():
    sizes = np.array([50, 50, 40, 40, 40, 30])
    p = splits.Placement(np.arange(6), np.zeros(6, dtype=int), sizes, np.array([0.5, 0.5]))
    assert sorted(p.rows) in ([120, 130], [125, 125])


def test_many_labels_are_pooled_not_lost(spark, monkeypatch):
    monkeypatch.setattr(splits, "RARE", 50)
    rows = [(i, f"label{i % 300}" if i % 2 else "big", f"spk{i // 2}", f"s{i}") for i in range(3000)]
    t = spark.createDataFrame([("train", 0.5), ("test", 0.5)], "split_name string, target_share double")
    s = splits.GroupedSplits(spark.createDataFrame(rows, IDMAP), t)
    assert all(abs(r.actual_share - 0.5) < 0.01 for r in s.report().collect()) and s.assignment().count() == 3000
