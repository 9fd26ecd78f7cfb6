"""Skewed keys, intervals and references against brute force, with nulls, blanks, repeats, ties and empty tables."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from conftest import clash, rows
from pyspark.sql import functions as F

from tessitura.operators import intervals, references, skew

IDMAP = "pos long, list_name string, leftids string, rightids string, start int, stop int"
DIRTY = [None, "", " ", "seg_1", " SEG_1.wav ", "dir/a/Seg_1.SPH", "seg_2", "seg_2\t", "x/", ".wav"]


def bare(x):
    if x is None:
        return None
    x = x.strip().rsplit("/", 1)[-1].lower()
    for e in (".sph", ".wav", ".flac"):
        x = x.removesuffix(e) if x.endswith(e) else x
    return x.strip() or None


def random_idmap(n, seed=0):
    r = random.Random(seed)
    out = []
    for i in range(n):
        left = r.choice(["hot"] * 6 + ["warm"] * 2 + [f"k{r.randrange(20)}", None, "", " "])
        right = r.choice(DIRTY + [f"s{r.randrange(30)}" for _ in range(10)])
        a = r.choice([None, -1, *range(0, 60)])
        b = r.choice([None, -1, 5, *range(0, 60)])
        out.append((i, r.choice(["enrol", None]), left, right, a, b))
    return out + [(n + i, *x[1:]) for i, x in enumerate(out[:20])]


def exists(a, b):
    return a is not None and b is not None and a >= 0 and b > a


def brute_profile(data):
    acc = defaultdict(lambda: [0, set(), 0])
    for _, _, left, right, a, b in data:
        if left is None or not left.strip():
            continue
        acc[left][0] += 1
        if bare(right):
            acc[left][1].add(bare(right))
        acc[left][2] += b - a if exists(a, b) else 0
    return {k: (n, len(s), f) for k, (n, s, f) in acc.items()}


@pytest.mark.parametrize("tasks", [1, 3, 16])
def test_left_id_profile(spark, tasks):
    data = random_idmap(600)
    reg = spark.createDataFrame([("hot", "tel", None, None), ("hot", "tel", None, None), ("hot", "mic", None, None), (None, "x", None, None), ("zzz", "x", None, None)], "model_id string, corpus string, created_at timestamp, deleted_at timestamp")
    df = spark.createDataFrame(data, IDMAP)
    got = {r.leftids: (r.n_rows, r.n_segments, r.n_frames) for r in skew.left_id_profile(df, reg, tasks).collect()}
    assert got == brute_profile(data)
    hot = {r.leftids: (r.n_registered, r.corpus) for r in skew.left_id_profile(df, reg, tasks).collect()}
    assert hot["hot"] == (2, "mic") and hot["warm"] == (0, None)
    heavy = {r.leftids for r in skew.heavy_left_ids(df, reg, 10, tasks).collect()}
    assert heavy == {k for k, v in brute_profile(data).items() if v[0] * 100 >= len(data) * 10}


def test_left_id_profile_on_nothing(spark):
    reg = spark.createDataFrame([], "model_id string, corpus string, created_at timestamp, deleted_at timestamp")
    assert skew.left_id_profile(spark.createDataFrame([], IDMAP), reg).count() == 0
    assert skew.heavy_left_ids(spark.createDataFrame([(1, None, None, None, None, None)], IDMAP), reg).count() == 0


def test_loads_are_even_although_one_key_holds_most():
    plan = skew.pack([("hot", 100_000), ("warm", 9_000)], [50] * 160, 10)
    assert sum(plan.loads) == 117_000
    assert max(plan.loads) <= 1.1 * 117_000 / 10
    shards = [s for s in plan.shards if s[0] == "hot"]
    assert len(shards) == 9 and {s[1] for s in shards} == set(range(9)) and all(s[3] == 9 for s in shards)
    assert len({s[2] for s in shards}) == 9  # on tasks of their own


def brute_periods(data):
    by = defaultdict(set)
    for _, _, _, right, a, b in data:
        if bare(right) and exists(a, b):
            by[bare(right)].add((a, b))
    out = []
    for seg, iv in by.items():
        if len(iv) < 2:
            continue
        merged = []
        for a, b in sorted(iv):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out += [(seg, "period", a, b) for a, b in merged]
        out += [(seg, "gap", x[1], y[0]) for x, y in zip(merged, merged[1:])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("width", [1, 3, 7, 16, 1 << 16])
def test_periods_and_gaps(spark, width):
    for seed, n in ((0, 60), (1, 250), (2, 900)):
        data = random_idmap(n, seed)
        assert rows(intervals.segment_periods(spark.createDataFrame(data, IDMAP), width)) == brute_periods(data)


def test_periods_of_one_hot_entity_over_many_shards(spark):
    data = [(i, None, "a", "seg", i * 10, i * 10 + (10 if i % 7 else 3)) for i in range(500)] + [(999, None, "b", "seg", 1000, 2500), (1000, None, "b", "once", 3, 9)]
    assert rows(intervals.segment_periods(spark.createDataFrame(data, IDMAP), 64)) == brute_periods(data)
    one = intervals.segment_coverage(spark.createDataFrame(data, IDMAP), 64).collect()
    assert len(one) == 1 and one[0].covered + one[0].uncovered == 5000


def test_periods_on_nothing(spark):
    assert intervals.segment_periods(spark.createDataFrame([], IDMAP)).count() == 0
    only = [(1, None, "a", "s", 4, 4), (2, None, "a", "s", None, 5), (3, None, "a", None, 1, 5)]
    assert intervals.segment_periods(spark.createDataFrame(only, IDMAP)).count() == 0


def T(day):
    return None if day is None else dt.datetime(2021, 1, 1) + dt.timedelta(days=day)


def test_orphans(spark, monkeypatch):
    r = random.Random(4)
    parents = [(f"p{r.randrange(40)}", r.choice([None, *range(30)]), r.choice([None, *range(60)])) for _ in range(80)] + [(None, 1, None)]
    parents += parents[:5]
    refs = [(i, r.choice([f"p{r.randrange(60)}", f"p{r.randrange(3)}", None]), r.choice([None, *range(60)])) for i in range(500)]

    def cause(k, t):
        own = [(c, d) for p, c, d in parents if p == k]
        if not own:
            return "missing"
        if t is not None and any(c is not None and c <= t and (d is None or d > t) for c, d in own):
            return None
        first = [c for c, _ in own if c is not None]
        return "late" if t is not None and first and min(first) > t else "deleted"

    want = sorted((i, c) for i, k, t in refs if k is not None and (c := cause(k, t)))
    p = spark.createDataFrame([(k, T(c), T(d)) for k, c, d in parents], "key string, created_at timestamp, deleted_at timestamp")
    q = spark.createDataFrame([(i, k, T(t), "extra") for i, k, t in refs], "id long, key string, at timestamp, _first string")
    got = references.orphans(q.drop("_first"), p).select("id", "cause")
    assert sorted(tuple(x) for x in got.collect()) == want
    monkeypatch.setattr(references, "MAX_BLOCKS", 64)  # a saturated filter changes nothing
    many = p.unionByName(spark.range(20_000).selectExpr("concat('q', id) as key", "timestamp'2021-01-01' as created_at", "cast(null as timestamp) as deleted_at"))
    assert sorted(tuple(x) for x in references.orphans(q.drop("_first"), many).select("id", "cause").collect()) == want


def test_orphans_without_parents_or_references(spark):
    p = spark.createDataFrame([], "key string, created_at timestamp, deleted_at timestamp")
    q = spark.createDataFrame([(1, "a", T(3))], "id long, key string, at timestamp")
    assert [x.cause for x in references.orphans(q, p).collect()] == ["missing"]
    assert references.orphans(q.limit(0), p).count() == 0


def test_orphan_references_and_report(spark):
    scores = spark.createDataFrame([(1, "m", " S.WAV ", T(5)), (2, " ", None, T(5)), (3, "late", "s", T(1)), (4, "gone", "s", T(70))], "score_id long, modelset string, segset string, scored_at timestamp")
    key = spark.createDataFrame([(7, "m", "nope", T(2))], "key_id long, modelset string, segset string, keyed_at timestamp")
    models = spark.createDataFrame([("m", T(0), None), ("late", T(2), None), ("gone", T(0), T(60))], "model_id string, created_at timestamp, deleted_at timestamp")
    segs = spark.createDataFrame([("s", T(0), None)], "seg_id string, created_at timestamp, deleted_at timestamp")
    got = rows(references.orphan_references(scores, key, models, segs).select("tbl", "row_id", "field", "cause"))
    assert got == sorted([("scores", 3, "modelset", "late"), ("scores", 4, "modelset", "deleted"), ("trial_key", 7, "segset", "missing")], key=repr)
    report = rows(references.orphan_report(scores, key, models, segs))
    assert ("scores", "modelset", "deleted", "2021-03", 1) in report and len(report) == 3


def test_clashing_columns_change_nothing(spark):
    data = random_idmap(200, 8)
    df = spark.createDataFrame(data, IDMAP)
    reg = spark.createDataFrame([("hot", "tel", None, None)], "model_id string, corpus string, created_at timestamp, deleted_at timestamp")
    assert rows(skew.left_id_profile(clash(df), clash(reg), 3)) == rows(skew.left_id_profile(df, reg, 3))
    assert rows(intervals.segment_periods(clash(df), 8)) == rows(intervals.segment_periods(df, 8))
    scores = spark.createDataFrame([(1, "m", "S.WAV", T(5)), (2, "x", "s", T(5))], "score_id long, modelset string, segset string, scored_at timestamp")
    key = spark.createDataFrame([(7, "m", "nope", T(2))], "key_id long, modelset string, segset string, keyed_at timestamp")
    models = spark.createDataFrame([("m", T(0), None)], "model_id string, created_at timestamp, deleted_at timestamp")
    segs = spark.createDataFrame([("s", T(0), None)], "seg_id string, created_at timestamp, deleted_at timestamp")
    plain = references.orphan_references(scores, key, models, segs)
    assert rows(references.orphan_references(*[clash(x) for x in (scores, key, models, segs)])) == rows(plain) and plain.count() == 2


def test_one_interval_over_all_frames(spark):
    top = 2**31 - 1
    data = [(1, None, "a", "s", 0, top), (2, None, "b", "s", 5, 9), (3, None, "a", "t", 0, 3), (4, None, "a", "t", top - 1, top)]
    assert rows(intervals.segment_periods(spark.createDataFrame(data, IDMAP))) == brute_periods(data)


def test_split_join_is_the_plain_join(spark, monkeypatch):
    monkeypatch.setattr(skew, "PARTS", 12)
    r = random.Random(9)
    big = spark.createDataFrame([(i, r.choice(["hot"] * 5 + [None] * 3 + [f"k{r.randrange(40)}"] * 4), i % 7) for i in range(600)], "id long, key string, at long")
    small = spark.createDataFrame([("hot", 3, "a"), ("hot", 9, "b"), *[(f"k{i}", i % 9, "c") for i in range(0, 60, 2)], (None, 1, "d")], "key string, since long, v string")
    hot = skew.hot_keys(big, "key", 600)
    assert [x._hot_key for x in hot.collect()] == ["hot"] and hot.first()._hot_cut > 1
    where = F.col("since") <= F.col("at")
    for how in ("left", "inner", "left_anti", "left_semi"):
        got = skew.split_join(big, small, "key", hot, ["id"], how, where)
        want = big.join(small.withColumnRenamed("key", "other"), (F.col("key") == F.col("other")) & where, how).drop("other")
        assert rows(got.select(*want.columns)) == rows(want)
    placed = skew.split_join(big, small, "key", hot, ["id"]).where("key = 'hot'")
    assert placed.count() == 2 * big.where("key = 'hot'").count()
    assert skew.split_join(big.limit(0), small, "key", skew.hot_keys(big.limit(0), "key", 0), ["id"]).count() == 0


def test_filter_that_would_not_prune_is_left_out(spark, monkeypatch):
    assert references.passes(1 << 20, 1 << 20) < 0.01 and references.passes(200 << 20, 1 << 20) > references.USELESS
    p = spark.createDataFrame([("a", T(0), None)], "key string, created_at timestamp, deleted_at timestamp")
    q = spark.createDataFrame([(1, "a", T(3)), (2, "b", T(3)), (3, None, T(3)), (4, "a", None)], "id long, key string, at timestamp")
    want = rows(references.orphans(q, p).select("id", "cause"))
    monkeypatch.setattr(references, "USELESS", -1.0)
    assert rows(references.orphans(q, p).select("id", "cause")) == want == [(2, "missing"), (4, "deleted")]


def test_tables_of_workspaces_can_be_removed(spark):
    import os

    from tessitura import workspace

    ws = workspace.Workspace(spark, "gone")
    assert ws.write(spark.range(3), "t").count() == 3
    at = ws.path.removeprefix("file://").removeprefix("file:")
    assert os.path.isdir(at)
    workspace.clear()
    assert not os.path.exists(at)
