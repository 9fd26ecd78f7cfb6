"""Cutoffs and top segments against brute force."""

import random
from collections import defaultdict

from conftest import rows

from tessitura.llm import cutoffs, topn

SCORES = "score_id long, source string, modelset string, segset string, scoremask boolean, scoremat double"
KEY = "key_id long, modelset string, segset string, tar boolean, non boolean"


def data(seed=0, n=800):
    r = random.Random(seed)
    seg = lambda: r.choice(["s1", " S1.wav", "d/s1.SPH", None, "", *[f"s{i}" for i in range(12)]])
    model = lambda: r.choice(["hot"] * 5 + [None, " ", *[f"m{i}" for i in range(4)]])
    value = lambda: r.choice([None, float("nan"), float("inf"), float("-inf"), 1.0, 1.0, -0.0, 0.0, *[r.randrange(-20, 20) / 4 for _ in range(12)]])
    s = [(i, r.choice(["a"] * 4 + ["b", "c", None]), model(), seg(), r.choice([True] * 6 + [False, None]), value()) for i in range(n)]
    k = [(i, model(), seg(), r.choice([True, False, None]), r.choice([True, False, False, None])) for i in range(150)]
    return s, k


def bare(x):
    if x is None:
        return None
    x = x.strip().rsplit("/", 1)[-1].lower()
    for e in (".sph", ".wav"):
        x = x.removesuffix(e)
    return x or None


def valid(row):
    _, _, m, g, mask, v = row
    return mask is True and v is not None and v == v and abs(v) != float("inf") and m is not None and m.strip() and bare(g)


def brute_cutoffs(s, k, targets):
    lab = defaultdict(lambda: [False, False])
    for _, m, g, t, n in k:
        if m is not None and m.strip() and bare(g):
            lab[m, bare(g)][0] |= t is True
            lab[m, bare(g)][1] |= n is True
    out = {}
    for source, f in targets.items():
        rec = [(x[5], x[0], lab[x[2], bare(x[3])][0]) for x in s if valid(x) and x[1] == source and sum(lab[x[2], bare(x[3])]) == 1]
        for v in sorted({x[0] for x in rec}, reverse=True):
            if sum(x[0] >= v for x in rec) >= f * len(rec):
                out[source] = (v, {i for w, i, _ in rec if w >= v}, len(rec))
                break
    return out


def test_cutoffs(spark):
    targets = {"a": 0.3, "b": 0.5, "c": 1.0, "gone": 0.5}
    for seed in range(3):
        s, k = data(seed)
        want = brute_cutoffs(s, k, targets)
        t = spark.createDataFrame([*targets.items(), ("a", 0.1), ("b", None), (None, 0.5)], "source string, keep_fraction double")
        kept = cutoffs.keep_fraction(cutoffs.labelled_records(spark.createDataFrame(s, SCORES), spark.createDataFrame(k, KEY)), t)
        assert {r.source: (r.cutoff, r.n_records) for r in kept.cutoffs.collect()} == {q: (v, n) for q, (v, _, n) in want.items()}
        assert {r.score_id for r in kept.kept().collect()} == set().union(*[i for _, i, _ in want.values()])
        report = cutoffs.cutoff_report(spark.createDataFrame(s, SCORES), spark.createDataFrame(k, KEY), t).collect()
        assert all(r.n_kept == r.n_target + r.n_nontarget == len(want[r.source][1]) for r in report)


def test_cutoff_of_equal_scores_across_partitions(spark):
    rec = spark.range(3000).selectExpr("id as score_id", "'a' as source", "if(id < 2900, 1.0D, 2.0D) as scoremat", "true as is_target")
    t = spark.createDataFrame([("a", 0.5)], "source string, keep_fraction double")
    kept = cutoffs.keep_fraction(rec, t)
    assert kept.cutoffs.first().cutoff == 1.0 and kept.kept().count() == 3000
    for f, n in ((0.0, 100), (-1.0, 100), (7.0, 3000)):
        assert cutoffs.keep_fraction(rec, spark.createDataFrame([("a", f)], "source string, keep_fraction double")).kept().count() == n


def test_cutoffs_on_nothing(spark):
    t = spark.createDataFrame([("a", 0.5)], "source string, keep_fraction double")
    kept = cutoffs.keep_fraction(cutoffs.labelled_records(spark.createDataFrame([], SCORES), spark.createDataFrame([], KEY)), t)
    assert kept.cutoffs.count() == 0 and kept.kept().count() == 0
    s, k = data(1)
    none = cutoffs.keep_fraction(cutoffs.labelled_records(spark.createDataFrame(s, SCORES), spark.createDataFrame(k, KEY)), t.limit(0))
    assert none.kept().count() == 0


def test_top_segments(spark):
    for seed in range(3):
        s, _ = data(seed)
        best = {}
        for row in s:
            if valid(row):
                key = row[2], bare(row[3])
                best[key] = min(best.get(key, (float("inf"), 0)), (-row[5], row[0]))
        want = []
        for m in {m for m, _ in best}:
            top = sorted((v, i) for (mm, _), (v, i) in best.items() if mm == m)[:5]
            want += [(m, i, r + 1) for r, (_, i) in enumerate(top)]
        df = spark.createDataFrame(s, SCORES).withColumn("rank", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("clash"))
        assert rows(topn.top_segments(df, 5).select("modelset", "score_id", "rank")) == sorted(want, key=repr)
    assert topn.top_segments(spark.createDataFrame([], SCORES)).count() == 0


def test_group_limit_prunes_before_and_after_the_shuffle(spark):
    s, _ = data(0)
    plan = topn.top_segments(spark.createDataFrame(s, SCORES), 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 4
