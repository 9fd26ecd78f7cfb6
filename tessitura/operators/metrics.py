"""Detection metrics: ROC, convex hull, equal error rate, detection cost, and related numbers.

Input is (score, is_target) with optional group columns (a system, a condition). Scores are first collapsed
to distinct values, running counts are distributed, and convex hulls are taken per block before the hull
of the remaining vertices, so no step holds all scores in one task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tessitura.operators.prefix import running
from tessitura.workspace import Workspace

# -- scalar functions -----------------------------------------------------------------------------


def effective_prior(p_target: Column | float, c_miss: Column | float, c_fa: Column | float) -> Column:
    """Prior that gives with unit costs the decision of ``p_target`` with these costs."""
    p, m, a = (x if isinstance(x, Column) else F.lit(float(x)) for x in (p_target, c_miss, c_fa))
    return p * m / (p * m + (1 - p) * a)


def logit(p: Column) -> Column:
    """ln(p / (1 - p)); -inf at 0 and inf at 1."""
    return F.when(p == 0, F.lit(float("-inf"))).when(p == 1, F.lit(float("inf"))).otherwise(F.ln(p / (1 - p)))


def logit_effective_prior(p_target: Column | float, c_miss: Column | float, c_fa: Column | float) -> Column:
    return logit(effective_prior(p_target, c_miss, c_fa))


def sigmoid(x: Column) -> Column:
    """1 / (1 + exp(-x)), safe for large arguments."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


# Coefficients of the rational approximations of the normal quantile (algorithm AS 241), constant term first:
# near one half, and for the tails by the root of minus the logarithm, near and far.
CENTRE = (
    (3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125, 45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727),
    (1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077, 21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610),
)
NEAR = (
    (1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504, 1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 0.000774545014278341407640),
    (1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550, 0.148103976427480074590, 0.0151986665636164571966, 0.000547593808499534494600, 1.05075007164441684324e-9),
)
FAR = (
    (6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230, 0.0265321895265761230930, 0.00124266094738807843860, 0.0000271155556874348757815, 2.01033439929228813265e-7),
    (1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525, 0.000786869131145613259100, 0.0000184631831751005468180, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)


def normal_quantile(p: np.ndarray) -> np.ndarray:
    """Quantile of the standard normal distribution; infinite at 0 and 1, NaN outside."""
    p = np.asarray(p, dtype=np.float64)

    def ratio(c: tuple, x: np.ndarray) -> np.ndarray:
        return np.polyval(c[0][::-1], x) / np.polyval(c[1][::-1], x)

    q = p - 0.5
    with np.errstate(all="ignore"):
        r = np.sqrt(-np.log(np.minimum(p, 1 - p)))
        tail = np.where(r <= 5, ratio(NEAR, r - 1.6), ratio(FAR, r - 5))
        out = np.where(np.abs(q) <= 0.425, q * ratio(CENTRE, 0.180625 - q**2), np.sign(q) * tail)
    return np.select([p == 0, p == 1, (p > 0) & (p < 1)], [-np.inf, np.inf, out], np.nan)


@F.pandas_udf(DoubleType())
def probit(p: pd.Series) -> pd.Series:
    """Normal quantile; infinite at 0 and 1, null outside."""
    x = normal_quantile(p.to_numpy(dtype=np.float64))
    return pd.Series(x, dtype="Float64").mask(np.isnan(x))


# -- ROC ------------------------------------------------------------------------------------------


def roc_points(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, score, n_miss, n_fa, p_miss, p_fa) after rejecting everything up to each distinct score,
    and a first point with null score where all are accepted. Null and NaN scores and labels are left out.

    A group without targets has null p_miss, without nontargets null p_fa.
    """
    by = by or []
    clean = scores.where(F.col("score").isNotNull() & ~F.isnan("score") & F.col("is_target").isNotNull())
    steps = clean.groupBy(*by, "score").agg(F.count_if("is_target").alias("t"), F.count_if(~F.col("is_target")).alias("n"))
    steps = Workspace(scores.sparkSession, "roc").write(steps, "steps")  # read for the order, the sums and the totals
    ran = running(steps, ["score"], {"n_miss": "t", "n_rejected": "n"}, by)
    totals = steps.groupBy(*by).agg(F.sum("t").alias("_targets"), F.sum("n").alias("_nontargets"))
    cols = [F.col("n_miss"), F.col("n_fa"), F.try_divide(F.col("n_miss").cast("double"), F.col("_targets")).alias("p_miss"), F.try_divide(F.col("n_fa").cast("double"), F.col("_nontargets")).alias("p_fa")]
    first = totals.withColumns({"score": F.lit(None).cast("double"), "n_miss": F.lit(0).cast("long"), "n_fa": F.col("_nontargets")})
    if by:
        on = [ran[c].eqNullSafe(totals[c]) for c in by]
        later = ran.join(totals, on).drop(*[totals[c] for c in by])
    else:
        later = ran.join(F.broadcast(totals))
    later = later.withColumn("n_fa", F.col("_nontargets") - F.col("n_rejected"))
    return first.select(*by, "score", *cols).unionByName(later.select(*by, "score", *cols))


def roc_steps(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Uncollapsed ROC: one point for every score, ties target first, besides the first where all are accepted."""
    by = by or []
    clean = scores.where(F.col("score").isNotNull() & F.col("is_target").isNotNull())
    marked = clean.select(*by, "score", F.col("is_target").cast("int").alias("t"), (~F.col("is_target")).cast("int").alias("n"))
    ran = running(marked, ["score", F.col("t").desc()], {"n_miss": "t", "n_rejected": "n"}, by)
    return ran.select(*by, "score", "n_miss", "n_rejected")


def min_dcf(roc: DataFrame, prior: float, by: list[str] | None = None, normalize: bool = False) -> DataFrame:
    """Least P * p_miss + (1 - P) * p_fa over the ROC (equal to that over its convex hull)."""
    cost = prior * F.col("p_miss") + (1 - prior) * F.col("p_fa")
    scale = min(prior, 1 - prior) if normalize else 1.0
    return roc.groupBy(*(by or [])).agg((F.min(cost) / scale).alias("min_dcf"))


def _hull(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Indices of the lower-left convex hull, points by falling x; corners only."""
    order = np.lexsort((y, -x))
    keep: list[int] = []
    for i in order:
        while len(keep) >= 2:
            a, b = keep[-2], keep[-1]
            if (x[b] - x[a]) * (y[i] - y[a]) - (y[b] - y[a]) * (x[i] - x[a]) >= 0:
                keep.pop()
            else:
                break
        if keep and x[keep[-1]] == x[i]:
            continue
        keep.append(i)
    return np.array(keep, dtype=int)


def rocch(roc: DataFrame, by: list[str] | None = None, block: int = 100_000) -> DataFrame:
    """Vertices (by, n_miss, n_fa, p_miss, p_fa) of the ROC convex hull.

    Hulls of blocks of neighbouring points come first: only their vertices meet in one task per group.
    """
    by = by or []
    cols = [*by, "n_miss", "n_fa", "p_miss", "p_fa"]
    schema = roc.select(*cols).schema

    def hull(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.iloc[_hull(pdf["n_fa"].to_numpy(np.float64), pdf["n_miss"].to_numpy(np.float64))]

    points = roc.where(F.col("p_miss").isNotNull() & F.col("p_fa").isNotNull()).select(*cols)
    points = points.withColumn("_block", F.floor((F.col("n_miss") - F.col("n_fa")) / block))  # grows along the curve
    part = points.groupBy(*by, "_block").applyInPandas(lambda p: hull(p)[cols], schema)
    return part.withColumn("_all", F.lit(0)).groupBy(*by, "_all").applyInPandas(lambda p: hull(p)[cols], schema)


def eer(hull: DataFrame, by: list[str] | None = None, miss: str = "p_miss", fa: str = "p_fa") -> DataFrame:
    """Equal error rate of the ROC convex hull: where it crosses the diagonal. With the counts ``n_miss`` and
    ``n_fa`` it is the precision-recall break-even point."""
    by = by or []
    w = Window.partitionBy(*(by or [F.lit(1)])).orderBy(F.col(fa).desc(), F.col(miss))
    m, f, m0, f0 = F.col(miss).cast("double"), F.col(fa).cast("double"), F.col("_m0"), F.col("_f0")
    steps = hull.withColumns({"_m0": F.lag(F.col(miss).cast("double")).over(w), "_f0": F.lag(F.col(fa).cast("double")).over(w)})
    across = steps.where((m0 <= f0) & (m >= f))
    gap = (f0 - m0) + (m - f)
    value = F.when(gap == 0, f0).otherwise((f0 * m - f * m0) / gap)
    return across.groupBy(*by).agg(F.max(value).alias("prbep" if miss == "n_miss" else "eer"))


def doddington_30(key: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rates below which an error estimate rests on fewer than 30 errors."""
    t, n = F.count_if("is_target"), F.count_if(~F.col("is_target"))
    return key.groupBy(*(by or [])).agg(F.try_divide(F.lit(30.0), t).alias("p_miss_30"), F.try_divide(F.lit(30.0), n).alias("p_fa_30"))


def det_curve(hull: DataFrame, by: list[str] | None = None, points: int = 100, box: tuple[float, float, float, float] = (0.0005, 0.5, 0.0005, 0.5)) -> DataFrame:
    """(by, x, y): probit of p_fa and p_miss on every hull segment clipped to ``box`` (pfa_min, pfa_max,
    pmiss_min, pmiss_max), ``points`` + 1 points a segment."""
    by = by or []
    w = Window.partitionBy(*(by or [F.lit(1)])).orderBy(F.col("p_fa").desc(), "p_miss")
    seg = hull.withColumns({"x0": F.lag("p_fa").over(w), "y0": F.lag("p_miss").over(w)}).where("x0 is not null")
    x0, y0, dx, dy = F.col("x0"), F.col("y0"), F.col("p_fa") - F.col("x0"), F.col("p_miss") - F.col("y0")

    def bound(lo: float, hi: float, at: Column, d: Column) -> tuple[Column, Column]:
        a, b = F.try_divide(F.lit(lo) - at, d), F.try_divide(F.lit(hi) - at, d)
        inside = (at >= lo) & (at <= hi)
        none = F.when(inside, F.lit(0.0)).otherwise(F.lit(2.0))
        return F.when(d == 0, none).otherwise(F.least(a, b)), F.when(d == 0, F.lit(1.0)).otherwise(F.greatest(a, b))

    (a1, b1), (a2, b2) = bound(box[0], box[1], x0, dx), bound(box[2], box[3], y0, dy)
    seg = seg.withColumns({"_a": F.greatest(F.lit(0.0), a1, a2), "_b": F.least(F.lit(1.0), b1, b2)}).where("_a < _b")
    t = F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("i") / points
    at = seg.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points))))
    return at.select(*by, probit(x0 + t * dx).alias("x"), probit(y0 + t * dy).alias("y"))


def pav(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic (non-decreasing) regression of ``y`` and the width of every pool; equal neighbours pool."""
    level, width = [], []
    for v in np.asarray(y, dtype=np.float64):
        level.append(v)
        width.append(1)
        while len(level) > 1 and level[-2] >= level[-1]:
            w = width[-2] + width[-1]
            level[-2] = (level[-2] * width[-2] + level[-1] * width[-1]) / w
            width[-2] = w
            level.pop()
            width.pop()
    return np.repeat(level, width), np.array(width, dtype=int)


def pav_pools(roc: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, upto_score, n_target, n_nontarget, p): the pools of the isotonic regression of labels on scores, those of equal
    scores being one. They are the edges of the ROC's convex hull, found block by block, so no task pools all scores.

    ``upto_score`` is the highest score of a pool, null for the last one, which has no upper end.
    """
    by = by or []
    hull = rocch(roc, by).select(*by, "n_miss", "n_fa")
    top = roc.groupBy(*by).agg(F.max("n_miss").alias("n_miss"), F.lit(0).cast("long").alias("n_fa"))
    marks = hull.unionByName(top).distinct()  # above the last nontarget the hull ends, the regression does not
    scored = roc.groupBy(*by, "n_miss", "n_fa").agg(F.max("score").alias("upto_score"))
    on = [marks[c].eqNullSafe(scored[c]) for c in by] + [marks[c] == scored[c] for c in ("n_miss", "n_fa")]
    marks = marks.join(scored, on, "left").select(*[marks[c] for c in (*by, "n_miss", "n_fa")], "upto_score")
    w = Window.partitionBy(*(by or [F.lit(1)])).orderBy(F.col("n_fa").desc(), "n_miss")
    t, n = F.col("n_miss") - F.lag("n_miss").over(w), F.lag("n_fa").over(w) - F.col("n_fa")
    last = F.lead("n_fa").over(w).isNull()
    pools = marks.select(*by, F.when(~last, F.col("upto_score")).alias("upto_score"), t.alias("n_target"), n.alias("n_nontarget"))
    return pools.where("n_target + n_nontarget > 0").withColumn("p", F.col("n_target") / (F.col("n_target") + F.col("n_nontarget")))


def filter_points(roc: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The ROC without the inner points of its horizontal and vertical runs: a point stays unless others with the same
    ``n_miss`` lie on both sides of it, or others with the same ``n_fa``."""
    by = by or []
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_{c}") for c in by] + [F.col(c).isNull().alias(f"_null_{c}") for c in by]
    marked = roc.select("*", *keys)
    names = [f"_{c}" for c in by] + [f"_null_{c}" for c in by]
    for a, b in (("n_miss", "n_fa"), ("n_fa", "n_miss")):
        ends = marked.groupBy(*names, a).agg(F.min(b).alias(f"_lo_{b}"), F.max(b).alias(f"_hi_{b}"))
        marked = marked.join(ends, [*names, a])
    inner = [(F.col(c) > F.col(f"_lo_{c}")) & (F.col(c) < F.col(f"_hi_{c}")) for c in ("n_fa", "n_miss")]
    return marked.where(~(inner[0] | inner[1])).select(*roc.columns)


def filter_roc(p_miss: np.ndarray, p_fa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leaves out the inner points of horizontal and vertical runs, compared with the last point kept."""
    keep = [0]
    for i in range(1, len(p_miss)):
        if p_miss[i] == p_miss[keep[-1]] or p_fa[i] == p_fa[keep[-1]]:
            nxt = i + 1
            if nxt < len(p_miss) and (p_miss[nxt] == p_miss[keep[-1]] or p_fa[nxt] == p_fa[keep[-1]]):
                continue
        keep.append(i)
    return np.asarray(p_miss)[keep], np.asarray(p_fa)[keep]


# -- likelihood ratios and evaluation -------------------------------------------------------------


def closed_set_llr(scores: DataFrame, p_target: float = 0.5, by: list[str] | None = None) -> DataFrame:
    """Log-likelihood ratio of every class against the others of the same segment, within groups of ``by``.

    ln p + s_i - ln sum over j != i of exp(s_j) (1 - p) / (n - 1). The others of a single best class are summed
    apart, by the largest of them: as a difference from the whole they would vanish beside it.
    A segment with one class has a null ratio.
    """
    by = by or []
    keys = [*by, "seg_id"]

    def joined(df: DataFrame, sums: DataFrame) -> DataFrame:
        sums = sums.withColumnsRenamed({c: f"_by_{c}" for c in keys})
        on = [df[c].eqNullSafe(sums[f"_by_{c}"]) for c in by] + [df["seg_id"] == sums["_by_seg_id"]]
        return df.join(sums, on).drop(*[f"_by_{c}" for c in keys])

    score, m, m2 = F.col("score"), F.col("_m"), F.col("_m2")
    x = joined(scores, scores.groupBy(*keys).agg(F.max("score").alias("_m"), F.count(F.lit(1)).alias("_n")))
    x = joined(x, x.groupBy(*keys).agg(F.max(F.when(score < m, score)).alias("_m2"), F.count_if(score == m).alias("_k")))
    x = joined(x, x.groupBy(*keys).agg(F.sum(F.when(score < m, F.exp(score - m2))).alias("_s")))
    lower = F.coalesce(F.col("_s") * F.exp(m2 - m), F.lit(0.0))
    others = F.when(score < m, m + F.ln(F.col("_k") + lower - F.exp(score - m))).when(F.col("_k") > 1, m + F.ln(F.col("_k") - 1 + lower)).otherwise(m2 + F.ln("_s"))
    ratio = F.when(F.col("_n") > 1, math.log(p_target) + score - others - F.ln((1 - p_target) / (F.col("_n") - 1)))
    return x.select(*by, "model_id", "seg_id", ratio.alias("llr"))


def evaluations(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Accuracy in per cent, mean squared error and squared correlation of predictions."""
    y, v = F.col(truth).cast("double"), F.col(predicted).cast("double")
    return df.agg((100 * F.avg((y == v).cast("double"))).alias("accuracy"), F.avg((y - v) ** 2).alias("mse"), (F.corr(y, v) ** 2).alias("scc"))


# Axis limits (false alarm, then miss) of the usual windows.
PLOT_WINDOWS = {
    "new": (0.000005, 0.005, 0.01, 0.99),
    "old": (0.0005, 0.5, 0.0005, 0.5),
    "big": (0.000005, 0.99, 0.000005, 0.99),
    "sre10": (0.000003, 0.5, 0.0003, 0.9),
}
