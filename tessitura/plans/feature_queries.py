"""Queries of vector statistics, scoring and frame operators."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessitura.operators import frames as FR
from tessitura.operators import scoring as SC
from tessitura.operators import stats as ST
from tessitura.operators import trials as T
from tessitura.operators import vectors as VE
from tessitura.plans import views as V
from tessitura.plans.tables import table
from tessitura.workspace import Workspace

R, EPS = 6, 1.3e-9


def _cells(df, *keys, column="v"):
    """One row per coefficient. EPS keeps means of round numbers off the ties of rounding."""
    return df.select(*keys, F.posexplode(column).alias("i", "x")).select(*keys, "i", F.round(F.col("x") + EPS, R).alias("x"))


def _matrix(spark, m):
    rows = [(i, j, round(float(m[i, j]), R) + 0.0) for i in range(len(m)) for j in range(len(m))]  # dim x dim
    return spark.createDataFrame(rows, "i int, j int, cov double")


def vectors_length_norm(s, d):
    return _cells(V.sessions(s, d).select("pos", VE.length_norm("stat1").alias("v")), "pos")


def vectors_center(s, d):
    return _cells(VE.center(V.sessions(s, d).select("pos", "stat0", "stat1"), np.arange(64) / 64), "pos", column="stat1")


def vectors_whiten_diag(s, d):
    x = V.sessions(s, d).select("pos", F.col("stat1").alias("v"))
    return _cells(VE.whiten_diag(x, "v", np.arange(64) / 64, 1 + np.arange(64) / 16), "pos")


def vectors_rotate(s, d):
    """Reversal of coefficients and a scaling, as a matrix product."""
    r = np.eye(64)[::-1] * 0.5
    return _cells(VE.rotate(V.sessions(s, d).select("pos", F.col("stat1").alias("v")), "v", r), "pos")


def vectors_posteriors(s, d):
    return _cells(V.sessions(s, d).select("pos", VE.posteriors("stat1").alias("v")), "pos")


def sessions_subtract_weighted(s, d):
    x = V.sessions(s, d)
    one = x.groupBy("seg_id").agg(F.min_by("stat1", "pos").alias("other"))
    return _cells(x.join(one, "seg_id").select("pos", VE.weighted_subtract("stat1", "stat0", "other").alias("v")), "pos")


def stats_sum_per_model(s, d):
    out = ST.sum_per_model(V.sessions(s, d))
    return _cells(out.select("model_id", "n_sessions", F.col("stat1").alias("v")), "model_id", "n_sessions")


def stats_mean_per_model(s, d):
    return _cells(ST.mean_per_model(V.sessions(s, d)).select("model_id", F.col("stat1").alias("v")), "model_id")


def stats_mean(s, d):
    m = ST.mean(V.sessions(s, d))
    return s.createDataFrame([(i, round(float(x), R) + 0.0) for i, x in enumerate(m)], "i int, x double")


def stats_total_covariance(s, d):
    return _matrix(s, ST.total_covariance(V.sessions(s, d)))


def stats_within_covariance(s, d):
    return _matrix(s, ST.within_covariance(V.sessions(s, d)))


def stats_between_covariance(s, d):
    return _matrix(s, ST.between_covariance(V.sessions(s, d)))


def map_adapt(s, d):
    out = ST.map_adapt(V.sessions(s, d), np.full((1, 64), 0.25))
    return _cells(out.select("pos", F.col("stat1").alias("v")), "pos")


def map_adapt_multisession(s, d):
    out = ST.map_adapt_multisession(V.sessions(s, d), np.full((1, 64), 0.25))
    return _cells(out.select("model_id", F.col("stat1").alias("v")), "model_id")


def _scoring(s, d, *columns):
    """Written once: trials, enrolled means and tests all read it."""
    return Workspace(s, "sessions").write(V.sessions(s, d).select("pos", "model_id", "seg_id", "stat0", "stat1", *columns), "sessions")


def _trials(x):
    """Every session's segment against its own model and against the next model in order."""
    own = T.trial_index(x)
    index = T.model_index(x)
    n = index.count()
    following = index.select(F.col("model_id").alias("next"), F.pmod(F.col("model_idx") - 1, F.lit(n)).alias("model_idx"))
    shifted = own.join(index, "model_id").join(following, "model_idx").select(F.col("next").alias("model_id"), "seg_id")
    return T.merge_indexes(own, shifted)


def _sides(x):
    return SC.mean_of(x), SC.first_of(x, "seg_id")


def score_cosine(s, d):
    x = _scoring(s, d)
    return SC.cosine(_trials(x), *_sides(x)).withColumn("score", F.round("score", R))


def score_mahalanobis(s, d):
    """With a diagonal matrix, so that SQL can express it."""
    x = _scoring(s, d)
    return SC.mahalanobis(_trials(x), *_sides(x), np.diag(1 / (1 + np.arange(64)))).withColumn("score", F.round("score", R))


def score_svm(s, d):
    x = _scoring(s, d)
    enroll, test = _sides(x)
    return SC.svm(_trials(x), enroll.select("model_id", F.col("v").alias("w"), F.lit(-0.5).alias("b")), test).withColumn("score", F.round("score", R))


def _frames(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(s, d, "events").select("event_id", "user_id", "ts", "value", "event_type", F.get_json_object("props", "$.k").cast("double").alias("k"))
    return e.select(
        F.col("user_id").cast("string").alias("show"), (F.row_number().over(w) - 1).cast("long").alias("frame_idx"), F.ln("value").alias("energy"),
        F.array("value", "k").alias("cep"), (F.col("event_type") != "error").alias("vad"), F.col("value").alias("x"),
    )


def _out(df, column="cep"):
    return _cells(df.select("show", "frame_idx", F.col(column).alias("v")), "show", "frame_idx")


def frames_delta(s, d):
    return _out(FR.delta(_frames(s, d)), "delta")


def frames_sdc(s, d):
    return _out(FR.shifted_delta(_frames(s, d), d=1, p=3, k=3))


def frames_context(s, d):
    return _out(FR.context(_frames(s, d), 2, 2), "context")


def frames_cms(s, d):
    return _out(FR.cms(_frames(s, d), speech=F.col("vad")))


def frames_cmvn(s, d):
    return _out(FR.cmvn(_frames(s, d), speech=F.col("vad")))


def frames_sliding_norm(s, d):
    return _out(FR.sliding_norm(_frames(s, d), 2, win=31, reduce=True))


def frames_vad_percentile(s, d):
    return FR.vad_percentile(_frames(s, d), 30.0).select("show", "frame_idx", "vad")


def frames_smooth_labels(s, d):
    return FR.smooth_labels(_frames(s, d)).select("show", "frame_idx", "vad")


def frames_labels_to_intervals(s, d):
    return FR.labels_to_intervals(_frames(s, d).select("show", "frame_idx", "vad"))


def frames_intervals_to_frames(s, d):
    return FR.intervals_to_frames(frames_labels_to_intervals(s, d))


def frames_pre_emphasis(s, d):
    return FR.pre_emphasis(_frames(s, d), 0.97).select("show", "frame_idx", F.round(F.col("x") + EPS, R).alias("x"))


def frames_framing(s, d):
    return _cells(FR.framing(_frames(s, d), 25, 10), "show", "frame", column="samples")


def frames_segments(s, d):
    """Frames 10 before the start to 10 after the end of every third show."""
    b = FR.bounds(_frames(s, d)).select("show", F.lit(-10).cast("long").alias("start"), (F.col("_last") + 11).alias("stop"), F.concat(F.lit("s"), "show").alias("seg_id"))
    return FR.segment_frames(_frames(s, d).select("show", "frame_idx", "x"), b).select("seg_id", "frame", "x")


def frames_tandem(s, d):
    f = _frames(s, d)
    return _out(FR.tandem(f, FR.cms(f)))


def frames_moments(s, d):
    m = ST.frame_moments(_frames(s, d), ["show"])
    return _cells(m.select("show", "n", F.concat("sum_x", "sum_xx").alias("v")), "show", "n")


QUERIES = {
    f.__name__: f
    for f in (
        vectors_length_norm, vectors_center, vectors_whiten_diag, vectors_rotate, vectors_posteriors, sessions_subtract_weighted,
        stats_sum_per_model, stats_mean_per_model, stats_mean, stats_total_covariance, stats_within_covariance, stats_between_covariance,
        map_adapt, map_adapt_multisession, score_cosine, score_mahalanobis, score_svm,
        frames_delta, frames_sdc, frames_context, frames_cms, frames_cmvn, frames_sliding_norm, frames_vad_percentile, frames_smooth_labels, frames_labels_to_intervals, frames_intervals_to_frames, frames_pre_emphasis, frames_framing,
        frames_segments, frames_tandem, frames_moments,
    )
}
# SHOW is a keyword in SQL: results name the column show_id
QUERIES |= {k: (lambda s, d, f=f: f(s, d).withColumnRenamed("show", "show_id")) for k, f in QUERIES.items() if k.startswith("frames_")}

_SS = V.SESSIONS
_U = f"{_SS}, u as (select pos, model_id, seg_id, unnest(range(64)) as i, unnest(stat1) as x from ss)"
_PM = f"{_U}, m as (select model_id, i, avg(x) as m, sum(x) as s, count(*) as n from u group by all)"
_ROUND = f", {R})"
_NEXT = """ix as (select model_id, row_number() over (order by model_id) - 1 as k, count(*) over () as n from (select distinct model_id from ss)),
 own as (select distinct model_id, seg_id from ss),
 tr as (select * from own union select b.model_id, own.seg_id from own join ix a using (model_id) join ix b on b.k = (a.k + 1) % a.n)"""
_PAIR = f"""{_PM}, e as (select model_id, list(m order by i) as v from m group by 1), t as (select seg_id, arg_min(stat1, pos) as v from ss group by 1), {_NEXT}"""
_FR = """fr as (select user_id::varchar as show, row_number() over (partition by user_id order by ts, event_id) - 1 as t, ln(value) as energy, value as x,
  json_extract_string(props, '$.k')::double as k, event_type <> 'error' as vad from events),
 c as (select show, t, vad, 0 as i, x from fr union all select show, t, vad, 1, k from fr),
 b as (select show, max(t) as last from fr group by 1)"""


def _lagged(taps, clamp: bool) -> str:
    joins = " ".join(f"left join c c{n} on c{n}.show = c.show and c{n}.i = c.i and c{n}.t = " + (f"least(greatest(c.t + ({o}), 0), last)" if clamp else f"c.t + ({o})") for n, (o, _) in enumerate(taps))
    return joins


_DELTA = [(k - 3, w) for k, w in enumerate(FR.DELTA) if w]


def _at(o: int) -> str:
    return f"(select c.*, d.x as y from c join b using (show) join c d on d.show = c.show and d.i = c.i and d.t = least(greatest(c.t + ({o}), 0), last))"


_SDC = " union all ".join([f"select show, t as frame_idx, i, x from c"] + [f"select p.show, p.t, 2 + 2 * {n} + p.i, p.y - q.y from {_at(3 * n + 1)} p join {_at(3 * n - 1)} q using (show, t, i)" for n in range(3)])
_RUNS = "rn as (select show, t, t - row_number() over (partition by show order by t) as g from fr where vad), iv as (select show, min(t) / 100 as t_start, (max(t) + 1) / 100 as t_stop, 'speech' as label from rn group by show, g)"
SQL = {
    "vectors_length_norm": f"with {_U} select pos, i, round(x / greatest(sqrt(sum(x * x) over (partition by pos)), 1e-8), {R}) as x from u",
    "vectors_center": f"with {_U} select u.pos, i, round(x - ss.stat0[1] * i / 64, {R}) as x from u join ss using (pos)",
    "vectors_whiten_diag": f"with {_U} select pos, i, round((x - i / 64) / sqrt(1 + i / 16), {R}) as x from u",
    "vectors_rotate": f"with {_U} select pos, 63 - i as i, round(x * 0.5, {R}) as x from u",
    "vectors_posteriors": f"with {_U}, e as (select pos, i, exp(x - max(x) over (partition by pos)) as e from u) select pos, i, round(e / sum(e) over (partition by pos), {R}) as x from e",
    "sessions_subtract_weighted": f"with {_U}, o as (select seg_id, arg_min(stat1, pos) as o from ss group by 1) select u.pos, i, round(x - ss.stat0[1] * o[i + 1], {R}) as x from u join o using (seg_id) join ss using (pos)",
    "stats_sum_per_model": f"with {_PM} select model_id, n as n_sessions, i, round(s, {R}) as x from m",
    "stats_mean_per_model": f"with {_PM} select model_id, i, round(m, {R}) as x from m",
    "stats_mean": f"with {_U} select i, round(avg(x), {R}) as x from u group by 1",
    "stats_total_covariance": f"with {_U} select a.i, b.i as j, round(covar_pop(a.x, b.x), {R}) as cov from u a join u b using (pos) group by 1, 2",
    "stats_within_covariance": f"with {_PM}, z as (select pos, i, x - m as x from u join m using (model_id, i)) select a.i, b.i as j, round(sum(a.x * b.x) / (select count(*) from ss), {R}) as cov from z a join z b using (pos) group by 1, 2",
    "stats_between_covariance": f"with {_PM}, g as (select i, avg(x) as g from u group by 1), z as (select model_id, i, n, m - g as x from m join g using (i)) select a.i, b.i as j, round(sum(a.n * a.x * b.x) / (select count(*) from ss), {R}) as cov from z a join z b using (model_id) group by 1, 2",
    "map_adapt": f"with {_U} select u.pos, i, round(x / (stat0[1] + 16) + 16 / (stat0[1] + 16) * 0.25, {R}) as x from u join ss using (pos)",
    "map_adapt_multisession": f"with {_PM}, z as (select model_id, sum(stat0[1]) as n0 from ss group by 1) select model_id, i, round(s / (n0 + 16) + 16 / (n0 + 16) * 0.25, {R}) as x from m join z using (model_id)",
    "score_cosine": f"with {_PAIR} select model_id, seg_id, round(list_cosine_similarity(e.v, t.v), {R}) as score from tr join e using (model_id) join t using (seg_id)",
    "score_mahalanobis": f"with {_PAIR} select model_id, seg_id, round(-0.5 * list_sum(list_transform(range(64), lambda i: (e.v[i + 1] - t.v[i + 1]) ** 2 / (1 + i))), {R}) as score from tr join e using (model_id) join t using (seg_id)",
    "score_svm": f"with {_PAIR} select model_id, seg_id, round(list_inner_product(e.v, t.v) - 0.5, {R}) as score from tr join e using (model_id) join t using (seg_id)",
    "frames_delta": f"with {_FR} select c.show, c.t as frame_idx, c.i, round({' + '.join(f'{w} * coalesce(c{n}.x, 0)' for n, (_, w) in enumerate(_DELTA))}, {R}) as x from c {_lagged(_DELTA, False)}",
    "frames_sdc": f"with {_FR} select show, frame_idx, i, round(x, {R}) as x from ({_SDC})",
    "frames_context": f"with {_FR} select * from (" + " union all ".join(f"select show, t as frame_idx, {2 * (o + 2)} + i as i, round(y, {R}) as x from {_at(o)}" for o in range(-2, 3)) + ")",
    "frames_cms": f"with {_FR}, m as (select show, i, avg(x) as m from c where vad group by 1, 2) select show, t as frame_idx, i, round(x - coalesce(m, 0), {R}) as x from c left join m using (show, i)",
    "frames_cmvn": f"with {_FR}, m as (select show, i, avg(x) as m, stddev_pop(x) as s from c where vad group by 1, 2) select show, t as frame_idx, i, round((x - coalesce(m, 0)) / coalesce(nullif(s, 0), 1), {R}) as x from c left join m using (show, i)",
    "frames_sliding_norm": f"""with {_FR}, w as (select show, t, i, avg(x) over v as m, stddev_samp(x) over v as s from c window v as (partition by show, i order by t rows between 15 preceding and 15 following)),
 a as (select show, i, avg(x) as m, stddev_samp(x) as s from c group by 1, 2)
 select show, c.t as frame_idx, i, round((x - case when last + 1 < 31 then a.m else w.m end) / coalesce(nullif(case when last + 1 < 31 then a.s else w.s end, 0), 1), {R}) as x
 from c join b using (show) join a using (show, i) join w using (show, i) where w.t = case when last + 1 < 31 then c.t else greatest(least(c.t, last - 15), 15) end""",
    "frames_vad_percentile": f"with {_FR} select show, t as frame_idx, energy > quantile_cont(energy, 0.3) over (partition by show) as vad from fr",
    "frames_smooth_labels": f"""with {_FR}, a as (select show, t, max(vad::int) over w as v from fr window w as (partition by show order by t rows between 1 preceding and 1 following)),
 d as (select show, t, min(v) over w as v from a window w as (partition by show order by t rows between 1 preceding and 1 following)),
 e as (select show, t, min(v) over w as v from d window w as (partition by show order by t rows between 1 preceding and 1 following))
 select show, t as frame_idx, max(v) over (partition by show order by t rows between 1 preceding and 1 following) = 1 as vad from e""",
    "frames_labels_to_intervals": f"with {_FR}, {_RUNS} select * from iv",
    "frames_intervals_to_frames": f"with {_FR} select show, t as frame_idx from fr where vad",
    "frames_pre_emphasis": f"with {_FR} select show, t as frame_idx, round(x - 0.97 * coalesce(lag(x) over (partition by show order by t), x), {R}) as x from fr",
    "frames_framing": f"with {_FR}, f as (select show, unnest(range(0, (last + 1 - 25) // 10 + 1)) as frame from b where last + 1 >= 25) select f.show, frame, (fr.t - 10 * frame) as i, round(fr.x, {R}) as x from f join fr on fr.show = f.show and fr.t >= 10 * frame and fr.t < 10 * frame + 25",
    "frames_segments": f"with {_FR}, f as (select show, last, unnest(range(-10, last + 11)) as frame from b) select 's' || f.show as seg_id, frame, x from f join fr on fr.show = f.show and fr.t = greatest(least(frame, last), 0)",
    "frames_tandem": f"with {_FR}, m as (select show, i, avg(x) as m from c group by 1, 2) select show, t as frame_idx, i, round(x, {R}) as x from c union all select show, t, i + 2, round(x - m, {R}) as x from c join m using (show, i)",
    "frames_moments": f"with {_FR} select show, count(*) as n, i, round(sum(x), {R}) as x from c group by show, i union all select show, count(*), i + 2, round(sum(x * x), {R}) as x from c group by show, i",
}
SQL |= {k: re.sub(r"\bshow\b", "show_id", q) for k, q in SQL.items() if k.startswith("frames_")}
SQL = {k: q.replace(f", {R}) as x", f" + {EPS}, {R}) as x") for k, q in SQL.items()}
