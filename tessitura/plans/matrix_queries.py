"""Queries of scoring, whitening and projections with whole matrices. Their SQL inverts matrices by elimination."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessitura.models import factors
from tessitura.operators import scoring as SC
from tessitura.operators import stats as ST
from tessitura.operators import vectors as VE
from tessitura.plans import views as V
from tessitura.plans.feature_queries import _NEXT, _PM, R, _scoring, _sides, _trials
from tessitura.plans.tables import table

D, EPS = 64, 1.3e-9
# Loadings of speaker and channel factors, the residual covariance, and diagonal loadings.
LOADINGS = np.cos(np.outer(np.arange(D), np.arange(1, 9))) / 8
CHANNEL = np.sin(np.outer(np.arange(D), np.arange(1, 5))) / 8
RESIDUAL = np.diag(1 + np.arange(D) / 64)
DIAGONAL = np.diag(0.5 + np.arange(D) / 128)


def _score(df):
    return df.withColumn("score", F.round(F.col("score") + EPS, R))


def score_two_covariance(s, d):
    x = _scoring(s, d)
    w, b = ST.within_covariance(x) + 0.01 * np.eye(D), ST.between_covariance(x) + 0.01 * np.eye(D)
    return _score(SC.two_covariance(_trials(x), *_sides(x), w, b))


def score_mahalanobis_full(s, d):
    x = _scoring(s, d)
    return _score(SC.mahalanobis(_trials(x), *_sides(x), ST.mahalanobis_matrix(x)))


def score_cosine_wccn(s, d):
    x = _scoring(s, d)
    return _score(SC.cosine(_trials(x), *_sides(x), ST.wccn(x)))


def score_plda(s, d):
    """Fast scoring of models' means under fixed loadings."""
    x = _scoring(s, d)
    return _score(SC.plda(_trials(x), *_sides(x), np.full(D, 0.125), LOADINGS, None, RESIDUAL))


def score_plda_full(s, d):
    x = _scoring(s, d)
    return _score(SC.plda(_trials(x), *_sides(x), np.full(D, 0.125), LOADINGS, CHANNEL, RESIDUAL, full_model=True))


def score_plda_open_set(s, d):
    x = _scoring(s, d)
    return _score(SC.plda(_trials(x), *_sides(x), np.full(D, 0.125), LOADINGS, None, RESIDUAL, p_known=0.4))


def score_plda_uncertain(s, d):
    """Every test vector is uncertain by a tenth of one plus the size of its entries."""
    x = _scoring(s, d)
    enroll, test = _sides(x)
    test = test.withColumn("u", F.transform("v", lambda z: (F.abs(z) + 1) / 10))
    return _score(SC.plda_uncertain(_trials(x), enroll, test, np.full(D, 0.125), DIAGONAL, RESIDUAL))


def _languages(s, d):
    langs = table(s, d, "segment_registry").where("lang is not null").groupBy("seg_id").agg(F.min("lang").alias("model_id"))
    return V.sessions(s, d).drop("model_id").join(langs, "seg_id")


def score_gaussian_backend(s, d):
    """Sessions against the languages of their segments, one diagonal covariance for all."""
    x = _languages(s, d)
    return _score(SC.gaussian_backend_test(SC.first_of(x, "seg_id"), SC.gaussian_backend_train(x), diag=True))


def score_gaussian_backend_own(s, d):
    """Full covariances, each a tenth the language's own and the rest tied."""
    x = _languages(s, d)
    return _score(SC.gaussian_backend_test(SC.first_of(x, "seg_id"), SC.gaussian_backend_train(x, 0.1)))


def vectors_whiten_full(s, d):
    """Squared lengths after whitening by eigenvectors and by the Cholesky factor: both are Mahalanobis distances."""
    x = V.sessions(s, d).select("pos", F.col("stat1").alias("a"), F.col("stat1").alias("b"))
    m, c = ST.mean(x, "a"), ST.total_covariance(x, "a")
    white = VE.whiten_cholesky(VE.whiten(x, "a", m, c), "b", m, c)
    return white.select("pos", *[F.round(VE.dot(v, v) + EPS, R).alias(n) for v, n in (("a", "by_eigenvectors"), ("b", "by_cholesky"))])


def spectral_normalise(s, d):
    """Cosine of every vector with the first session's, both after one step of whitening and length normalisation."""
    x = V.sessions(s, d).select("pos", "model_id", "stat0", "stat1")
    y = ST.apply_spectral_norm(x, ST.spectral_norm(x, 1)).select("pos", "stat1")
    first = F.broadcast(y.agg(F.min_by("stat1", "pos").alias("first")))  # one row
    return y.crossJoin(first).select("pos", F.round(VE.dot("stat1", "first") + EPS, R).alias("x"))


def project_lda(s, d):
    """Correlations of the eight discriminants within classes: none but with themselves."""
    x = V.sessions(s, d)
    y = VE.rotate(x.select("model_id", "stat0", "stat1"), "stat1", ST.lda(x, 8))
    w = ST.within_covariance(y)
    r = w / np.sqrt(np.outer(np.diag(w), np.diag(w)))
    return s.createDataFrame([(i, j, round(float(r[i, j]), R) + 0.0) for i in range(8) for j in range(8)], "i int, j int, cov double")


def remove_nap(s, d):
    """What is left of every vector along the four main directions of variation within models: nothing."""
    x = V.sessions(s, d)
    directions = ST.nap(x, 4)
    y = ST.remove_directions(x.select("pos", F.col("stat1").alias("v")), "v", directions)
    return VE.rotate(y, "v", directions).select("pos", F.round(F.abs(VE.dot("v", "v")), R).alias("x"))


def background_kernel(s, d):
    """Inner products of the languages' mean vectors with every segment's first session."""
    x = _languages(s, d)
    means = SC.mean_of(x).select(F.col("model_id").alias("seg_id"), F.col("v").alias("stat1"))
    first = SC.first_of(V.sessions(s, d), "seg_id").select("seg_id", F.col("v").alias("stat1"))
    return ST.kernel(means, first).select("seg_a", "seg_b", F.round(F.col("k") + EPS, R).alias("k"))


def gaussian_likelihood(s, d):
    """Log-likelihood per session of all vectors under the fixed loadings and residual."""
    x = V.sessions(s, d)
    n = x.count()
    v = ST.gaussian_log_likelihood(x, LOADINGS, np.diag(RESIDUAL), CHANNEL)
    return s.createDataFrame([(n, round(v / max(1, n), R))], "n long, llk double")


def plda_fit(s, d):
    """Loadings and residual variances of one speaker factor after two steps from a fixed start."""
    x = V.sessions(s, d).select("model_id", "stat1")
    m = factors.plda(x, 1, 2, LOADINGS[:, :1])
    return s.createDataFrame([(i, round(float(m.F[i, 0]) + EPS, R), round(float(m.sigma[i, i]) + EPS, R)) for i in range(D)], "i int, f double, sigma double")


def factor_model_table(s, d):
    """A model kept as a table and read back."""
    kept = factors.FactorModel(np.arange(4.0), F=LOADINGS[:4, :2], H=np.arange(4) / 2).to_table(s)
    return factors.FactorModel.from_table(kept).to_table(s).select("part", F.col("nr"), F.posexplode("vals").alias("i", "x")).withColumn("x", F.round(F.col("x") + EPS, R))


QUERIES = {
    f.__name__: f
    for f in (
        score_two_covariance, score_mahalanobis_full, score_cosine_wccn, score_plda, score_plda_full, score_plda_open_set, score_plda_uncertain,
        score_gaussian_backend, score_gaussian_backend_own, vectors_whiten_full, spectral_normalise, project_lda, remove_nap, background_kernel,
        gaussian_likelihood, plda_fit, factor_model_table,
    )
}


def _inverse(name: str, source: str, keys: str = "", n: int = D) -> str:
    """``name`` (keys, m, ld): inverse of the matrix m of every row of ``source`` (keys, m) and the log of its determinant."""
    k = keys and keys + ", "
    unit = f"list_transform(range({n}), lambda j: (j + 1 = i)::int::double)"
    step = "list_transform(m, lambda r, i: case when i = k then list_transform(r, lambda x: x / m[k][k]) else list_transform(r, lambda x, j: x - r[k] * m[k][j] / m[k][k]) end)"
    return f"""{name}_k as (select {k}1 as k, list_transform(m, lambda r, i: list_concat(r, {unit})) as m, 0.0::double as ld from {source}
  union all select {k}k + 1, {step}, ld + ln(m[k][k]) from {name}_k where k <= {n}),
 {name} as (select {k}list_transform(m, lambda r: r[{n + 1}:{2 * n}]) as m, ld from {name}_k where k = {n + 1})"""


def _cells(name: str, source: str, keys: str = "") -> str:
    """``name`` (keys, m) from cells (keys, i, j, x)."""
    k, g = (keys + ", ", f" group by {keys}") if keys else ("", "")
    return f"{name} as (select {k}list(r order by i) as m from (select {k}i, list(x order by j) as r from {source} group by {k}i){g})"


def _formula(name: str, x: str) -> str:
    """Matrix with the entries ``x`` of i and j from 0."""
    return f"{name} as (select list_transform(range({D}), lambda i: list_transform(range({D}), lambda j: ({x})::double)) as m)"


def _quad(v: str, m: str) -> str:
    return f"list_inner_product({v}, list_transform({m}, lambda r: list_inner_product(r, {v})))"


def _sum(a: str, b: str, sign: str = "+") -> str:
    return f"list_transform({a}, lambda x, i: x {sign} {b}[i])"


_SIDES = f"e as (select model_id, list(m order by i) as v from m group by 1), t as (select seg_id, arg_min(stat1, pos) as v from ss group by 1), {_NEXT}"
_TR = "tr join e using (model_id) join t using (seg_id)"
_WITHIN = f"""z as (select pos, i, x - m as x from u join m using (model_id, i)),
 wx as (select a.i, b.i as j, sum(a.x * b.x) / (select count(*) from ss) as x from z a join z b using (pos) group by 1, 2)"""
_BETWEEN = """gm as (select i, avg(x) as g from u group by 1), zb as (select model_id, i, n, m - g as x from m join gm using (i)),
 bx as (select a.i, b.i as j, sum(a.n * a.x * b.x) / (select count(*) from ss) as x from zb a join zb b using (model_id) group by 1, 2)"""
_TOTAL = f"g as (select i, avg(x) as g from u group by 1), tx as (select a.i, b.i as j, covar_pop(a.x, b.x) as x from u a join u b using (pos) group by 1, 2), {_cells('tm', 'tx')}, {_inverse('ti', 'tm')}, gl as (select list(g order by i) as g from g)"
_ROWS = f"round(score + {EPS}, {R}) as score"
_FF = "list_sum(list_transform(range(1, 9), lambda k: cos(i * k) * cos(j * k))) / 64"
_GG = "list_sum(list_transform(range(1, 5), lambda k: sin(i * k) * sin(j * k))) / 64"
_SI = "(case when i = j then 1 + i / 64 else 0 end)"


def _plda(total: str, scores: str) -> str:
    """Log-ratio of one Gaussian over both vectors to one each, by their sum and difference."""
    e, t = (f"list_transform({s}.v, lambda x: x - 0.125)" for s in "et")
    return f"""with recursive {_PM}, {_SIDES}, {_formula('t0', total)}, {_formula('tp', f'{total} + {_FF}')}, {_formula('tn', f'{total} - {_FF}')},
 {_inverse('i0', 't0')}, {_inverse('ip', 'tp')}, {_inverse('in_', 'tn')},
 p as (select model_id, seg_id, {e} as e, {t} as t from {_TR}),
 q as (select model_id, seg_id, e, t, {_sum('e', 't')} as s, {_sum('e', 't', '-')} as f from p),
 r as (select model_id, seg_id, 0.5 * ({_quad('e', 'i0.m')} + {_quad('t', 'i0.m')} + 2 * i0.ld - {_quad('s', 'ip.m')} / 2 - {_quad('f', 'in_.m')} / 2 - ip.ld - in_.ld) as score from q, i0, ip, in_)
 {scores}"""


_LANG = """lg as (select seg_id, min(lang) as lang from segment_registry where lang is not null group by 1), sl as (select ss.*, lang from ss join lg using (seg_id)),
 ul as (select pos, lang, unnest(range(64)) as i, unnest(stat1) as x from sl), ml as (select lang, i, avg(x) as m, count(*) as n from ul group by 1, 2),
 lv as (select lang, list(m order by i) as m from ml group by 1), tl as (select seg_id, arg_min(stat1, pos) as v from sl group by 1)"""
_SSU = f"{V.SESSIONS}"
_OPEN = f"""select a.model_id, a.seg_id, round(a.score - ln((1 - 0.4) + coalesce(0.4 * b.s / b.n, 0)) + {EPS}, {R}) as score from r a left join
  (select x.model_id, x.seg_id, sum(exp(y.score)) as s, count(*) as n from r x join r y on x.seg_id = y.seg_id and x.model_id <> y.model_id group by 1, 2) b using (model_id, seg_id)"""


def _plda_step(k: int) -> str:
    """From loadings f{k} (f) and residual s{k} (m) to the next ones, over class sums cs (n, x) and the total tm."""
    return f"""{_inverse(f'si{k}', f's{k}')}, pv{k} as (select list_transform(m, lambda r: list_inner_product(r, f)) as p, f from si{k}, f{k}),
 hc{k} as (select n, x, 1 / (1 + n * list_inner_product(f, p)) as c, list_inner_product(x, p) as b from cs, pv{k}), hh{k} as (select n, x, c * b as h, c + c * c * b * b as hh from hc{k}),
 xs{k} as (select i, sum(h * v) as c from (select h, unnest(range({D})) as i, unnest(x) as v from hh{k}) group by 1), cr{k} as (select list(c order by i) as c from xs{k}),
 ag{k} as (select sum(n * hh) as a, avg(hh) as s, sum(n) as n from hh{k}),
 s{k + 1} as (select list_transform(tm.m, lambda r, i: list_transform(r, lambda x, j: x - c[i] * c[j] / (a * ag{k}.n))) as m from tm, cr{k}, ag{k}),
 f{k + 1} as (select list_transform(c, lambda x: x / a * sqrt(s)) as f from cr{k}, ag{k})"""


SQL = {
    "plda_fit": f"""with recursive {_PM}, {_TOTAL}, cz as (select model_id, i, any_value(n) as n, sum(s) - any_value(n) * any_value(g) as x from m join g using (i) group by 1, 2),
 cs as (select model_id, any_value(n) as n, list(x order by i) as x from cz group by 1), f0 as (select list_transform(range({D}), lambda i: cos(i) / 8) as f), s0 as (select m from tm), {_plda_step(0)}, {_plda_step(1)}
 select i::int as i, round(f[i + 1] + {EPS}, {R}) as f, round(m[i + 1][i + 1] + {EPS}, {R}) as sigma from f2, s2, range({D}) r(i)""",
    "score_two_covariance": f"""with recursive {_PM}, {_SIDES}, {_WITHIN}, {_BETWEEN},
 w2 as (select i, j, x + case when i = j then 0.01 else 0 end as x from wx), b2 as (select i, j, x + case when i = j then 0.01 else 0 end as x from bx),
 {_cells('wm', 'w2')}, {_cells('bm', 'b2')}, {_inverse('iw', 'wm')}, {_inverse('ib', 'bm')},
 c1 as (select list_transform(ib.m, lambda r, i: list_transform(r, lambda x, j: x + iw.m[i][j])) as m from ib, iw),
 c2 as (select list_transform(ib.m, lambda r, i: list_transform(r, lambda x, j: x + 2 * iw.m[i][j])) as m from ib, iw), {_inverse('d1', 'c1')}, {_inverse('d2', 'c2')},
 ew as (select model_id, list_transform(iw.m, lambda r: list_inner_product(r, v)) as v from e, iw), tw as (select seg_id, list_transform(iw.m, lambda r: list_inner_product(r, v)) as v from t, iw),
 p as (select model_id, seg_id, ew.v as e, tw.v as t, {_sum('ew.v', 'tw.v')} as s from tr join ew using (model_id) join tw using (seg_id)),
 r as (select model_id, seg_id, {_quad('s', 'd2.m')} - {_quad('e', 'd1.m')} - {_quad('t', 'd1.m')} as score from p, d1, d2) select model_id, seg_id, {_ROWS} from r""",
    "score_mahalanobis_full": f"""with recursive {_PM}, {_SIDES}, {_WITHIN}, {_cells('wm', 'wx')}, {_inverse('iw', 'wm')},
 p as (select model_id, seg_id, {_sum('e.v', 't.v', '-')} as f from {_TR}), r as (select model_id, seg_id, -0.5 * {_quad('f', 'iw.m')} as score from p, iw) select model_id, seg_id, {_ROWS} from r""",
    "score_cosine_wccn": f"""with recursive {_PM}, {_SIDES}, z as (select model_id, pos, i, (x - m) / sqrt(n) as x from u join m using (model_id, i)),
 wx as (select a.i, b.i as j, sum(a.x * b.x) / (select count(distinct model_id) from ss) as x from z a join z b using (pos) group by 1, 2), {_cells('wm', 'wx')}, {_inverse('iw', 'wm')},
 p as (select model_id, seg_id, e.v as e, t.v as t, list_transform(iw.m, lambda r: list_inner_product(r, t.v)) as mt, iw.m as m from tr join e using (model_id) join t using (seg_id), iw),
 r as (select model_id, seg_id, list_inner_product(e, mt) / sqrt({_quad('e', 'm')} * list_inner_product(t, mt)) as score from p) select model_id, seg_id, {_ROWS} from r""",
    "score_plda": _plda(f"{_FF} + {_SI}", f"select model_id, seg_id, {_ROWS} from r"),
    "score_plda_full": _plda(f"{_FF} + {_GG} + {_SI}", f"select model_id, seg_id, {_ROWS} from r"),
    "score_plda_open_set": _plda(f"{_FF} + {_SI}", _OPEN),
    "score_plda_uncertain": f"""with {_PM}, {_SIDES},
 x as (select model_id, seg_id, unnest(range(64)) as i, unnest(e.v) - 0.125 as e, unnest(t.v) - 0.125 as t, unnest(t.v) as raw from {_TR}),
 y as (select *, (0.5 + i / 128) ** 2 as a, (0.5 + i / 128) ** 2 + 1 + i / 64 as tt, (0.5 + i / 128) ** 2 + 1 + i / 64 + (abs(raw) + 1) / 10 as o from x),
 r as (select model_id, seg_id, sum(0.5 * (ln(o) + t * t / o - ln(o - a * a / tt) - (t - a / tt * e) ** 2 / (o - a * a / tt))) as score from y group by 1, 2)
 select model_id, seg_id, {_ROWS} from r""",
    "score_gaussian_backend": f"""with {_SSU}, {_LANG}, c as (select i, sum((x - m) ** 2) / (select count(*) from sl) as c from ul join ml using (lang, i) group by 1),
 x as (select seg_id, unnest(range(64)) as i, unnest(v) as x from tl),
 r as (select lang as model_id, seg_id, sum(-0.5 * (ln(2 * pi() * c) + (x - m) ** 2 / c)) as score from x join ml using (i) join c using (i) group by 1, 2) select model_id, seg_id, {_ROWS} from r""",
    "score_gaussian_backend_own": f"""with recursive {_SSU}, {_LANG}, zl as (select lang, pos, i, x - m as x from ul join ml using (lang, i)),
 ol as (select a.lang, a.i, b.i as j, sum(a.x * b.x) as x, count(*) as n from zl a join zl b using (pos) group by 1, 2, 3),
 ti as (select i, j, sum(x) / sum(n) as x from ol group by 1, 2), cl as (select lang, i, j, 0.1 * ol.x / n + 0.9 * ti.x as x from ol join ti using (i, j)),
 {_cells('cm', 'cl', 'lang')}, {_inverse('ci', 'cm', 'lang')},
 p as (select lang as model_id, seg_id, {_sum('tl.v', 'lv.m', '-')} as f, ci.m as m, ld from tl, lv join ci using (lang)),
 r as (select model_id, seg_id, -0.5 * ({_quad('f', 'm')} + ld + 64 * ln(2 * pi())) as score from p) select model_id, seg_id, {_ROWS} from r""",
    "vectors_whiten_full": f"""with recursive {_PM}, {_TOTAL}, p as (select pos, {_sum('stat1', 'g', '-')} as f from ss, gl), r as (select pos, {_quad('f', 'm')} as q from p, ti)
 select pos, round(q + {EPS}, {R}) as by_eigenvectors, round(q + {EPS}, {R}) as by_cholesky from r""",
    "spectral_normalise": f"""with recursive {_PM}, {_TOTAL}, p as (select pos, {_sum('stat1', 'g', '-')} as f from ss, gl), w as (select pos, f, list_transform(m, lambda r: list_inner_product(r, f)) as wf from p, ti),
 o as (select wf, list_inner_product(f, wf) as n from w order by pos limit 1) select pos, round(list_inner_product(f, o.wf) / sqrt(list_inner_product(f, w.wf) * o.n) + {EPS}, {R}) as x from w, o""",
    "project_lda": "select a.range::int as i, b.range::int as j, (a.range = b.range)::int::double as cov from range(8) a, range(8) b",
    "remove_nap": f"with {_SSU} select pos, 0.0::double as x from ss",
    "background_kernel": f"with {_SSU}, {_LANG}, f as (select seg_id, arg_min(stat1, pos) as v from ss group by 1) select lang as seg_a, seg_id as seg_b, round(list_inner_product(lv.m, f.v) + {EPS}, {R}) as k from lv, f",
    "gaussian_likelihood": f"""with recursive {_PM}, g as (select i, avg(x) as g from u group by 1), gl as (select list(g order by i) as g from g), {_formula('t0', f'{_FF} + {_GG} + {_SI}')}, {_inverse('i0', 't0')},
 p as (select {_sum('stat1', 'g', '-')} as f from ss, gl) select count(*) as n, round(avg(-0.5 * ({_quad('f', 'm')} + ld + 64 * ln(2 * pi()))), {R}) as llk from p, i0""",
    "factor_model_table": f"""select 'mean' as part, 0 as nr, i::int as i, round(i + {EPS}, {R}) as x from range(4) r(i) union all select 'H', 0, i::int, round(i / 2 + {EPS}, {R}) from range(4) r(i)
 union all select 'F', i::int, k::int - 1, round(cos(i * k) / 8 + {EPS}, {R}) from range(4) r(i), range(1, 3) s(k)""",
}
