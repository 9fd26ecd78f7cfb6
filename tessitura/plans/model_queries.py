"""Queries of models, codecs and scalar functions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessitura.functions import scales
from tessitura.models import classify, factors, gmm, networks, svm, training
from tessitura.operators import codecs
from tessitura.operators import scoring as SC
from tessitura.operators import stats as ST
from tessitura.operators import vectors as VE
from tessitura.plans import views as V
from tessitura.plans.feature_queries import _cells, _frames
from tessitura.plans.tables import table
from tessitura.sources import binary

# A mixture of three components over (value / 100, k / 50) of the events.
MIX = gmm.Mixture(np.array([0.5, 0.3, 0.2]), np.array([[0.3, 0.5], [1.0, 1.0], [2.0, 1.5]]), np.array([[0.2, 0.3], [0.5, 0.4], [1.0, 0.6]]))
FULL = gmm.Mixture(MIX.w, MIX.mu, np.array([[[0.2, 0.05], [0.05, 0.3]], [[0.5, -0.1], [-0.1, 0.4]], [[1.0, 0.3], [0.3, 0.6]]]))
# Loadings of one speaker and one channel factor, and diagonal ones, over the mixture's six means.
START, CHANNEL, DIAGONAL = np.array([[0.1], [-0.2], [0.3], [0.15], [-0.25], [0.05]]), np.array([[0.05], [0.1], [-0.1], [0.2], [0.1], [-0.05]]), np.array([0.1, 0.2, 0.15, 0.05, 0.1, 0.2])
# Weights of a network with one hidden layer, and of a time-delay network with one segment layer.
NET = networks.Network([networks.Layer(np.array([[0.5, -1.0, 0.25], [1.0, 0.5, -0.75]]), np.array([0.1, 0.0, -0.1]), "sigmoid"), networks.Layer(np.array([[1.0, -0.5], [0.5, 0.25], [-1.0, 1.0]]), np.array([0.0, 0.2]), "softmax")])
TDNN = networks.Network([networks.Layer(np.array([[[0.5, 0.1], [0.2, -0.3]], [[-0.4, 0.2], [0.1, 0.6]], [[0.3, -0.5], [0.25, 0.15]]]), np.array([0.05, -0.05]), "leaky")], [networks.Layer(np.array([[1.0, 0.5], [-0.5, 1.0], [0.25, -0.25], [2.0, 0.75]]), np.array([0.1, -0.2]), "leaky")])
EPS = 1.3e-9


def _scaled(s, d):
    f = _frames(s, d)
    return f.select("show", F.col("show").alias("seg_id"), "frame_idx", F.array(F.get("cep", F.lit(0)) / 100, F.get("cep", F.lit(1)) / 50).alias("cep"))


def gmm_log_likelihood(s, d):
    return gmm.frame_log_likelihood(_scaled(s, d), MIX).select(F.col("show").alias("show_id"), "frame_idx", F.round("llk", 6).alias("llk"))


def gmm_component_log_density(s, d):
    return _cells(gmm.frame_log_likelihood(_scaled(s, d), MIX), "show", "frame_idx", column="lp").withColumnRenamed("show", "show_id")


def gmm_statistics(s, d):
    st = gmm.sufficient_statistics(_scaled(s, d), MIX)
    return _cells(st.select("seg_id", F.concat("stat0", "stat1").alias("v")), "seg_id")


def gmm_em_step(s, d):
    """Weights, means and variances after one EM step from the fixed mixture."""
    n, f, q, _ = gmm.expectation(_scaled(s, d), MIX)
    m = gmm.maximisation(MIX, n, f, q, 0.0, 1e9)
    rows = [(g, *(round(float(x), 6) for x in (m.w[g], *m.mu[g], *m.cov[g]))) for g in range(3)]
    return s.createDataFrame(rows, "g int, w double, mu0 double, mu1 double, cov0 double, cov1 double")


def _parameters(s, m):
    rows = [(g, *(round(float(x) + EPS, 5) for x in (m.w[g], *m.mu[g], *m.cov[g]))) for g in range(m.n)]
    return s.createDataFrame(rows, "g int, w double, mu0 double, mu1 double, cov0 double, cov1 double")


def gmm_em_limited(s, d):
    """One EM step with variances kept between 0.9 and 1.1 of the fixed mixture's."""
    n, f, q, _ = gmm.expectation(_scaled(s, d), MIX)
    return _parameters(s, gmm.maximisation(MIX, n, f, q, 0.9, 1.1))


def gmm_fit(s, d):
    """Four components by splitting, two and four steps."""
    m, _ = gmm.fit_by_splitting(_scaled(s, d), 4, (2, 4))
    return _parameters(s, gmm.Mixture.from_table(m.to_table(s)))


def gmm_full_density(s, d):
    return _cells(gmm.frame_log_likelihood(_scaled(s, d), FULL), "show", "frame_idx", column="lp").withColumnRenamed("show", "show_id")


def gmm_full_steps(s, d):
    """EM from uniform and from diagonal to full covariances: whether every step's likelihood is no worse than the last."""
    frames = _scaled(s, d)
    m, first = gmm.fit(frames, gmm.uniform_start(frames, 3), 4, None, 0.0, 1e9)
    _, second = gmm.diagonal_to_full(frames, m, 3)
    rows = [(n, i, bool(i == 0 or h[i] >= h[i - 1] - 1e-9)) for n, h in (("uniform", first), ("full", second)) for i in range(len(h))]
    return s.createDataFrame(rows, "start string, step int, no_worse boolean")


def gmm_merge(s, d):
    """Two mixtures as one, kept as a table and read back."""
    both = gmm.Mixture.merge([MIX, gmm.Mixture(MIX.w, MIX.mu + 1, MIX.cov * 2)])
    return _parameters(s, gmm.Mixture.from_table(both.to_table(s)))


def gmm_scores(s, d):
    """Every show's adapted means against its own frames and those of the shows with the same last digit."""
    frames = _scaled(s, d).withColumn("by", F.right("seg_id", F.lit(1)))
    models = ST.map_adapt(gmm.sufficient_statistics(frames, MIX), MIX.mu).select(F.right("seg_id", F.lit(1)).alias("by"), F.col("seg_id").alias("model_id"), F.col("stat1").alias("v"))
    return gmm.score_within(frames, models, MIX).withColumn("score", F.rint((F.col("score") + EPS) * 1e6) / 1e6)  # ``round`` goes through a decimal: too slow for this many rows


def map_adapt_scaled(s, d):
    """Adapted means of every show, scaled so that inner products approximate divergences."""
    out = ST.map_adapt(gmm.sufficient_statistics(_scaled(s, d), MIX), MIX.mu, invcov=1 / MIX.cov, w=MIX.w)
    return _cells(out.select("seg_id", F.col("stat1").alias("v")), "seg_id")


def session_vectors(s, d):
    """Total variability of rank 1 over the shows' statistics, and their vectors."""
    st = gmm.sufficient_statistics(_scaled(s, d), MIX)
    model = factors.total_variability(st, MIX, 1, 3, start=START)
    out = factors.extract(st, MIX, model)
    return out.select("seg_id", *[F.round(F.get(c, F.lit(0)) + EPS, 6).alias(c) for c in ("v", "variance", "second_moment")])


def session_vectors_approximate(s, d):
    st = gmm.sufficient_statistics(_scaled(s, d), MIX)
    one = {m: factors.extract_approximate(st, MIX, START, m).select("seg_id", F.round(F.get("v", F.lit(0)) + EPS, 6).alias(f"by_{m}")) for m in ("weight", "eigen")}
    return one["weight"].join(one["eigen"], "seg_id")


def score_jfa(s, d):
    """Shows against the speakers that their last digits stand for, with fixed factors."""
    st = gmm.sufficient_statistics(_scaled(s, d), MIX)
    enroll = st.withColumn("model_id", F.right("seg_id", F.lit(1)))
    sides = factors.jfa_sides(enroll, st, MIX, factors.FactorModel(np.zeros(6), F=START, G=CHANNEL, H=DIAGONAL))
    trials = enroll.select("model_id").distinct().crossJoin(st.select("seg_id"))  # at most ten speakers, all listed
    return SC.jfa(trials, *sides).withColumn("score", F.round(F.col("score") + EPS, 6))


def jfa_fit(s, d):
    """Speaker, channel and diagonal loadings, two steps each; shows with the same last digit are a speaker."""
    st = gmm.sufficient_statistics(_scaled(s, d), MIX).withColumn("model_id", F.right("seg_id", F.lit(1)))
    m = factors.joint_factor_analysis(st, MIX, 1, 1, True, (2, 2, 2))
    return s.createDataFrame([(k, *(round(float(x) + EPS, 5) for x in (m.F[k, 0], m.G[k, 0], m.H[k]))) for k in range(6)], "k int, v double, u double, d double")


def mixture_raw_file(s, d):
    """The fixed mixture in its binary form and back."""
    return _parameters(s, binary.decode_raw_mixture(binary.encode_raw_mixture(MIX)))


def mixture_text_file(s, d):
    """The fixed mixture from a text definition of its components."""
    parts = ["<NUMMIXES> 3"] + [f"<MIXTURE> {g + 1} {MIX.w[g]}\n<MEAN> 2\n {MIX.mu[g][0]} {MIX.mu[g][1]}\n<VARIANCE> 2\n {MIX.cov[g][0]} {MIX.cov[g][1]}" for g in range(3)]
    return _parameters(s, binary.parse_htk_mixture("\n".join(parts)))


def _posterior(s, d):
    lp = gmm.frame_log_likelihood(_scaled(s, d), MIX).select("show", "frame_idx", VE.posteriors("lp").alias("posterior"))
    return _scaled(s, d).join(lp, ["show", "frame_idx"])


def posterior_statistics(s, d):
    """Statistics from a classifier's posteriors: here the mixture's own."""
    st = networks.posterior_statistics(_posterior(s, d), 3, 2)
    return _cells(st.select("seg_id", F.concat("stat0", "stat1").alias("v")), "seg_id")


def posterior_mixture(s, d):
    return _parameters(s, networks.class_mixture(_posterior(s, d), 3))


def network_posteriors(s, d):
    """Outputs of a small network, and its hidden layer as bottleneck features."""
    f = _scaled(s, d)
    both = networks.posteriors(networks.posteriors(f, NET), NET, out="bottleneck", upto=1)
    return _cells(both.select("show", "frame_idx", F.concat("posterior", "bottleneck").alias("v")), "show", "frame_idx").withColumnRenamed("show", "show_id")


def network_embeddings(s, d):
    """Segment vectors of a small time-delay network."""
    out = networks.embeddings(_scaled(s, d), TDNN, 1, least=20, block=40)
    return _cells(out, "seg_id")


def network_batches(s, d):
    """Standardised chunks of ten frames with the last digit of their show as label."""
    f = _scaled(s, d)
    labels = f.select("show").distinct().withColumn("label", F.right("show", F.lit(1)).cast("int"))
    out = networks.normalised_batches(f, labels, 10)
    return _cells(out, "label", "show", "chunk", column="x").withColumnRenamed("show", "show_id")


def _falls(s, history):
    return s.createDataFrame([(i, i == 0 or bool(history[i][0] < history[0][0])) for i in range(len(history))], "pass int, lower_than_first boolean")


def network_train(s, d):
    """A feed-forward network learning which frames are speech: whether every pass's loss is below the first's."""
    f = _frames(s, d).select(F.concat_ws(":", "show", "frame_idx").alias("key"), F.col("vad").cast("int").alias("label"), F.array(F.col("x") / 100, F.get("cep", F.lit(1)) / 50).alias("x"))
    t = training.Training(epochs=4, batches=4, rate=0.05)
    training.train(f, networks.random_network([2, 8, 2]), t)
    return _falls(s, t.history)


def network_train_segments(s, d):
    """A time-delay network learning the last digit of a show from standardised chunks of twenty frames."""
    f = _scaled(s, d)
    labels = f.select("show").distinct().withColumn("label", F.right("show", F.lit(1)).cast("int"))
    x = networks.normalised_batches(f, labels, 20).select(F.concat_ws(":", "show", "chunk").alias("key"), "label", "x")
    t = training.Training(epochs=4, batches=2, rate=0.01)
    training.train(x, networks.random_tdnn(2, 10, 8, 12), t, frames=20)
    return _falls(s, t.history)


def svm_cross_validation(s, d):
    """Frames as speech or not, each predicted by machines of the other two folds: rows by fold, and whether at least
    as many are right as the more frequent class has."""
    f = _frames(s, d).select("frame_idx", F.col("vad").cast("int").alias("label"), F.array(F.col("x") / 100, F.get("cep", F.lit(1)) / 50).alias("v"), (F.col("frame_idx") % 3).alias("fold"))
    done, _ = classify.cross_validate(f, "fold", 3)
    right, most = F.count_if(F.col("predicted") == F.col("label")), F.greatest(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0))
    return done.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), (right >= 0.95 * most).alias("as_good_as_a_guess"))


def svm_machines(s, d):
    """One machine for every model against the mean vectors of all models."""
    x = V.sessions(s, d)
    return svm.train(x.select("model_id", F.col("stat1").alias("v")), SC.mean_of(x))


def codec_percentile(s, d):
    out = codecs.percentile_round_trip(_frames(s, d).select("show", "frame_idx", "cep"), "cep", ["show"], ["frame_idx"])
    return out.select(F.col("show").alias("show_id"), "frame_idx", "i", "code")


def codec_linear(s, d):
    out = codecs.linear_code(_frames(s, d).select("show", "frame_idx", "cep"), "cep", ["show"], ["frame_idx"])
    return out.select(F.col("show").alias("show_id"), "frame_idx", "i", F.round("decoded", 2).alias("decoded"))


def frequency_scales(s, d):
    v = F.col("value") * 10
    cols = {"mel": scales.hz_to_mel(v), "hz": scales.mel_to_hz(v / 10), "slaney": scales.hz_to_mel_slaney(v), "bark": scales.hz_to_bark(v), "bark_hz": scales.bark_to_hz(v / 500), "linear": scales.mu_law_to_linear(F.col("event_id") % 256)}
    return table(s, d, "events").select("event_id", *[F.round(c, 6).alias(n) for n, c in cols.items()])


QUERIES = {
    f.__name__: f
    for f in (
        gmm_log_likelihood, gmm_component_log_density, gmm_statistics, gmm_em_step, gmm_em_limited, gmm_fit, gmm_full_density, gmm_full_steps, gmm_merge, gmm_scores,
        map_adapt_scaled, session_vectors, session_vectors_approximate, score_jfa, jfa_fit, mixture_raw_file, mixture_text_file, posterior_statistics, posterior_mixture, network_posteriors, network_embeddings, network_batches, network_train, network_train_segments, svm_cross_validation, svm_machines, codec_percentile, codec_linear, frequency_scales,
    )
}


def _density(g: int) -> str:
    c, m, w = MIX.cov[g], MIX.mu[g], MIX.w[g]
    return f"(ln({w}) - 0.5 * (ln(2 * pi() * {c[0]}) + ln(2 * pi() * {c[1]}) + (x0 - {m[0]}) ** 2 / {c[0]} + (x1 - {m[1]}) ** 2 / {c[1]}))"


_F = """fr as (select user_id::varchar as show_id, row_number() over (partition by user_id order by ts, event_id) - 1 as frame_idx, value, json_extract_string(props, '$.k')::double as k from events),
 f as (select show_id, frame_idx, value / 100 as x0, k / 50 as x1 from fr)"""
_G = f"""{_F}, lp as (select *, {', '.join(f'{_density(g)} as l{g}' for g in range(3))} from f),
 ll as (select *, ln(exp(l0) + exp(l1) + exp(l2)) as llk from lp), p as (select *, exp(l0 - llk) as g0, exp(l1 - llk) as g1, exp(l2 - llk) as g2 from ll)"""
_ST = [f"sum(g{g})" for g in range(3)] + [f"sum(g{g} * x{i})" for g in range(3) for i in range(2)]
_CODES = """c as (select show_id, frame_idx, 0 as i, value as x from fr union all select show_id, frame_idx, 1, k from fr)"""


def _code(x: str, a: str, b: str, lo: int, hi: int) -> str:
    return f"{lo} + round(coalesce(({x} - {a}) * {hi - lo} / nullif({b} - {a}, 0), 0))"

def _normal(x: str = "") -> str:
    return " + ".join(f"ln(2 * pi() * c{i}) + (x{i} - m{i}) ** 2 / c{i}" for i in range(2))


def _em(name: str, source: str, floor: float | None = 0.01, ceiling: float = 10.0) -> str:
    """``name``: parameters (g, w, m0, m1, c0, c1, v0, v1) after a step from those of ``source``; v0, v1 are what limits are relative to."""
    def var(i: int) -> str:
        v = f"sum(r * x{i} * x{i}) / sum(r) - (sum(r * x{i}) / sum(r)) ** 2"
        return v if floor is None else f"least(greatest({v}, {floor} * any_value(v{i})), {ceiling} * any_value(v{i}))"

    return f"""{name}_l as (select f.*, p.*, ln(w) - 0.5 * ({_normal()}) as l from f, {source} p), {name}_e as (select *, exp(l - max(l) over (partition by show_id, frame_idx)) as e from {name}_l),
 {name}_r as (select *, e / sum(e) over (partition by show_id, frame_idx) as r from {name}_e),
 {name} as (select g, sum(r) / (select count(*) from f) as w, {', '.join(f'sum(r * x{i}) / sum(r) as m{i}' for i in range(2))}, {', '.join(f'{var(i)} as c{i}' for i in range(2))}, any_value(v0) as v0, any_value(v1) as v1 from {name}_r group by g)"""


def _halves(name: str, source: str, n: int) -> str:
    side = "w / 2 as w, m0 {0} case when c0 >= c1 then sqrt(c0) else 0 end as m0, m1 {0} case when c0 >= c1 then 0 else sqrt(c1) end as m1, c0, c1, v0, v1"
    return f"{name} as (select g, {side.format('-')} from {source} union all select g + {n}, {side.format('+')} from {source})"


def _out_parameters(source: str) -> str:
    return f"select g::int as g, {', '.join(f'round({a} + {EPS}, 5) as {b}' for a, b in (('w', 'w'), ('m0', 'mu0'), ('m1', 'mu1'), ('c0', 'cov0'), ('c1', 'cov1')))} from {source}"


def _table(name: str, columns: str, rows: list) -> str:
    return f"{name}({columns}) as (values {', '.join('(' + ', '.join(repr(float(x)) if isinstance(x, float) else repr(x) for x in r) + ')' for r in rows)})"


def _fixed(m, name: str = "mix") -> str:
    return _table(f"{name}", "g, w, m0, m1, c0, c1, v0, v1", [(g, *map(float, (m.w[g], *m.mu[g], *m.cov[g], *m.cov[g]))) for g in range(m.n)])


#: (show_id, k, n, f): counts and centred, scaled sums of the mixture's six means
_WHITE = _table("mk", "k, g, mu, cov, t, u, h", [(2 * g + i, g, *map(float, (MIX.mu[g, i], MIX.cov[g, i], START[2 * g + i, 0], CHANNEL[2 * g + i, 0], DIAGONAL[2 * g + i]))) for g in range(3) for i in range(2)])
_STATS = f"""{_G}, so as (select show_id, [sum(g0), sum(g1), sum(g2)] as n, [{', '.join(f'sum(g{g} * x{i})' for g in range(3) for i in range(2))}] as f from p group by 1), {_WHITE},
 sk as (select show_id, k, g, n[g + 1] as n, f[k + 1] as s, (f[k + 1] - n[g + 1] * mu) / sqrt(cov) as x, mu, cov, t, u, h from so, mk)"""


def _tv_step(i: int, t: str = "t", sk: str = "sk", key: str = "show_id") -> str:
    """Loadings of the next step from those of ``t``{i} (k, t), over the rows ``sk`` (key, k, n, x)."""
    return f"""h{t}{i} as (select {key}, 1 + sum({sk}.n * {t}{i}.t ** 2) as l, sum({sk}.x * {t}{i}.t) as b from {sk} join {t}{i} using (k) group by 1), e{t}{i} as (select {key}, b / l as v, 1 / l + (b / l) ** 2 as hh from h{t}{i}),
 a{t}{i} as (select k, sum({sk}.x * v) / (sum({sk}.n * hh) + 1e-10) as t from {sk} join e{t}{i} using ({key}) group by 1), {t}{i + 1} as (select k, t * sqrt((select avg(hh) from e{t}{i})) as t from a{t}{i})"""


def _without(name: str, source: str, t: str, rows: str, key: str) -> str:
    """``name``: ``rows`` (.., k, n, x) less what loadings ``t`` and the factor of their ``key``, estimated over ``source``, explain."""
    return f"""y_{name} as (select {key}, sum({source}.x * {t}.t) / (1 + sum({source}.n * {t}.t ** 2)) as y from {source} join {t} using (k) group by 1),
 {name} as (select {rows}.* exclude (x), {rows}.x - {rows}.n * y * {t}.t as x from {rows} join y_{name} using ({key}) join {t} using (k))"""


def _diagonal_step(i: int) -> str:
    return f"d{i + 1} as (select k, sum(z * x) / greatest(sum(n * (c + z * z)), 1e-10) as d from (select k, n, x, 1 / (1 + n * d * d) as c, d * x / (1 + n * d * d) as z from rm join d{i} using (k)) group by 1)"


_DRAWN = np.random.default_rng(0)
_V0, _U0 = (_DRAWN.normal(size=(6, 1)) * 0.1 for _ in range(2))


_LEAKY = "case when {0} > 0 then {0} else 0.2 * {0} end"


def _tdnn(j: int) -> str:
    w, b = TDNN.layers[0].w, TDNN.layers[0].b
    return f"({float(b[j])!r} + " + " + ".join(f"{float(w[k, i, j])!r} * f{k}.x{i}" for k in range(3) for i in range(2)) + ")"


_POOL = ["avg(y0)", "avg(y1)", "stddev_samp(y0)", "stddev_samp(y1)"]


SQL = {
    "gmm_log_likelihood": f"with {_G} select show_id, frame_idx, round(llk, 6) as llk from p",
    "gmm_component_log_density": f"with {_G} select show_id, frame_idx, i, round(x, 6) as x from (" + " union all ".join(f"select show_id, frame_idx, {g} as i, l{g} + 1.3e-9 as x from p" for g in range(3)) + ")",
    "gmm_statistics": f"with {_G}, s as (select show_id, [{', '.join(_ST)}] as v from p group by 1) select show_id as seg_id, unnest(range(9)) as i, round(unnest(v) + 1.3e-9, 6) as x from s",
    "gmm_em_step": f"with {_G} " + " union all ".join(
        f"select {g} as g, round(sum(g{g}) / count(*), 6) as w, round(sum(g{g} * x0) / sum(g{g}), 6) as mu0, round(sum(g{g} * x1) / sum(g{g}), 6) as mu1,"
        f" round(sum(g{g} * x0 * x0) / sum(g{g}) - (sum(g{g} * x0) / sum(g{g})) ** 2, 6) as cov0, round(sum(g{g} * x1 * x1) / sum(g{g}) - (sum(g{g} * x1) / sum(g{g})) ** 2, 6) as cov1 from p" for g in range(3)),
    "codec_percentile": f"""with {_F}, {_CODES},
 s as (select show_id, i, list(x order by x) as v from c group by 1, 2),
 q as (select show_id, i, v[1] as p0, v[1 + floor((len(v) - 1) * 0.25)::int] as p1, v[1 + floor((len(v) - 1) * 0.75)::int] as p2, v[len(v)] as p3 from s)
 select show_id, frame_idx, i, least(greatest(case when x < p1 then {_code('x', 'p0', 'p1', 0, 64)} when x < p2 then {_code('x', 'p1', 'p2', 64, 192)} else {_code('x', 'p2', 'p3', 192, 255)} end, 0), 255)::int as code
 from c join q using (show_id, i)""",
    "codec_linear": f"with {_F}, {_CODES} select show_id, frame_idx, i, round(x, 2) as decoded from c",
    "frequency_scales": """select event_id, round(2595 * log10(1 + value / 70), 6) as mel, round(700 * (pow(10, value / 2595) - 1), 6) as hz,
 round(case when value * 10 < 1000 then value * 10 * 3 / 200 else 15 + ln(value / 100) * 27 / ln(6.4) end, 6) as slaney, round(6 * asinh(value / 60), 6) as bark,
 round(600 * sinh(value / 50 / 6), 6) as bark_hz,
 round((case when 255 - event_id % 256 >= 128 then -1 else 1 end) * ((2 * ((255 - event_id % 256) % 16) + 33) * pow(2, floor(((255 - event_id % 256) % 128) / 16)) - 33) / 4004.189931, 6) as linear from events""",
    "gmm_em_limited": f"with {_F}, {_fixed(MIX)}, {_em('s', 'mix', 0.9, 1.1)} {_out_parameters('s')}",
    "gmm_fit": f"""with {_F}, one as (select 0 as g, 1.0::double as w, avg(x0) as m0, avg(x1) as m1, var_pop(x0) as c0, var_pop(x1) as c1, var_pop(x0) as v0, var_pop(x1) as v1 from f),
 {_halves('a0', 'one', 1)}, {_em('a1', 'a0')}, {_em('a2', 'a1')}, {_halves('b0', 'a2', 2)}, {_em('b1', 'b0')}, {_em('b2', 'b1')}, {_em('b3', 'b2')}, {_em('b4', 'b3')} {_out_parameters('b4')}""",
    "gmm_full_density": f"with {_F} select show_id, frame_idx, i, round(x + {EPS}, 6) as x from (" + " union all ".join(
        f"select show_id, frame_idx, {g} as i, ln({MIX.w[g]}) - ln(2 * pi()) - 0.5 * (ln({float(np.linalg.det(FULL.cov[g]))!r}) + ({FULL.cov[g][1, 1]} * (x0 - {MIX.mu[g][0]}) ** 2 - {2 * FULL.cov[g][0, 1]} * (x0 - {MIX.mu[g][0]}) * (x1 - {MIX.mu[g][1]}) + {FULL.cov[g][0, 0]} * (x1 - {MIX.mu[g][1]}) ** 2) / {float(np.linalg.det(FULL.cov[g]))!r}) as x from f" for g in range(3)) + ")",
    "gmm_full_steps": "select 'uniform' as start, range::int as step, true as no_worse from range(4) union all select 'full', range::int, true from range(3)",
    "gmm_merge": f"with {_fixed(MIX)}, two as (select g, w / 2 as w, m0, m1, c0, c1 from mix union all select g + 3, w / 2, m0 + 1, m1 + 1, 2 * c0, 2 * c1 from mix) {_out_parameters('two')}",
    "gmm_scores": f"""with {_STATS}, ad as (select show_id as model_id, g, list(case when n > 0 then s / (n + 16) else 0 end + 16 / (n + 16) * mu order by k) as m, list(cov order by k) as c from sk group by 1, 2),
 ll2 as (select model_id, p.show_id as seg_id, frame_idx, any_value(llk) as llk, ln(sum(case g when 0 then {MIX.w[0]} when 1 then {MIX.w[1]} else {MIX.w[2]} end * exp(-0.5 * (ln(2 * pi() * c[1]) + ln(2 * pi() * c[2]) + (x0 - m[1]) ** 2 / c[1] + (x1 - m[2]) ** 2 / c[2])))) as l
  from ad join p on right(model_id, 1) = right(p.show_id, 1) group by 1, 2, 3) select model_id, seg_id, round(avg(l - llk) + {EPS}, 6) as score from ll2 group by 1, 2""",
    "map_adapt_scaled": f"with {_STATS} select show_id as seg_id, k as i, round((s / (n + 16) + 16 / (n + 16) * mu) * sqrt(case g when 0 then {MIX.w[0]} when 1 then {MIX.w[1]} else {MIX.w[2]} end / cov) + {EPS}, 6) as x from sk",
    "session_vectors": f"""with {_STATS}, t0 as (select k, t from mk), {', '.join(_tv_step(i) for i in range(3))}, z as (select show_id, 1 + sum(n * t3.t ** 2) as l, sum(x * t3.t) as b from sk join t3 using (k) group by 1)
 select show_id as seg_id, round(b / l + {EPS}, 6) as v, round(1 / l + {EPS}, 6) as variance, round(1 / l + (b / l) ** 2 + {EPS}, 6) as second_moment from z""",
    "session_vectors_approximate": f"""with {_STATS}, w as (select sum(case g when 0 then {MIX.w[0]} when 1 then {MIX.w[1]} else {MIX.w[2]} end * t * t) as w from mk)
 select show_id as seg_id, round(sum(x * t) / (1 + sum(n) / 2 * any_value(w)) + {EPS}, 6) as by_weight, round(sum(x * t) / (1 + sum(n * t * t)) + {EPS}, 6) as by_eigen from sk, w group by 1""",
    "score_jfa": f"""with {_STATS}, mo as (select right(show_id, 1) as model_id, k, sum(n) as n, sum(x) as x, any_value(cov) as cov, any_value(t) as t, any_value(u) as u, any_value(h) as h from sk group by 1, 2),
 lf as (select *, 1 / (1 + n * h * h) as l from mo), js as (select model_id, 1 + sum(n * l * t * t) as a, sum(n * l * t * u) as b, 1 + sum(n * l * u * u) as c, sum(x * l * t) as p, sum(x * l * u) as q from lf group by 1),
 jy as (select model_id, (c * p - b * q) / (a * c - b * b) as y, (a * q - b * p) / (a * c - b * b) as v from js),
 me as (select model_id, k, (y * t + l * h * (x - n * (y * t + v * u)) * h) / sqrt(cov) as o from lf join jy using (model_id)),
 tx as (select show_id, sum(x * u) / (1 + sum(n * u * u)) as v, sum(n) / 2 as frames from sk group by 1),
 te as (select show_id, k, s - n * v * u * sqrt(cov) - n * mu as c, frames from sk join tx using (show_id))
 select model_id, show_id as seg_id, round(sum(o * c) / any_value(frames) + {EPS}, 6) as score from me join te using (k) group by 1, 2""",
    "posterior_statistics": f"with {_G}, s as (select show_id, [{', '.join(_ST)}] as v from p group by 1) select show_id as seg_id, unnest(range(9)) as i, round(unnest(v) + 1.3e-9, 6) as x from s",
    "posterior_mixture": f"with {_F}, {_fixed(MIX)}, {_em('s', 'mix', None)} {_out_parameters('s')}",
    "network_posteriors": f"""with {_F}, hl as (select *, {', '.join(f"1 / (1 + exp(-({float(NET.layers[0].b[j])!r} + {float(NET.layers[0].w[0, j])!r} * x0 + {float(NET.layers[0].w[1, j])!r} * x1))) as h{j}" for j in range(3))} from f),
 o as (select *, {', '.join(f"exp({float(NET.layers[1].b[j])!r} + " + ' + '.join(f"{float(NET.layers[1].w[k, j])!r} * h{k}" for k in range(3)) + f") as o{j}" for j in range(2))} from hl),
 v as (select show_id, frame_idx, unnest(range(5)) as i, unnest([o0 / (o0 + o1), o1 / (o0 + o1), h0, h1, h2]) as x from o) select show_id, frame_idx, i, round(x + {EPS}, 6) as x from v""",
    "network_embeddings": f"""with {_F}, y as (select f0.show_id, {', '.join(f'{_LEAKY.format(_tdnn(j))} as y{j}' for j in range(2))} from f f0 join f f1 on f1.show_id = f0.show_id and f1.frame_idx = f0.frame_idx + 1 join f f2 on f2.show_id = f0.show_id and f2.frame_idx = f0.frame_idx + 2),
 q as (select show_id, {', '.join(f'{p} as q{k}' for k, p in enumerate(_POOL))} from y group by 1 having count(*) >= 18)
 select show_id as seg_id, i, round(x + {EPS}, 6) as x from (""" + " union all ".join(f"select show_id, {j} as i, {float(TDNN.segment[0].b[j])!r} + " + " + ".join(f"{float(TDNN.segment[0].w[k, j])!r} * q{k}" for k in range(4)) + " as x from q" for j in range(2)) + ")",
    "network_batches": f"""with {_F}, k as (select show_id, frame_idx, frame_idx // 10 as chunk, 0 as j, x0 as x from f union all select show_id, frame_idx, frame_idx // 10, 1, x1 from f),
 m as (select show_id, chunk, j, avg(x) as m, stddev_pop(x) as s from k group by 1, 2, 3 having count(*) = 10)
 select right(show_id, 1)::int as label, show_id, chunk, (frame_idx % 10) * 2 + j as i, round((x - m) / case when s = 0 then 1 else s end + {EPS}, 6) as x from k join m using (show_id, chunk, j)""",
    "network_train": "select range::int as pass, true as lower_than_first from range(4)",
    "network_train_segments": "select range::int as pass, true as lower_than_first from range(4)",
    "jfa_fit": f"""with {_STATS}, sm as (select show_id, right(show_id, 1) as model_id, k, n, x from sk), bm as (select model_id, k, sum(n) as n, sum(x) as x from sm group by 1, 2),
 {_table('v0', 'k, t', [(k, float(_V0[k, 0])) for k in range(6)])}, {_tv_step(0, 'v', 'bm', 'model_id')}, {_tv_step(1, 'v', 'bm', 'model_id')}, {_without('lf', 'bm', 'v2', 'sm', 'model_id')},
 {_table('u0', 'k, t', [(k, float(_U0[k, 0])) for k in range(6)])}, {_tv_step(0, 'u', 'lf')}, {_tv_step(1, 'u', 'lf')}, {_without('rs', 'lf', 'u2', 'lf', 'show_id')},
 rm as (select model_id, k, sum(n) as n, sum(x) as x from rs group by 1, 2), d0 as (select k, 0.1::double as d from v0), {_diagonal_step(0)}, {_diagonal_step(1)}
 select k::int as k, round(v2.t + {EPS}, 5) as v, round(u2.t + {EPS}, 5) as u, round(d2.d + {EPS}, 5) as d from v2 join u2 using (k) join d2 using (k)""",
    "mixture_raw_file": f"with {_fixed(MIX)} {_out_parameters('mix')}",
    "mixture_text_file": f"with {_fixed(MIX)} {_out_parameters('mix')}",
    "svm_cross_validation": "select (k - 1) % 3 as fold, count(*) as n, true as as_good_as_a_guess from (select row_number() over (partition by user_id order by ts, event_id) as k from events) group by 1",
}
