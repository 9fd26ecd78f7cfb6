"""Queries of frame sequences, speech detection and spectra, with SQL from the formulas."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessitura.operators import codecs
from tessitura.operators import frames as FR
from tessitura.operators.vectors import lists
from tessitura.plans.feature_queries import _DELTA, _FR, _RUNS, EPS, R, _at, _cells, _frames, _lagged, _out, frames_labels_to_intervals
from tessitura.plans.sql import sql_probit
from tessitura.signal import extract as X
from tessitura.signal import kernels as K

WIN = 31
# Sampling rate, samples of a window and of a shift, and bands of the small spectra of these queries.
RATE, SIZE, SHIFT, BANDS, CEPSTRA = 1000, 32, 16, 6, 4


def frames_rasta(s, d):
    return _out(FR.rasta(_frames(s, d)))


def frames_gaussianise(s, d):
    return _out(FR.gaussianise(_frames(s, d), win=WIN))


def frames_vad_energy(s, d):
    return FR.vad_energy(_frames(s, d)).select("show", "frame_idx", "vad")


def frames_detect_energy(s, d):
    """Detection by the name of its rule."""
    return FR.detect_speech(_frames(s, d), "energy").select("show", "frame_idx", "vad")


def frames_detect_labels(s, d):
    segments = frames_labels_to_intervals(s, d)
    return FR.detect_speech(_frames(s, d), "lbl", segments).select("show", "frame_idx", "vad")


def frames_fuse_channels(s, d):
    """Channel 0 speaks where there is no error, channel 1 where values are above 50."""
    f = _frames(s, d)
    two = f.select("show", F.lit(0).alias("channel"), "frame_idx", "vad").unionByName(f.select("show", F.lit(1).alias("channel"), "frame_idx", (F.col("x") > 50).alias("vad")))
    return FR.fuse_channels(two)


def frames_traps(s, d):
    return _out(FR.traps(_frames(s, d), 5, 5, 4), "traps")


def frames_dct_context(s, d):
    return _out(FR.dct_context(_frames(s, d), 3, 3))


def frames_delta_delta(s, d):
    return _out(FR.delta_and_delta2(_frames(s, d)))


def frames_post_processing(s, d):
    """Mask, derivative, smoothed labels, normalisation by speech, speech frames only."""
    f = _frames(s, d).select("show", "frame_idx", "cep", "vad")
    return _out(X.post_process(f, X.PostProcessing(mask="[0-1]", delta=True, norm="cmvn", keep_all=False)))


def frames_decode_percentile(s, d):
    out = codecs.percentile_round_trip(_frames(s, d).select("show", "frame_idx", "cep"), "cep", ["show"], ["frame_idx"])
    return out.select("show", "frame_idx", "i", F.round(F.col("decoded") + EPS, R).alias("decoded"))


def _audio(s, d):
    """Every show's values as a signal."""
    samples = F.transform(F.array_sort(F.collect_list(F.struct("frame_idx", "x"))), lambda v: v["x"])
    return _frames(s, d).groupBy("show").agg(samples.alias("samples")).select("show", F.lit(0).alias("channel"), F.lit(RATE).alias("sample_rate"), "samples")


def _spectra(s, d, **kw):
    e = X.Extraction(low=0.0, high=RATE / 2, n_log=BANDS, window=SIZE / RATE, shift=SHIFT / RATE, dither=0.0, **kw)
    out = X.extract(_audio(s, d), e)
    return out.select("show", "frame_idx", F.concat(F.array("energy"), "cep", "fb").alias("v"))


def frames_mfcc(s, d):
    """Log-energy, cepstra and log filter outputs."""
    return _cells(_spectra(s, d, n_cep=CEPSTRA), "show", "frame_idx")


def frames_plp(s, d):
    """Log-energy, cepstra of the all-pole model of order two, and compressed bands."""
    return _cells(_spectra(s, d, kind="plp", n_cep=3), "show", "frame_idx")


def frames_segment_axis(s, d):
    """Frames of 25 samples every 10, the last one filled with the end of the signal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for show, x in zip(b["show"].to_pylist(), b["samples"].to_pylist()):
                f = K.frame_signal(np.array(x), 25, 10, "edge")
                yield pa.RecordBatch.from_arrays([pa.array([show] * len(f), pa.string()), pa.array(np.arange(len(f)), pa.int64()), lists(f)], ["show", "frame", "v"])

    return _cells(_audio(s, d).select("show", "samples").mapInArrow(run, "show string, frame long, v array<double>"), "show", "frame")


def frames_power(s, d):
    """Power spectra of emphasised, windowed frames."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for show, x in zip(b["show"].to_pylist(), b["samples"].to_pylist()):
                p, _ = K.power_spectrum(np.array(x), RATE, SIZE / RATE, SHIFT / RATE)
                yield pa.RecordBatch.from_arrays([pa.array([show] * len(p), pa.string()), pa.array(np.arange(len(p)), pa.int64()), lists(p)], ["show", "frame_idx", "v"])

    long_enough = _audio(s, d).where(F.size("samples") >= SIZE)
    return _cells(long_enough.select("show", "samples").mapInArrow(run, "show string, frame_idx long, v array<double>"), "show", "frame_idx")


def _matrix(s, m):
    return s.createDataFrame([(i, j, round(float(m[i, j]) + EPS, R)) for i in range(len(m)) for j in range(m.shape[1])], "i int, j int, x double")


def dct_basis(s, d):
    return _matrix(s, FR.dct_matrix(24, 13))


def triangle_filters(s, d):
    return _matrix(s, K.filter_bank(8000, 256, 100.0, 4000.0, 0, 24)[0])


QUERIES = {
    f.__name__: f
    for f in (
        frames_rasta, frames_gaussianise, frames_vad_energy, frames_detect_energy, frames_detect_labels, frames_fuse_channels, frames_traps, frames_dct_context,
        frames_delta_delta, frames_post_processing, frames_decode_percentile, frames_mfcc, frames_plp, frames_segment_axis, frames_power, dct_basis, triangle_filters,
    )
}
QUERIES |= {k: (lambda s, d, f=f: f(s, d).withColumnRenamed("show", "show_id")) for k, f in QUERIES.items() if k.startswith("frames_")}


# -- SQL ------------------------------------------------------------------------------------------


_RASTA = [(0, 0.2), (-1, 0.1), (-3, -0.1), (-4, -0.2)]
_FIR = " + ".join(f"{w} * coalesce(c{n}.x, 0)" for n, (_, w) in enumerate(_RASTA))


def _energy(ceiling: float, alpha: float, floor: float = 1e-4, bins: int = 4096, iterations: int = 8) -> str:
    """Expectation and maximisation over a histogram of standardised energy, step by step."""
    steps = [f"""mo as (select show, avg(energy) as m, stddev_pop(energy) as s from fr group by 1),
 zz as (select fr.show, fr.t, (energy - m) / case when s = 0 then 1 else s end as z, s from fr join mo on fr.show = mo.show),
 hi as (select show, floor((greatest(least(z, 8.0), -8.0) + 8) * {bins} / 16.0) as c, count(*) as n, avg(z) as z from zz group by 1, 2),
 p0 as (select distinct show, {', '.join(f'{2.0 * k - 2} as mu{k}, 1.0::double as v{k}, 1 / 3 as w{k}' for k in range(3))} from fr)"""]  # fmt: skip
    for i in range(iterations):
        dens = ", ".join(f"ln(w{k}) - 0.5 * (ln(2 * pi() * v{k}) + (z - mu{k}) ** 2 / v{k}) as l{k}" for k in range(3))
        steps.append(f"d{i} as (select hi.show, n, z, {dens} from hi join p{i} using (show))")
        steps.append(f"g{i} as (select show, n, z, " + ", ".join(f"exp(l{k} - greatest(l0, l1, l2)) as e{k}" for k in range(3)) + f" from d{i})")
        steps.append(f"r{i} as (select show, z, " + ", ".join(f"n * e{k} / (e0 + e1 + e2) as r{k}" for k in range(3)) + f" from g{i})")
        sums = ", ".join(f"greatest(sum(r{k}), 1e-10) as s{k}, sum(r{k} * z) as a{k}, sum(r{k} * z * z) as b{k}, sum(r{k}) as q{k}" for k in range(3))
        new = ", ".join(f"s{k} / (s0 + s1 + s2) as w{k}, a{k} / s{k} as mu{k}, least(greatest((b{k} - 2 * a{k} / s{k} * a{k} + q{k} * (a{k} / s{k}) ** 2) / s{k}, {floor}), {ceiling}) as v{k}" for k in range(3))
        steps.append(f"p{i + 1} as (select show, {new} from (select show, {sums} from r{i} group by show))")
    top = "case when mu0 >= mu1 and mu0 >= mu2 then {0}0{1} when mu1 >= mu2 then {0}1{1} else {0}2{1} end"
    cut = f"{top.format('mu', '')} - {alpha} * sqrt({top.format('v', '')})"
    return f"with {_FR}, {', '.join(steps)} select zz.show, zz.t as frame_idx, z > {cut} and s > 0 as vad from zz join p{iterations} on zz.show = p{iterations}.show"


def _context(left: int, right: int, weight: str, n: int, first: int) -> str:
    """Every coefficient's context times a table of weights (k, o, w)."""
    at = " union all ".join(f"select show, t, i, {o + left} as o, y from {_at(o)}" for o in range(-left, right + 1))
    return f"with {_FR}, w as (select k, o, {weight} as w from range({n}) a(k), range({left + right + 1}) b(o)), y as ({at}) select show, t as frame_idx, {first}, round(sum(y * w), {R}) as x from y join w using (o) group by show, t, y.i, k"


def _dct(n: int) -> str:
    return f"sqrt(2 / {n}) * cos(pi() * k * (o + 0.5) / {n}) * case when k = 0 then sqrt(0.5) else 1 end"


def _delta(table: str) -> str:
    """(show, t, i, x): derivative of (show, t, i, x)."""
    return f"select c.show, c.t, c.i, {' + '.join(f'{w} * coalesce(c{n}.x, 0)' for n, (_, w) in enumerate(_DELTA))} as x from {table} c " + " ".join(f"left join {table} c{n} on c{n}.show = c.show and c{n}.i = c.i and c{n}.t = c.t + ({o})" for n, (o, _) in enumerate(_DELTA))


_SMOOTH = """sa as (select show, t, max(vad::int) over w as v from fr window w as (partition by show order by t rows between 1 preceding and 1 following)),
 sd as (select show, t, min(v) over w as v from sa window w as (partition by show order by t rows between 1 preceding and 1 following)),
 se as (select show, t, min(v) over w as v from sd window w as (partition by show order by t rows between 1 preceding and 1 following)),
 sm as (select show, t, max(v) over (partition by show order by t rows between 1 preceding and 1 following) = 1 as vad from se)"""
_POWER = f"""q as (select show, unnest(range(0, (last + 1 - {SIZE}) // {SHIFT} + 1)) as f from b where last + 1 >= {SIZE}),
 em as (select q.show, f, fr.t - {SHIFT} * f as n, x - 0.97 * coalesce(lag(x) over (partition by q.show, f order by fr.t), x) as e from q join fr on fr.show = q.show and fr.t >= {SHIFT} * f and fr.t < {SHIFT} * f + {SIZE}),
 en as (select show, f, ln(greatest(sum(e * e), 2.2250738585072014e-308)) as energy from em group by 1, 2),
 po as (select show, f, k, sum(h * cos(2 * pi() * k * n / {SIZE})) ** 2 + sum(h * sin(2 * pi() * k * n / {SIZE})) ** 2 as p
  from (select show, f, n, e * (0.5 - 0.5 * cos(2 * pi() * n / {SIZE - 1})) as h from em), range({SIZE // 2 + 1}) r(k) group by 1, 2, 3)"""


def _triangles(low: float, high: float, n: int, rate: int, bins: int) -> str:
    """(j, k, w): triangles of unit area between edges equally spaced in mel, over the frequencies of bins."""
    mel = lambda f: f"2595 * log10(1 + {f} / 700)"
    return f"""ed as (select list(700 * (pow(10, ({mel(low)} + j * ({mel(high)} - {mel(low)}) / {n + 1}) / 2595) - 1) order by j) as e from range({n + 2}) r(j)),
 tr as (select j, k, greatest(least((k * {rate} / {bins} - e[j + 1]) / (e[j + 2] - e[j + 1]), (e[j + 3] - k * {rate} / {bins}) / (e[j + 3] - e[j + 2])), 0) * 2 / (e[j + 3] - e[j + 1]) as w from ed, range({n}) a(j), range({bins // 2 + 1}) c(k))"""


_BARK = f"(6 * asinh({RATE} / 2 / 600))"
_PLP = f"""bw as (select j, k, pow(10, least(0, least(z - m + 0.5, -2.5 * (z - m - 0.5)))) as w from (select j, k, 6 * asinh(k * {RATE} / {SIZE} / 600) as z, j * {_BARK} / 5 as m from range(6) a(j), range({SIZE // 2 + 1}) c(k))),
 ba as (select show, f, j, sum(p * w) as b, pow(600 * sinh(j * {_BARK} / 5 / 6), 2) as sq from po join bw using (k) group by 1, 2, 3),
 lo as (select show, f, j, pow(b * pow(sq / (sq + 1.6e5), 2) * (sq + 1.44e6) / (sq + 9.61e6), 0.33) as z from ba),
 ll as (select show, f, list(z order by j) as y from lo group by 1, 2), lz as (select show, f, [y[2], y[2], y[3], y[4], y[5], y[5]] as z from ll),
 ac as (select *, {', '.join(f'(z[1] + {(-1) ** m} * z[6] + 2 * ({" + ".join(f"z[{j + 1}] * cos(2 * pi() * {j * m} / 10)" for j in range(1, 5))})) / 10 as r{m}' for m in range(3))} from lz),
 k1 as (select *, -r1 / r0 as a from ac), k2 as (select *, r0 * (1 - a * a) as e1 from k1), k3 as (select *, -(r2 + a * r1) / e1 as g from k2),
 k4 as (select *, ln(e1 * (1 - g * g)) as c0, -(a + g * a) as c1 from k3), k5 as (select *, -g + (a + g * a) * (a + g * a) / 2 as c2 from k4)"""
SQL = {
    "frames_rasta": f"with {_FR}, fi as (select c.show, c.t, c.i, case when c.t < 4 then 0 else {_FIR} end as f from c {_lagged(_RASTA, False)}) select show, t as frame_idx, i, round(pow(0.94, t) * sum(f / pow(0.94, t)) over (partition by show, i order by t), {R}) as x from fi",
    "frames_gaussianise": f"""with {_FR}, w as (select c.*, case when last + 1 < {WIN} then 0 else greatest(least(c.t - {WIN // 2}, last - {WIN - 1}), 0) end as lo, least({WIN}, last + 1) as n from c join b using (show)),
 r as (select w.show, w.t, w.i, any_value(n) as n, count(*) filter (o.x < w.x) as below from w join c o on o.show = w.show and o.i = w.i and o.t >= lo and o.t < lo + n group by 1, 2, 3),
 p as (select *, (below + 0.5) / n as p from r) select show, t as frame_idx, i, round({sql_probit('p')}, {R}) as x from p""",
    "frames_vad_energy": _energy(1.0, 2.0),
    "frames_detect_energy": _energy(1.5, 0.2),
    "frames_detect_labels": f"with {_FR} select show, t as frame_idx, vad from fr",
    "frames_fuse_channels": f"with {_FR}, o as (select show, t, vad, x > 50 as two from fr) select show, 0 as channel, t as frame_idx, vad and not two as vad from o union all select show, 1, t, two and not vad from o",
    "frames_traps": _context(5, 5, f"{_dct(11)} * (0.54 - 0.46 * cos(2 * pi() * o / 10))", 4, "y.i * 4 + k as i"),
    "frames_dct_context": _context(3, 3, _dct(7), 7, "y.i * 7 + k as i"),
    "frames_delta_delta": f"with {_FR}, o as (select show, t, i, x from c), d1 as ({_delta('o')}), d2 as ({_delta('d1')}) select show, t as frame_idx, i, round(x, {R}) as x from (select * from o union all select show, t, i + 2, x from d1 union all select show, t, i + 4, x from d2)",
    "frames_post_processing": f"""with {_FR}, {_SMOOTH}, o as (select show, t, i, x from c), d1 as ({_delta('o')}), v as (select y.show, y.t, i, x from (select * from o union all select show, t, i + 2, x from d1) y join sm on sm.show = y.show and sm.t = y.t where vad),
 m as (select show, i, avg(x) as m, stddev_pop(x) as s from v group by 1, 2) select show, t as frame_idx, i, round((x - m) / case when s = 0 then 1 else s end, {R}) as x from v join m using (show, i)""",
    "frames_decode_percentile": f"""with {_FR}, s as (select show, i, list(x order by x) as v from c group by 1, 2),
 q as (select show, i, v[1] as p0, v[1 + floor((len(v) - 1) * 0.25)::int] as p1, v[1 + floor((len(v) - 1) * 0.75)::int] as p2, v[len(v)] as p3 from s),
 k as (select show, t, i, p0, p1, p2, p3, case when x < p1 then round(coalesce((x - p0) * 64 / nullif(p1 - p0, 0), 0)) when x < p2 then 64 + round(coalesce((x - p1) * 128 / nullif(p2 - p1, 0), 0)) else 192 + round(coalesce((x - p2) * 63 / nullif(p3 - p2, 0), 0)) end as c from c join q using (show, i))
 select show, t as frame_idx, i, round(case when c <= 64 then p0 + c * (p1 - p0) / 64 when c <= 192 then p1 + (c - 64) * (p2 - p1) / 128 else p2 + (c - 192) * (p3 - p2) / 63 end + {EPS}, {R}) as decoded from k""",
    "frames_mfcc": f"""with {_FR}, {_POWER}, {_triangles(0.0, RATE / 2, BANDS, RATE, SIZE)}, fb as (select show, f, j, ln(greatest(sum(p * w), 2.2250738585072014e-308)) as x from po join tr using (k) group by 1, 2, 3)
 select show, f as frame_idx, i, round(x, {R}) as x from (select show, f, 0 as i, energy as x from en
  union all select show, f, k as i, sum(x * sqrt(2 / {BANDS}) * cos(pi() * k * (j + 0.5) / {BANDS})) as x from fb, range(1, {CEPSTRA + 1}) r(k) group by 1, 2, 3 union all select show, f, {CEPSTRA + 1} + j, x from fb)""",
    "frames_plp": f"""with {_FR}, {_POWER}, {_PLP} select show, f as frame_idx, i, round(x, {R}) as x from (select show, f, 0 as i, energy as x from en
  union all select show, f, 1, c0 from k5 union all select show, f, 2, c1 from k5 union all select show, f, 3, c2 * pow(2, 0.6) from k5 union all select show, f, 4 + j, z[j + 1] from k5, range(6) r(j))""",
    "frames_segment_axis": f"""with {_FR}, q as (select show, last, unnest(range(0, greatest(0, ceil((last + 1 - 25) / 10))::int + 1)) as frame from b), n as (select *, unnest(range(25)) as i from q)
 select n.show, frame, i, round(fr.x, {R}) as x from n join fr on fr.show = n.show and fr.t = least(10 * frame + i, last)""",
    "frames_power": f"with {_FR}, {_POWER} select show, f as frame_idx, k as i, round(p, {R}) as x from po",
    "dct_basis": f"select k::int as i, o::int as j, round({_dct(24)} + {EPS}, {R}) as x from range(13) a(k), range(24) b(o)",
    "triangle_filters": f"with {_triangles(100.0, 4000.0, 24, 8000, 256)} select j::int as i, k::int as j, round(w + {EPS}, {R}) as x from tr",
}
SQL = {k: re.sub(r"\bshow\b", "show_id", q) if k.startswith("frames_") else q for k, q in SQL.items()}
SQL = {k: q.replace(f", {R}) as x", f" + {EPS}, {R}) as x") if k.startswith("frames_") else q for k, q in SQL.items()}
