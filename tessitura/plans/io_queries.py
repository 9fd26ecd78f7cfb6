"""Round trips through text and binary files, with SQL over the tables they were made of."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import functions as F

from tessitura.operators import trials as T
from tessitura.plans import views as V
from tessitura.plans.feature_queries import _FR, _RUNS, EPS, R, _cells, _frames, frames_labels_to_intervals
from tessitura.plans.signal_queries import RATE, _audio
from tessitura.plans.tables import table
from tessitura.plans.trial_queries import _key
from tessitura.plans.trial_queries import _I as IDMAP
from tessitura.plans.trial_queries import _K as KEY
from tessitura.plans.trial_queries import _SC as SCORES
from tessitura.signal import extract as X
from tessitura.sources import binary as B
from tessitura.sources import lists as L
from tessitura.workspace import Workspace


def _folder(s, name):
    return Workspace(s, "files").path + "/" + name


def text_idmap(s, d):
    """Model, segment and bounds where both are there and not negative."""
    both = F.coalesce((F.col("start") >= 0) & (F.col("stop") >= 0), F.lit(False))
    rows = V.idmap(s, d).select("model_id", "seg_id", *[F.when(both, F.col(c)).alias(c) for c in ("start", "stop")])
    at = _folder(s, "idmap")
    L.write_idmap_text(rows, at)
    return L.read_idmap_text(s, at).drop("pos")


def text_index(s, d):
    at = _folder(s, "index")
    L.write_index_text(T.trial_index(V.score_rows(s, d)), at)
    return L.read_index_text(s, at)


def text_key(s, d):
    at = _folder(s, "key")
    L.write_key_text(_key(s, d), at)
    return L.read_key_text(s, at)


def text_scores(s, d):
    at = _folder(s, "scores")
    L.write_scores_text(V.score_rows(s, d), at)
    return L.read_scores_text(s, at)


def text_labels(s, d):
    """Speech of every show as a label file of four decimals."""
    at = _folder(s, "labels")
    L.write_labels(frames_labels_to_intervals(s, d), at)
    return L.read_labels(s, at)


def text_alignment(s, d):
    """States of a forced alignment: one where frames are speech."""
    lines = _frames(s, d).groupBy("show").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame_idx", F.col("vad").cast("int").alias("v")))), lambda x: x["v"]).alias("v"))
    at = _folder(s, "alignment")
    lines.select(F.concat_ws(" ", "show", F.concat_ws(" ", F.transform("v", lambda x: x.cast("string"))))).write.text(at)
    return L.read_alignment(s, at)


def text_sparse(s, d):
    """Vectors of two features with their label, as sparse lines."""
    at = _folder(s, "sparse")
    f = _frames(s, d)
    f.select(F.concat_ws(" ", F.when(F.col("vad"), "1").otherwise("-1"), *[F.concat(F.lit(f"{i + 1}:"), F.get("cep", F.lit(i)).cast("string")) for i in range(2)])).write.text(at)
    out = L.read_sparse(s, at)
    return out.select("label", *[F.element_at("features", F.lit(i + 1)).alias(f"x{i}") for i in range(2)])


def tables_appended(s, d):
    """Sessions of null and other bounds written to two tables and merged, one coefficient read back."""
    x = V.sessions(s, d).select("pos", "model_id", "seg_id", "stat1")
    a, b = _folder(s, "first"), _folder(s, "second")
    cut = V.sessions(s, d).where("start is null").select("pos")
    L.write_table(x.join(cut, "pos", "left_semi"), a, "append")
    L.write_table(x.join(cut, "pos", "left_anti"), b, "append")
    return L.merge_tables(s, [a, b], "pos").select("pos", F.round(F.get("stat1", F.lit(3)), R).alias("x"))


def _packed(s, d):
    """(show, x): all frames of a show, flattened."""
    packed = F.transform(F.array_sort(F.collect_list(F.struct("frame_idx", "cep"))), lambda v: v["cep"])
    return _frames(s, d).groupBy("show").agg(F.flatten(packed).alias("x"))


def _written(s, df, name, encode, suffix):
    at = _folder(s, name)
    B.write_files(df, at, encode, suffix).write.format("noop").mode("overwrite").save()
    return at


def frames_htk(s, d):
    at = _written(s, _packed(s, d), "htk", lambda r: B.encode_htk(np.array(r["x"]).reshape(-1, 2)), ".htk")
    return _cells(B.read_frames(s, at, B.htk_frames), "show", "frame_idx", column="cep")


def frames_spro(s, d):
    at = _written(s, _packed(s, d), "spro", lambda r: B.encode_spro(np.array(r["x"]).reshape(-1, 2)), ".prm")
    return _cells(B.read_frames(s, at, B.decode_spro), "show", "frame_idx", column="cep")


def frames_spro_segments(s, d):
    """Frames -3 to 12 of every file, and all from the fortieth on."""
    at = _written(s, _packed(s, d), "spro", lambda r: B.encode_spro(np.array(r["x"]).reshape(-1, 2)), ".prm")
    shows = _frames(s, d).select("show").distinct()
    segments = shows.select(F.concat("show", F.lit("_a")).alias("seg_id"), "show", F.lit(-3).alias("start"), F.lit(12).alias("stop"))
    segments = segments.unionByName(shows.select(F.concat("show", F.lit("_b")).alias("seg_id"), "show", F.lit(40).alias("start"), F.lit(None).cast("int").alias("stop")))
    return _cells(B.read_frame_segments(s, at, B.decode_spro, segments), "seg_id", "frame", column="cep")


def frames_wav(s, d):
    """Values as samples of audio files."""
    at = _written(s, _packed(s, d), "wav", lambda r: B.encode_wav(np.array(r["x"])[::2], RATE), ".wav")
    audio = B.read_audio(s, at)
    return audio.select("show", "sample_rate", F.posexplode("samples").alias("frame_idx", "x")).withColumn("x", F.round(F.col("x").cast("double") + EPS, R))


def frames_matrix(s, d):
    """Matrices of doubles."""
    at = _written(s, _packed(s, d), "matrix", lambda r: B.encode_matrix(np.array(r["x"]).reshape(-1, 2)), ".mat")
    return _cells(B.read_frames(s, at, B.decode_matrix), "show", "frame_idx", column="cep")


def _sphere(r):
    x = np.rint(np.array(r["x"])[::2]).astype("<i2")
    head = f"NIST_1A\n   1024\nchannel_count -i 1\nsample_count -i {len(x)}\nsample_rate -i {RATE}\nsample_n_bytes -i 2\nsample_byte_format -s2 01\nsample_coding -s3 pcm\nend_head\n"
    return head.encode().ljust(1024) + x.tobytes()


def frames_sphere(s, d):
    """Whole values as samples of audio files with a header of text."""
    audio = B.read_audio(s, _written(s, _packed(s, d), "sphere", _sphere, ".sph"))
    return audio.select("show", "sample_rate", F.posexplode("samples").alias("frame_idx", "x")).withColumn("x", F.round(F.col("x").cast("double") + EPS, R))


def frames_decimated(s, d):
    """Audio files read at half their rate."""
    audio = B.read_audio(s, _written(s, _packed(s, d), "wav", lambda r: B.encode_wav(np.array(r["x"])[::2], RATE), ".wav"), RATE // 2)
    return audio.select("show", F.posexplode("samples").alias("frame_idx", "x")).withColumn("x", F.round(F.col("x").cast("double") + EPS, 5))


def frames_reverberated(s, d):
    """Signals with an echo of half their size two samples later, at an active level of -26 dB."""
    audio = _audio(s, d).withColumn("samples", F.transform("samples", lambda x: x / 1000))
    plan = audio.select("show", F.concat(F.lit("r"), "show").alias("new_show"), F.lit(None).cast("string").alias("noise"), F.lit(None).cast("double").alias("snr"), F.lit("echo").alias("reverb"))
    out = X.augment(audio, plan, {}, {"echo": np.array([1.0, 0.0, 0.5])})
    return out.select("show", F.posexplode("samples").alias("frame_idx", "x")).withColumn("x", F.round(F.col("x").cast("double") + EPS, 5))


def frames_noisy(s, d):
    """A constant as noise: what is left after standardisation is the standardised signal."""
    audio = _audio(s, d)
    plan = audio.select("show", F.concat(F.lit("n"), "show").alias("new_show"), F.lit("one").alias("noise"), F.lit(10.0).alias("snr"), F.lit(None).cast("string").alias("reverb"))
    out = X.augment(audio, plan, {"one": np.ones(7)}, {})
    return out.select("show", F.posexplode("samples").alias("frame_idx", "x")).withColumn("x", F.round(F.col("x").cast("double") + EPS, 4))


def files_existing(s, d):
    """Segments of sessions whose formatted path is among those of the registry."""
    listing = table(s, d, "segment_registry").where("seg_id is not null").select(F.concat(F.lit("/data/"), "seg_id", F.lit(".wav")).alias("path"))
    return T.existing_files(V.sessions(s, d).select("pos", "seg_id"), listing, "/data/{}.wav", "seg_id")


QUERIES = {
    f.__name__: f
    for f in (
        text_idmap, text_index, text_key, text_scores, text_labels, text_alignment, text_sparse, tables_appended,
        frames_htk, frames_spro, frames_spro_segments, frames_wav, frames_matrix, frames_sphere, frames_decimated, frames_reverberated, frames_noisy, files_existing,
    )
}
QUERIES |= {k: (lambda s, d, f=f: f(s, d).withColumnRenamed("show", "show_id")) for k, f in QUERIES.items() if k.startswith(("frames_", "text_labels", "text_alignment"))}

_ONE_POLE = "pow({g}, t) * sum({x} * {k} / pow({g}, t)) over (partition by show order by t)"
_G = "exp(-1 / 30)"
# levels of the time that the envelope is above thresholds from 2^-15 to 2^-1, and between which of them the margin is met
_LEVEL = f"""sg as (select a.show, a.t, a.x / 1000 + 0.5 * coalesce(b.x, 0) / 1000 as y from fr a left join fr b on b.show = a.show and b.t = a.t - 2),
 e1 as (select *, {_ONE_POLE.format(g=_G, x='abs(y)', k=f'(1 - {_G})')} as p from sg), e2 as (select *, {_ONE_POLE.format(g=_G, x='p', k=f'(1 - {_G})')} as q from e1),
 sq as (select show, sum(y * y) as s, count(*) as n from sg group by 1),
 ab as (select e2.show, j, least(coalesce(lead(t) over (partition by e2.show, j order by t), n) - t, 201) as w from e2 join sq on sq.show = e2.show, range(15) r(j) where q >= pow(2.0, j - 15)),
 lv as (select ab.show, j, 10 * log10(any_value(s) / sum(w)) as a, 20 * log10(pow(2.0, j - 15)) as c from ab join sq on sq.show = ab.show group by 1, 2),
 pr as (select *, a - c - 15.9 as d0, lead(a - c - 15.9) over w as d1, lead(a) over w as a1 from lv window w as (partition by show order by j)),
 cr as (select show, arg_min(a + case when d0 <> d1 then d0 / (d0 - d1) else 0 end * (a1 - a), j) as l from pr where d0 >= 0 and 0 >= d1 group by 1),
 fi as (select show, arg_min(a, j) as l from lv group by 1),
 al as (select sq.show, coalesce(cr.l, fi.l, -100) as l from sq left join cr on cr.show = sq.show left join fi on fi.show = sq.show)"""
_SINGLE = f"select show, t as frame_idx, i, round(x::float::double + {EPS}, {R}) as x from c"
SQL = {
    "text_idmap": f'with {IDMAP} select model_id, seg_id, case when "start" >= 0 and stop >= 0 then "start" end as start, case when "start" >= 0 and stop >= 0 then stop end as stop from idm',
    "text_index": f"with {SCORES} select distinct model_id, seg_id from sc",
    "text_key": f"with {KEY} select * from ky",
    "text_scores": f"with {SCORES} select model_id, seg_id, score from sc",
    "text_labels": f"with {_FR}, {_RUNS} select show, t_start, t_stop, label from iv",
    "text_alignment": f"with {_FR} select show, t as frame_idx, vad::int as state from fr",
    "text_sparse": f"with {_FR} select case when vad then 1.0 else -1.0 end::double as label, x as x0, k as x1 from fr",
    "tables_appended": f"with {V.SESSIONS} select pos, round(stat1[4], {R}) as x from ss",
    "frames_htk": f"with {_FR} {_SINGLE}",
    "frames_spro": f"with {_FR} {_SINGLE}",
    "frames_spro_segments": f"""with {_FR}, s as (select show, show || '_a' as seg_id, unnest(range(-3, 12)) as frame, last from b union all select show, show || '_b', unnest(range(40, last + 1)), last from b)
 select seg_id, frame, i, round(x::float::double + {EPS}, {R}) as x from s join c on c.show = s.show and c.t = least(greatest(frame, 0), last)""",
    "frames_wav": f"""with {_FR}, m as (select show, greatest(1.0, max(abs(x))) as m from fr group by 1)
 select fr.show, {RATE} as sample_rate, t as frame_idx, round(round_even(x / m * 32767, 0)::float / 32768 + {EPS}, {R}) as x from fr join m on m.show = fr.show""",
    "frames_sphere": f"with {_FR} select show, {RATE} as sample_rate, t as frame_idx, round((round_even(x, 0)::float / 32768)::double + {EPS}, {R}) as x from fr",
    "frames_decimated": f"""with {_FR}, m as (select show, greatest(1.0, max(abs(x))) as m from fr group by 1), w as (select fr.show, t, (round_even(x / m * 32767, 0)::float / 32768)::double as x from fr join m on m.show = fr.show),
 h as (select k, case when k = 0 then 1.0 else sin(pi() * k / 2) / (pi() * k / 2) end * (0.54 - 0.46 * cos(2 * pi() * (k + 20) / 40)) as h from range(-20, 21) r(k)),
 o as (select a.show, a.t, sum(b.x * h) / (select sum(h) from h) as x from w a join h on true join w b on b.show = a.show and b.t = a.t - k where a.t % 2 = 0 group by 1, 2)
 select show, t // 2 as frame_idx, round(x::float::double + {EPS}, 5) as x from o""",
    "frames_reverberated": f"with {_FR}, {_LEVEL} select 'r' || sg.show as show, t as frame_idx, round((y * pow(10, (-26 - l) / 20))::float::double + {EPS}, 5) as x from sg join al on al.show = sg.show",
    "frames_noisy": f"with {_FR}, m as (select show, avg(x) as m, stddev_pop(x) as s from fr group by 1) select 'n' || fr.show as show, t as frame_idx, round(((x - m) / greatest(s, 1e-12))::float::double + {EPS}, 4) as x from fr join m on m.show = fr.show",
    "files_existing": f"with {V.SESSIONS} select pos, seg_id from ss where seg_id in (select seg_id from segment_registry)",
    "frames_matrix": f"with {_FR} select show, t as frame_idx, i, round(x + {EPS}, {R}) as x from c",
}
SQL = {k: re.sub(r"\bshow\b", "show_id", q) if k.startswith(("frames_", "text_labels", "text_alignment", "text_sparse")) else q for k, q in SQL.items()}
