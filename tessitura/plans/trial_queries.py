"""Queries of the trial algebra and of the detection metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessitura import schemas
from tessitura.operators import metrics as M
from tessitura.operators import trials as T
from tessitura.plans import views as V
from tessitura.plans.sql import sql_probit
from tessitura.plans.tables import table

TRIAL = T.TRIAL


def _key(s, d):
    return T.key_from_list(V.key_list(s, d))


def _models(s, d):
    return table(s, d, "model_registry").where("deleted_at is null").select("model_id").distinct()


def _segments(s, d):
    return table(s, d, "segment_registry").where("lang = 'en'").select("seg_id").distinct()


def _labelled(s, d):
    return T.labelled_scores(V.score_rows(s, d), _key(s, d))


def _lists(s, d, name):
    """(those of the list, all others)"""
    rows, mine = V.idmap(s, d), F.coalesce(F.col("list_name") == name, F.lit(False))
    return rows.where(mine).select("pos", *TRIAL), rows.where(~mine).select("pos", *TRIAL)



def idmap_map_left_to_right(s, d):
    ids = V.sessions(s, d).groupBy("model_id").agg(F.min("pos").alias("pos"))
    return T.map_left_to_right(ids, V.idmap(s, d))


def idmap_map_right_to_left(s, d):
    ids = V.sessions(s, d).select("pos", "seg_id")
    return T.map_right_to_left(ids, V.idmap(s, d))


def idmap_filter_left(s, d):
    return T.filter_on(V.idmap(s, d), _models(s, d), "model_id", True).select("pos", *TRIAL)


def idmap_filter_right(s, d):
    return T.filter_on(V.idmap(s, d), _segments(s, d), "seg_id", False).select("pos", *TRIAL)


def idmap_merge(s, d):
    return T.merge_idmaps(*_lists(s, d, "enrol"))


def idmap_split(s, d):
    return T.split_idmap(V.idmap(s, d).select("pos", *TRIAL), 7).select("pos", "part")


def list_round_robin(s, d):
    return T.split_round_robin(V.idmap(s, d), 5).select("pos", "part")


def ndx_distinct(s, d):
    return T.trial_index(V.score_rows(s, d))


def ndx_filter_keep(s, d):
    return T.filter_trials(T.trial_index(V.score_rows(s, d)), _models(s, d), _segments(s, d), True)


def ndx_filter_discard(s, d):
    return T.filter_trials(T.trial_index(V.score_rows(s, d)), _models(s, d), _segments(s, d), False)


def ndx_merge(s, d):
    return T.merge_indexes(V.score_rows(s, d), V.key_list(s, d))


def key_last_label(s, d):
    return _key(s, d)


def key_to_ndx(s, d):
    return T.key_to_index(_key(s, d))


def key_filter_keep(s, d):
    return T.filter_trials(_key(s, d), _models(s, d), _segments(s, d), True)


def _both_ways(s, d):
    rows = V.key_list(s, d).where("label <> 'none'")
    return rows.select(*TRIAL, (F.col("label") == "target").alias("is_target"))


def key_conflicts(s, d):
    return T.key_conflicts(_both_ways(s, d))


def key_merge(s, d):
    return T.merge_keys(_key(s, d), _both_ways(s, d), check=False)


def scores_align(s, d):
    return T.align_scores(V.score_rows(s, d), _key(s, d)).select("score_id", "score")


def scores_missing(s, d):
    return T.missing_scores(V.score_rows(s, d), _key(s, d))


def scores_fill(s, d):
    best = V.score_rows(s, d).groupBy(*TRIAL).agg(F.max("score").alias("score"))
    return T.fill_missing(best, _key(s, d), -100.0)


def scores_tar_non(s, d):
    return _labelled(s, d).select("score_id", "score", "is_target")


def scores_repeated_by_source(s, d):
    """Trials delivered again by the same source, over all sources; null is one."""
    return T.repeated_scores(V.score_rows(s, d).select("source", *TRIAL, "score"), by=["source"])


def scores_merge(s, d):
    rows = V.score_rows(s, d).select("source", *TRIAL, "score")
    mine = F.coalesce(F.col("source") == "plda_tel", F.lit(False))
    return T.merge_scores(rows.where(mine), rows.where(~mine), check=False)


def scores_filter_discard(s, d):
    return T.filter_trials(V.score_rows(s, d).select("score_id", *TRIAL), _models(s, d), _segments(s, d), False).select("score_id")


def scores_sort(s, d):
    return T.sort_scores(V.score_rows(s, d).select(*TRIAL, "score", "score_id")).select("score_id", *TRIAL, "score")


def scores_get(s, d):
    return T.get_score(V.score_rows(s, d), "spk_zz00a1", "tel_zz0000f1_a").select("score_id", "score")


def ids_difference(s, d):
    return T.difference(V.score_rows(s, d), table(s, d, "model_registry"), "model_id")


def ids_member(s, d):
    return T.is_member(V.score_rows(s, d).select("score_id", "model_id"), _models(s, d), "model_id").select("score_id", "is_member")


def trials_prune(s, d):
    return T.prune_trials(_key(s, d), V.sessions(s, d), V.score_rows(s, d)).select(*TRIAL)


def sessions_align(s, d):
    order = _segments(s, d).withColumn("pos", F.xxhash64("seg_id"))
    return T.align_sessions(V.sessions(s, d), order, "seg_id").select("seg_id", "pos")


def sessions_merge(s, d):
    """First sessions overridden by the last ones of segments delivered again, with their statistics."""
    x = V.sessions(s, d)
    by = x.groupBy("seg_id").agg(F.count(F.lit(1)).alias("n"), *[f(c, "pos").alias(f"{k}_{c}") for k, f in (("a", F.min_by), ("z", F.max_by)) for c in ("pos", "stat0", "stat1")])
    first, last = (by.where(w).select("seg_id", *[F.col(f"{k}_{c}").alias(c) for c in ("pos", "stat0", "stat1")]) for k, w in (("a", "n > 0"), ("z", "n > 1")))
    return T.merge_sessions(first, last).select("seg_id", "pos", F.get("stat0", F.lit(0)).alias("n0"), F.round(F.aggregate("stat1", F.lit(0.0), lambda t, v: t + v), 5).alias("total"))


def sessions_of_model(s, d):
    """Sessions of the eighth model in order."""
    return T.sessions_of_index(V.sessions(s, d), "model_id", 7).select("pos", "model_id", "seg_id")


def sessions_of_segment(s, d):
    """Sessions of the segment of the eleventh session."""
    x = V.sessions(s, d)
    one = T.session_at(x, 10).first()
    return T.sessions_of(x, "seg_id", one.seg_id if one else "").select("pos", "model_id", "seg_id")


def scores_from_dense(s, d):
    """Best scores put into one dense row a model and back."""
    best = V.score_rows(s, d).groupBy(*TRIAL).agg(F.max("score").alias("score"))
    packed = best.groupBy("model_id").agg(F.array_sort(F.collect_list(F.struct("seg_id", "score"))).alias("c"))
    dense = packed.select(F.array("model_id").alias("modelset"), F.col("c.seg_id").alias("segset"), F.array("c.score").alias("matrix"), F.array(F.transform("c", lambda x: x["score"] > 0)).alias("mask"))
    return T.from_dense(dense).withColumnRenamed("value", "score")


def sessions_load_known(s, d):
    one = V.sessions(s, d).groupBy("seg_id").agg(F.max_by("stat0", "pos").alias("stat0"), F.max_by("stat1", "pos").alias("stat1"))
    return T.load_known(_segments(s, d), one).select("seg_id", F.size("stat0").alias("n0"), F.size("stat1").alias("n1"))


def sessions_subset(s, d):
    return T.subset_sessions(V.sessions(s, d), V.sessions(s, d).where("start is not null")).select("pos", "model_id")


def sessions_drop_empty(s, d):
    return T.drop_empty(table(s, d, "stat_server")).select("vec_id")


def model_index(s, d):
    return T.model_index(V.sessions(s, d))


def project_mask(s, d):
    return T.project(V.sessions(s, d), "stat1", "[0-2,7,63]").select("pos", F.posexplode("stat1").alias("i", "x"))


def validate_idmap(s, d):
    return schemas.validate_idmap(table(s, d, "idmap").withColumnsRenamed({"leftids": "model_id", "rightids": "seg_id"}))


def validate_key(s, d):
    return schemas.validate_key(_both_ways(s, d))


def validate_scores(s, d):
    return schemas.validate_scores(table(s, d, "scores").withColumnsRenamed({"modelset": "model_id", "segset": "seg_id", "scoremat": "score"}))


def validate_stats(s, d):
    return schemas.validate_stats(table(s, d, "stat_server").withColumnsRenamed({"modelset": "model_id", "segset": "seg_id"}))


def _roc(s, d):
    return M.roc_points(_labelled(s, d), ["source"])


def roc_points(s, d):
    return _roc(s, d).select("source", "score", "n_miss", "n_fa", F.round("p_miss", 9).alias("p_miss"), F.round("p_fa", 9).alias("p_fa"))


def roc_steps(s, d):
    return M.roc_steps(_labelled(s, d)).select("n_miss", "n_rejected")


def min_dcf(s, d):
    return M.min_dcf(_roc(s, d), 0.5, ["source"]).select("source", F.round("min_dcf", 9).alias("min_dcf"))


def eer_by_source(s, d):
    return M.eer(M.rocch(_roc(s, d), ["source"]), ["source"]).select("source", F.round("eer", 9).alias("eer"))


def prbep_by_source(s, d):
    return M.eer(M.rocch(_roc(s, d), ["source"]), ["source"], "n_miss", "n_fa").select("source", F.round("prbep", 6).alias("prbep"))


def rocch_vertices(s, d):
    return M.rocch(_roc(s, d), ["source"]).select("source", "n_miss", "n_fa")


def det_curve(s, d):
    curve = M.det_curve(M.rocch(_roc(s, d), ["source"]), ["source"], 20, box=M.PLOT_WINDOWS["old"])
    return curve.select("source", *[F.round(F.col(c) + 1.3e-9, 6).alias(c) for c in "xy"])


def pav_pools(s, d):
    return M.pav_pools(_roc(s, d), ["source"]).withColumn("p", F.round("p", 9))


def roc_filtered(s, d):
    return M.filter_points(_roc(s, d), ["source"]).select("source", "n_miss", "n_fa")


def rule_of_30(s, d):
    return M.doddington_30(_labelled(s, d), ["source"]).select("source", F.round("p_miss_30", 9).alias("p_miss_30"), F.round("p_fa_30", 9).alias("p_fa_30"))


def effective_prior(s, d):
    priors = table(s, d, "cutoff_targets").select("source", F.col("keep_fraction").alias("p"))
    return priors.select("source", F.round(M.effective_prior(F.col("p"), 10.0, 1.0), 9).alias("prior"), F.round(M.logit_effective_prior(F.col("p"), 10.0, 1.0), 9).alias("plo"), F.round(M.sigmoid(M.logit(F.col("p"))), 9).alias("back"))


def closed_set_llr_by_source(s, d):
    best = V.score_rows(s, d).groupBy("source", *TRIAL).agg(F.max("score").alias("score"))
    return M.closed_set_llr(best, by=["source"]).select("source", *TRIAL, F.round("llr", 6).alias("llr"))


def evaluations(s, d):
    return M.evaluations(_labelled(s, d).withColumn("y", F.col("is_target").cast("double")).withColumn("p", (F.col("score") > 0).cast("double")), "y", "p").select(*[F.round(c, 6).alias(c) for c in ("accuracy", "mse", "scc")])


QUERIES = {
    f.__name__: f
    for f in (
        idmap_map_left_to_right, idmap_map_right_to_left, idmap_filter_left, idmap_filter_right, idmap_merge, idmap_split, list_round_robin,
        ndx_distinct, ndx_filter_keep, ndx_filter_discard, ndx_merge, key_last_label, key_to_ndx, key_filter_keep, key_conflicts, key_merge,
        scores_align, scores_missing, scores_fill, scores_tar_non, scores_repeated_by_source, scores_merge, scores_filter_discard, scores_sort, scores_get,
        ids_difference, ids_member, trials_prune, sessions_align, sessions_merge, sessions_of_model, sessions_of_segment, scores_from_dense, sessions_load_known, sessions_subset, sessions_drop_empty,
        model_index, project_mask, validate_idmap, validate_key, validate_scores, validate_stats,
        roc_points, roc_steps, min_dcf, eer_by_source, prbep_by_source, rocch_vertices, det_curve, pav_pools, roc_filtered, rule_of_30, effective_prior, closed_set_llr_by_source, evaluations,
    )
}

_M = "md as (select distinct model_id from model_registry where deleted_at is null)"
_S = "sg as (select distinct seg_id from segment_registry where lang = 'en')"
_I, _K, _KL, _SC, _SS = V.IDMAP, V.KEY, V.KEY_LIST, V.SCORES, V.SESSIONS
_BOTH = "bo as (select model_id, seg_id, label = 'target' as is_target from kl where label <> 'none')"
_LAB = f"{_K}, {_SC}, la as (select * from sc join ky using (model_id, seg_id))"
_ROC = f"""{_LAB}, st as (select source, score, count(*) filter (is_target) as t, count(*) filter (not is_target) as n from la group by 1, 2),
tot as (select source, sum(t) as T_, sum(n) as N_ from st group by 1),
cu as (select source, score, sum(t) over w as n_miss, sum(n) over w as rej from st window w as (partition by source order by score)),
roc as (select source, null::double as score, 0 as n_miss, N_ as n_fa, 0 / nullif(T_, 0) as p_miss, N_ / nullif(N_, 0) as p_fa from tot
  union all select cu.source, score, n_miss, N_ - rej, n_miss / nullif(T_, 0), (N_ - rej) / nullif(N_, 0) from cu join tot on cu.source is not distinct from tot.source)"""


_HULL = f"""{_ROC}, lo as (select source, n_fa, min(n_miss) as n_miss from roc where p_miss is not null and p_fa is not null group by 1, 2),
 be as (select a.source, a.n_fa, a.n_miss, max((a.n_miss - b.n_miss) / (b.n_fa - a.n_fa)) filter (b.n_fa > a.n_fa) as s_before, min((b.n_miss - a.n_miss) / (a.n_fa - b.n_fa)) filter (b.n_fa < a.n_fa) as s_after
  from lo a join lo b on a.source is not distinct from b.source group by 1, 2, 3),
 hu as (select source, n_miss::bigint as n_miss, n_fa::bigint as n_fa from be where s_before is null or s_after is null or s_before < s_after)"""


def _det(box: tuple, points: int) -> str:
    """Hull edges clipped to the box of (false alarm, miss) rates, as normal quantiles."""
    t = lambda lo, at, d: f"({lo} - {at}) / nullif({d}, 0)"
    ends = {c: (f"case when d{c} = 0 then case when {c}0 between {lo} and {hi} then 0.0 else 2.0 end else least({t(lo, c + '0', 'd' + c)}, {t(hi, c + '0', 'd' + c)}) end",
                f"case when d{c} = 0 then 1.0 else greatest({t(lo, c + '0', 'd' + c)}, {t(hi, c + '0', 'd' + c)}) end") for c, lo, hi in (("x", *box[:2]), ("y", *box[2:]))}
    return f"""with {_HULL}, e as (select source, p_fa, p_miss from hu join (select distinct source as src, n_miss, n_fa, p_miss, p_fa from roc) r using (n_miss, n_fa) where hu.source is not distinct from r.src),
 g as (select source, lag(p_fa) over w as x0, lag(p_miss) over w as y0, p_fa - lag(p_fa) over w as dx, p_miss - lag(p_miss) over w as dy from e window w as (partition by source order by p_fa desc, p_miss)),
 k as (select *, greatest(0.0, {ends['x'][0]}, {ends['y'][0]}) as a, least(1.0, {ends['x'][1]}, {ends['y'][1]}) as b from g where x0 is not null),
 p as (select source, x0 + (a + (b - a) * i / {points}) * dx as px, y0 + (a + (b - a) * i / {points}) * dy as py from k, range({points + 1}) r(i) where a < b)
 select source, round({sql_probit('px')} + 1.3e-9, 6) as x, round({sql_probit('py')} + 1.3e-9, 6) as y from p"""


def _eer(m: str, f: str, out: str, digits: int) -> str:
    return f"""with {_ROC}, a as (select source, {m}::double as m, {f}::double as f from roc where p_miss is not null and p_fa is not null),
 i as (select * from a where m <= f), j as (select * from a where m >= f)
 select i.source, round(min(case when (i.f - i.m) + (j.m - j.f) = 0 then i.f else (i.f * j.m - j.f * i.m) / ((i.f - i.m) + (j.m - j.f)) end), {digits}) as {out}
 from i join j on i.source is not distinct from j.source group by 1"""


SQL = {
    "idmap_map_left_to_right": f"with {_I}, {_SS}, q as (select model_id, min(pos) as pos from ss group by 1), m as (select model_id, arg_max(seg_id, pos) as seg_id from idm group by 1) select pos, model_id, seg_id from q join m using (model_id)",
    "idmap_map_right_to_left": f"with {_I}, {_SS}, m as (select seg_id, arg_max(model_id, pos) as model_id from idm group by 1) select ss.pos, seg_id, m.model_id from ss join m using (seg_id)",
    "idmap_filter_left": f"with {_I}, {_M} select pos, model_id, seg_id from idm where model_id in (select model_id from md)",
    "idmap_filter_right": f"with {_I}, {_S} select pos, model_id, seg_id from idm where seg_id not in (select seg_id from sg)",
    "idmap_merge": f"with {_I}, a as (select pos, model_id, seg_id from idm where list_name = 'enrol') select * from a union all select pos, model_id, seg_id from idm where list_name is distinct from 'enrol' and (model_id, seg_id) not in (select (model_id, seg_id) from a)",
    "idmap_split": f"with {_I} select pos, ntile(7) over (order by pos) - 1 as part from idm",
    "list_round_robin": f"with {_I} select pos, pos % 5 as part from idm",
    "ndx_distinct": f"with {_SC} select distinct model_id, seg_id from sc",
    "ndx_filter_keep": f"with {_SC}, {_M}, {_S} select distinct model_id, seg_id from sc where model_id in (select model_id from md) and seg_id in (select seg_id from sg)",
    "ndx_filter_discard": f"with {_SC}, {_M}, {_S} select distinct model_id, seg_id from sc where model_id not in (select model_id from md) and seg_id not in (select seg_id from sg)",
    "ndx_merge": f"with {_SC}, {_KL} select model_id, seg_id from sc union select model_id, seg_id from kl",
    "key_last_label": f"with {_K} select * from ky",
    "key_to_ndx": f"with {_K} select model_id, seg_id from ky",
    "key_filter_keep": f"with {_K}, {_M}, {_S} select * from ky where model_id in (select model_id from md) and seg_id in (select seg_id from sg)",
    "key_conflicts": f"with {_KL}, {_BOTH} select model_id, seg_id from bo group by all having count(distinct is_target) = 2",
    "key_merge": f"with {_K}, {_BOTH} select model_id, seg_id, bool_or(is_target) as is_target from (select * from ky union all select * from bo) group by all",
    "scores_align": f"with {_SC}, {_K} select score_id, score from sc join ky using (model_id, seg_id)",
    "scores_missing": f"with {_SC}, {_K} select model_id, seg_id from ky where (model_id, seg_id) not in (select (model_id, seg_id) from sc)",
    "scores_fill": f"with {_SC}, {_K}, b as (select model_id, seg_id, max(score) as score from sc group by all) select model_id, seg_id, coalesce(score, -100.0) as score from ky left join b using (model_id, seg_id)",
    "scores_tar_non": f"with {_LAB} select score_id, score, is_target from la",
    "scores_repeated_by_source": f"with {_SC} select source, model_id, seg_id from sc group by all having count(*) > 1",
    "scores_merge": f"with {_SC} select source, model_id, seg_id, score from sc",
    "scores_filter_discard": f"with {_SC}, {_M}, {_S} select score_id from sc where model_id not in (select model_id from md) and seg_id not in (select seg_id from sg)",
    "scores_sort": f"with {_SC} select score_id, model_id, seg_id, score from sc",
    "scores_get": f"with {_SC} select score_id, score from sc where model_id = 'spk_zz00a1' and seg_id = 'tel_zz0000f1_a'",
    "ids_difference": f"with {_SC} select distinct model_id from sc where model_id not in (select model_id from model_registry where model_id is not null)",
    "ids_member": f"with {_SC}, {_M} select score_id, model_id in (select model_id from md) as is_member from sc",
    "trials_prune": f"with {_K}, {_SC}, {_SS} select model_id, seg_id from ky where model_id in (select model_id from ss) and seg_id in (select seg_id from sc)",
    "sessions_align": f"with {_SS}, {_S} select seg_id, min(pos) as pos from ss where seg_id in (select seg_id from sg) group by 1",
    "sessions_merge": f"with {_SS} select seg_id, max(pos) as pos, arg_max(stat0, pos)[1] as n0, round(list_sum(arg_max(stat1, pos)), 5) as total from ss group by 1",
    "sessions_of_model": f"with {_SS}, ix as (select model_id from (select distinct model_id from ss) order by model_id limit 1 offset 7) select pos, model_id, seg_id from ss where model_id in (select model_id from ix)",
    "sessions_of_segment": f"with {_SS} select pos, model_id, seg_id from ss where seg_id in (select seg_id from ss order by pos limit 1 offset 10)",
    "scores_from_dense": f"with {_SC} select model_id, seg_id, max(score) as score from sc group by all having max(score) > 0",
    "sessions_load_known": f"with {_SS}, {_S} select seg_id, case when x is null then 0 else len(x.stat0) end as n0, case when x is null then 0 else len(x.stat1) end as n1 from sg left join (select seg_id, arg_max({{'stat0': stat0, 'stat1': stat1}}, pos) as x from ss group by 1) using (seg_id)",
    "sessions_subset": f"with {_SS} select pos, model_id from ss where (model_id, seg_id) in (select (model_id, seg_id) from ss where \"start\" is not null)",
    "sessions_drop_empty": "select vec_id from stat_server where list_sum(list_transform(stat0, lambda x: coalesce(x, 0))) <> 0",
    "model_index": f"with {_SS} select model_id, row_number() over (order by model_id) - 1 as model_idx from (select distinct model_id from ss)",
    "project_mask": f"with {_SS} select pos, unnest(range(5)) as i, unnest([stat1[1], stat1[2], stat1[3], stat1[8], stat1[64]]) as x from ss",
    "validate_idmap": 'select count(*) as n_rows, count(*) filter (leftids is null or rightids is null) as null_ids, count(*) filter (("start" is null) <> (stop is null)) as one_sided, count(*) filter (stop < "start") as reversed from idmap',
    "validate_key": f"with {_KL}, {_BOTH}, p as (select model_id, seg_id, count(distinct is_target) as l from bo group by all) select count(*) as n_rows, count(*) filter (model_id is null or seg_id is null) as null_ids, count(*) filter (l > 1) as conflicts from p",
    "validate_scores": "select count(*) as n_rows, count(*) filter (modelset is null or segset is null) as null_ids, count(*) filter (scoremat is null or isnan(scoremat) or isinf(scoremat)) as not_finite from scores",
    "validate_stats": "select count(*) as n_rows, count(*) filter (modelset is null or segset is null) as null_ids, count(*) filter (stat0 is null or stat1 is null or len(stat1) % greatest(len(stat0), 1) <> 0) as bad_shape from stat_server",
    "roc_points": f"with {_ROC} select source, score, n_miss::bigint as n_miss, n_fa::bigint as n_fa, round(p_miss, 9) as p_miss, round(p_fa, 9) as p_fa from roc",
    "roc_steps": f"with {_LAB} select count(*) filter (is_target) over w as n_miss, count(*) filter (not is_target) over w as n_rejected from la window w as (order by score, is_target desc rows unbounded preceding)",
    "min_dcf": f"with {_ROC} select source, round(min(0.5 * p_miss + 0.5 * p_fa), 9) as min_dcf from roc group by 1",
    "rocch_vertices": f"with {_HULL} select * from hu",
    "det_curve": _det(M.PLOT_WINDOWS["old"], 20),
    "pav_pools": f"""with {_HULL}, mk as (select source, n_miss, n_fa from hu union select source, max(n_miss)::bigint, 0::bigint from roc where p_miss is not null and p_fa is not null group by 1),
 sk as (select mk.source, mk.n_miss, mk.n_fa, max(score) as score from mk join roc on mk.source is not distinct from roc.source and mk.n_miss = roc.n_miss and mk.n_fa = roc.n_fa group by all),
 pl as (select source, case when lead(n_fa) over w is not null then score end as upto_score, (n_miss - lag(n_miss) over w)::bigint as n_target, (lag(n_fa) over w - n_fa)::bigint as n_nontarget from sk window w as (partition by source order by n_fa desc, n_miss))
 select *, round(n_target / (n_target + n_nontarget), 9) as p from pl where n_target + n_nontarget > 0""",
    "roc_filtered": f"""with {_ROC}, fl as (select source, n_miss::bigint as n_miss, n_fa::bigint as n_fa, lag(n_miss) over w as m0, lead(n_miss) over w as m1, lag(n_fa) over w as f0, lead(n_fa) over w as f1 from roc window w as (partition by source order by n_fa desc, n_miss))
 select source, n_miss, n_fa from fl where not coalesce(m0 = n_miss and m1 = n_miss, false) and not coalesce(f0 = n_fa and f1 = n_fa, false)""",
    "eer_by_source": _eer("p_miss", "p_fa", "eer", 9),
    "prbep_by_source": _eer("n_miss", "n_fa", "prbep", 6),
    "rule_of_30": f"with {_LAB} select source, round(30.0::double / nullif(count(*) filter (is_target), 0), 9) as p_miss_30, round(30.0::double / nullif(count(*) filter (not is_target), 0), 9) as p_fa_30 from la group by 1",
    "effective_prior": "select source, round(keep_fraction * 10 / (keep_fraction * 10 + (1 - keep_fraction)), 9) as prior, round(ln(keep_fraction * 10 / (1 - keep_fraction)), 9) as plo, round(keep_fraction, 9) as back from cutoff_targets",
    "closed_set_llr_by_source": f"""with {_SC}, b as (select source, model_id, seg_id, max(score) as score from sc group by all),
 o as (select a.source, a.model_id, a.seg_id, a.score, list(x.score) as v from b a join b x on a.source is not distinct from x.source and a.seg_id = x.seg_id and a.model_id <> x.model_id group by all)
 select b.source, b.model_id, b.seg_id, round(ln(0.5) + b.score - list_max(v) - ln(list_sum(list_transform(v, lambda y: exp(y - list_max(v)))) * 0.5 / len(v)), 6) as llr
 from b left join o on b.source is not distinct from o.source and b.model_id = o.model_id and b.seg_id = o.seg_id""",
    "evaluations": f"with {_LAB}, y as (select is_target::int::double as y, (score > 0)::int::double as p from la) select round(100 * avg((y = p)::int), 6) as accuracy, round(avg((y - p) ** 2), 6) as mse, round(corr(y, p) ** 2, 6) as scc from y",
}
