"""Queries of the general data problems, with production parameters, over their whole tables."""

from __future__ import annotations

from tessitura.functions.ids import sql_is_named, sql_seg_id
from tessitura.operators import intervals, references, skew
from tessitura.plans.tables import table


def p2_found(spark, d):
    return skew.heavy_left_ids(table(spark, d, "idmap"), table(spark, d, "model_registry"))


def p2_profile(spark, d):
    return skew.left_id_profile(table(spark, d, "idmap"), table(spark, d, "model_registry"))


def p4_found(spark, d):
    return intervals.segment_periods(table(spark, d, "idmap"))


def p4_coverage(spark, d):
    return intervals.segment_coverage(table(spark, d, "idmap"))


def _p7(spark, d):
    return [table(spark, d, t) for t in ("scores", "trial_key", "model_registry", "segment_registry")]


def p7_found(spark, d):
    return references.orphan_references(*_p7(spark, d)).select("tbl", "row_id", "field", "cause")


def p7_report(spark, d):
    return references.orphan_report(*_p7(spark, d))


QUERIES = {f.__name__: f for f in (p2_found, p2_profile, p4_found, p4_coverage, p7_found, p7_report)}

_SEG = sql_seg_id("rightids")
_EXISTS = '"start" is not null and stop is not null and "start" >= 0 and stop > "start"'
_PERIODS = f"""
i as (select distinct {_SEG} as seg_id, "start"::bigint as s, stop::bigint as t from idmap where {_EXISTS} and {_SEG} is not null),
k as (select * from i where seg_id in (select seg_id from i group by 1 having count(*) >= 2)),
r as (select *, max(t) over (partition by seg_id order by s, t rows between unbounded preceding and 1 preceding) as reach from k),
g as (select *, sum(case when reach is null or s > reach then 1 else 0 end) over (partition by seg_id order by s, t rows unbounded preceding) as island from r),
p as (select seg_id, island, min(s) as lo, max(t) as hi from g group by 1, 2),
f as (select seg_id, 'period' as kind, lo as from_frame, hi as to_frame from p
      union all select * from (select seg_id, 'gap' as kind, hi as from_frame, lead(lo) over (partition by seg_id order by lo) as to_frame from p) where to_frame is not null)
"""
_REFS = f"""
refs as (select 'scores' as tbl, score_id as row_id, 'modelset' as field, modelset as key, scored_at as ref_at from scores where {sql_is_named("modelset")}
  union all select 'trial_key', key_id, 'modelset', modelset, keyed_at from trial_key where {sql_is_named("modelset")}
  union all select 'scores', score_id, 'segset', {sql_seg_id("segset")}, scored_at from scores where {sql_seg_id("segset")} is not null
  union all select 'trial_key', key_id, 'segset', {sql_seg_id("segset")}, keyed_at from trial_key where {sql_seg_id("segset")} is not null),
reg as (select 'modelset' as field, model_id as key, created_at, deleted_at from model_registry union all select 'segset', seg_id, created_at, deleted_at from segment_registry),
o as (select tbl, row_id, field, ref_at,
  case when count(reg.key) = 0 then 'missing' when min(created_at) > ref_at then 'late' else 'deleted' end as cause
  from refs left join reg using (field, key) group by tbl, row_id, field, ref_at
  having not coalesce(bool_or(created_at <= ref_at and (deleted_at is null or deleted_at > ref_at)), false))
"""
SQL = {
    "p2_found": f"select leftids from idmap where {sql_is_named('leftids')} group by 1 having count(*) * 100 >= (select count(*) from idmap)",
    "p2_profile": f"""
with reg as (select model_id, count(*) as n, min(corpus) as corpus from (select distinct model_id, corpus, created_at, deleted_at from model_registry) group by 1)
select a.*, coalesce(n, 0)::bigint as n_registered, corpus from (
  select leftids, count(*) as n_rows, count(distinct {_SEG}) as n_segments,
    coalesce(sum(case when {_EXISTS} then stop::bigint - "start" else 0 end), 0)::bigint as n_frames
  from idmap where {sql_is_named('leftids')} group by 1) a left join reg on model_id = leftids""",
    "p4_found": f"with {_PERIODS} select * from f",
    "p4_coverage": f"""with {_PERIODS} select seg_id, count(*) filter (kind = 'period') as n_periods, count(*) filter (kind = 'gap') as n_gaps,
  coalesce(sum(to_frame - from_frame) filter (kind = 'period'), 0)::bigint as covered, coalesce(sum(to_frame - from_frame) filter (kind = 'gap'), 0)::bigint as uncovered
  from f group by 1""",
    "p7_found": f"with {_REFS} select tbl, row_id, field, cause from o",
    "p7_report": f"with {_REFS} select tbl, field, cause, strftime(ref_at, '%Y-%m') as month, count(*) as n_orphans from o group by all",
}
