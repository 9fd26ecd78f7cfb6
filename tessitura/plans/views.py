"""The driver's tables as the long tables of :mod:`tessitura.schemas`, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.functions.ids import is_named, seg_id, sql_is_named, sql_seg_id
from tessitura.plans.tables import table


def idmap(spark, d) -> DataFrame:
    rows = table(spark, d, "idmap").where(is_named("leftids"))
    return rows.select("pos", "list_name", F.col("leftids").alias("model_id"), seg_id("rightids").alias("seg_id"), "start", "stop").where("seg_id is not null")


def key_list(spark, d) -> DataFrame:
    rows = table(spark, d, "trial_key").where(is_named("modelset"))
    label = F.when(F.col("tar") & ~F.coalesce("non", F.lit(False)), "target").when(F.col("non") & ~F.coalesce("tar", F.lit(False)), "nontarget").otherwise("none")
    return rows.select(F.col("key_id").alias("pos"), F.col("modelset").alias("model_id"), seg_id("segset").alias("seg_id"), label.alias("label")).where("seg_id is not null")


def score_rows(spark, d) -> DataFrame:
    s = F.col("scoremat")
    valid = F.col("scoremask") & s.isNotNull() & ~F.isnan(s) & (F.abs(s) != float("inf")) & is_named("modelset")
    rows = table(spark, d, "scores").where(valid)
    return rows.select("score_id", "source", F.col("modelset").alias("model_id"), seg_id("segset").alias("seg_id"), s.alias("score")).where("seg_id is not null")


def sessions(spark, d) -> DataFrame:
    v = F.col("stat1").cast("array<double>")
    ok = (F.size(v) == 64) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = table(spark, d, "stat_server").where(F.coalesce(ok, F.lit(False)) & is_named("modelset"))
    return rows.select(F.col("vec_id").alias("pos"), F.col("modelset").alias("model_id"), seg_id("segset").alias("seg_id"), "start", "stop", F.col("stat0").cast("array<double>").alias("stat0"), v.alias("stat1")).where("seg_id is not null")


_SEG, _RIGHT = sql_seg_id("segset"), sql_seg_id("rightids")
IDMAP = f"""idm as (select pos, list_name, leftids as model_id, {_RIGHT} as seg_id, "start", stop from idmap where {sql_is_named('leftids')} and {_RIGHT} is not null)"""
KEY_LIST = f"""kl as (select key_id as pos, modelset as model_id, {_SEG} as seg_id,
  case when tar and not coalesce("non", false) then 'target' when "non" and not coalesce(tar, false) then 'nontarget' else 'none' end as label
  from trial_key where {sql_is_named('modelset')} and {_SEG} is not null)"""
KEY = KEY_LIST + """,
ky as (select model_id, seg_id, label = 'target' as is_target from (select model_id, seg_id, arg_max(label, pos) as label from kl group by all) where label <> 'none')"""
SCORES = f"""sc as (select score_id, source, modelset as model_id, {_SEG} as seg_id, scoremat as score from scores
  where scoremask and scoremat is not null and not isnan(scoremat) and not isinf(scoremat) and {sql_is_named('modelset')} and {_SEG} is not null)"""
SESSIONS = f"""ss as (select vec_id as pos, modelset as model_id, {_SEG} as seg_id, "start", stop, stat0::double[] as stat0, stat1::double[] as stat1 from stat_server
  where len(stat1) = 64 and list_bool_and(list_transform(stat1, lambda x: coalesce(isfinite(x), false))) and list_bool_or(list_transform(stat1, lambda x: x <> 0))
  and {sql_is_named('modelset')} and {_SEG} is not null)"""
