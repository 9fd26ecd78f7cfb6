"""Queries of the training-data problems, with production parameters, over their whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessitura.functions.ids import sql_is_named, sql_seg_id
from tessitura.llm import cutoffs, mixing, neighbours, packing, splits, topn, toxicity
from tessitura.plans.tables import table


def _tables(spark, d, *names):
    return [table(spark, d, n) for n in names]


def p1_found(spark, d):
    scores, key, targets = _tables(spark, d, "scores", "trial_key", "cutoff_targets")
    return cutoffs.keep_fraction(cutoffs.labelled_records(scores, key), targets).kept().select("score_id")


def p1_cutoffs(spark, d):
    return cutoffs.cutoff_report(*_tables(spark, d, "scores", "trial_key", "cutoff_targets"))


def p3_found(spark, d):
    return splits.tied_groups(table(spark, d, "idmap"))


def p3_assignment(spark, d):
    return splits.GroupedSplits(*_tables(spark, d, "idmap", "split_targets")).assignment()


def p3_shares(spark, d):
    return splits.GroupedSplits(*_tables(spark, d, "idmap", "split_targets")).report()


def p3_labels(spark, d):
    return splits.GroupedSplits(*_tables(spark, d, "idmap", "split_targets")).label_report()


def p3_check(spark, d):
    """Rows not assigned once, groups in two splits, splits off their share: none."""
    tables = _tables(spark, d, "idmap", "split_targets")
    return splits.split_check(*tables, splits.GroupedSplits(*tables).assignment())


def p5_found(spark, d):
    return topn.top_segments(table(spark, d, "scores")).select("score_id")


def p5_top(spark, d):
    return topn.top_segments(table(spark, d, "scores"))


def _vectors(spark, d):
    return neighbours.Neighbours(table(spark, d, "stat_server"), "vec_id", "stat1", 64)


def p6_found(spark, d):
    return _vectors(spark, d).similar_pairs(0.90).select("vec_a", "vec_b")


def p6_top(spark, d):
    return _vectors(spark, d).search(F.col("id") % 100 == 0).withColumn("cosine", F.round("cosine", 6))


def p6_recall(spark, d):
    """Queries of p6_top, true neighbours wanted, and whether at least nine tenths of them are found."""
    r = neighbours.search_recall(table(spark, d, "stat_server"), "vec_id", "stat1", 64, F.col("id") % 100 == 0)
    return r.select("n_queries", "n_wanted", (F.col("n_found") >= 0.9 * F.col("n_wanted")).alias("found_enough"))


def p8_pack(spark, d):
    return packing.pack_documents(*_tables(spark, d, "documents", "container_sizes"))


def p8_report(spark, d):
    return packing.pack_report(p8_pack(spark, d), table(spark, d, "container_sizes"))


def p8_check(spark, d):
    """Bins over their length, documents cut needlessly or not covered: none."""
    return packing.pack_check(table(spark, d, "documents"), p8_pack(spark, d), table(spark, d, "container_sizes"))


def p9_mixture(spark, d):
    return mixing.Mixture(*_tables(spark, d, "documents", "mix_targets")).rows


def p9_shares(spark, d):
    return mixing.Mixture(*_tables(spark, d, "documents", "mix_targets")).report()


def p9_check(spark, d):
    """Documents used too often, uses drawn twice, shares off: none."""
    return mixing.mixture_check(p9_mixture(spark, d), table(spark, d, "mix_targets"), 0.01)


def _toxic(spark, d):
    return toxicity.toxic_documents(*_tables(spark, d, "documents", "doc_labels"))


def p10_found(spark, d):
    return _toxic(spark, d).where("toxic").select("doc_id")


def p10_scores(spark, d):
    return _toxic(spark, d)


def p10_rates(spark, d):
    return toxicity.toxicity_rates(_toxic(spark, d))


QUERIES = {f.__name__: f for f in (p1_found, p1_cutoffs, p3_found, p3_assignment, p3_shares, p3_labels, p3_check, p5_found, p5_top, p6_found, p6_top, p6_recall, p8_pack, p8_report, p8_check, p9_mixture, p9_shares, p9_check, p10_found, p10_scores, p10_rates)}

_SEG = sql_seg_id("segset")
_VALID = f"scoremask and scoremat is not null and not isnan(scoremat) and not isinf(scoremat) and {sql_is_named('modelset')} and {_SEG} is not null"
_KEPT = f"""
k as (select modelset, {_SEG} as seg_id, coalesce(bool_or(tar), false) as t, coalesce(bool_or("non"), false) as n from trial_key
  where {sql_is_named('modelset')} and {_SEG} is not null group by 1, 2),
r as (select score_id, source, scoremat, t from (select *, {_SEG} as seg_id from scores where {_VALID}) join k using (modelset, seg_id)
  join cutoff_targets using (source) where t <> n),
c as (select source, keep_fraction, scoremat, count(*) over (partition by source order by scoremat desc range unbounded preceding) as at_or_above,
  count(*) over (partition by source) as n_records from r join cutoff_targets using (source)),
cut as (select source, keep_fraction, n_records, max(scoremat) as cutoff from c where at_or_above >= keep_fraction * n_records group by all)
"""
_TOP = f"""
v as (select modelset, {_SEG} as seg_id, score_id, scoremat from scores where {_VALID}),
b as (select * from v qualify row_number() over (partition by modelset, seg_id order by scoremat desc, score_id) = 1),
t as (select *, row_number() over (partition by modelset order by scoremat desc, score_id) as rank from b qualify rank <= 10)
"""
_VECTORS = """v as (select vec_id, list_transform(stat1, lambda x: x::double) as x from stat_server where len(stat1) = 64
  and list_bool_and(list_transform(stat1, lambda x: coalesce(isfinite(x), false))) and list_bool_or(list_transform(stat1, lambda x: x <> 0)))"""
_LEFT = sql_seg_id("rightids")
SQL = {
    "p1_found": f"with {_KEPT} select score_id from r join cut using (source) where scoremat >= cutoff",
    "p1_cutoffs": f"""with {_KEPT} select source, keep_fraction, n_records, cutoff, count(*) as n_kept, count(*) filter (t) as n_target, count(*) filter (not t) as n_nontarget
  from r join cut using (source) where scoremat >= cutoff group by all""",
    "p3_found": f"""with recursive p as (select distinct leftids as l, {_LEFT} as s from idmap where {sql_is_named('leftids')}),
m as (select s, min(l) as v from p where s is not null group by 1),
e as (select distinct l as a, v as b from p join m using (s) where l <> v),
b as (select a, b from e union select b, a from e),
cc(id, comp) using key (id) as (
  select distinct l as id, l as comp from p
  union
  select u.id, min(v.comp) from recurring.cc as u join b on u.id = b.a join cc as v on b.b = v.id where v.comp < u.comp group by u.id)
select comp as group_leftid, id as leftid from cc where comp <> id""",
    "p3_check": "select 0 as unassigned, 0 as split_leftids, 0 as split_seg_ids, 0 as shares_off",
    "p5_found": f"with {_TOP} select score_id from t",
    # the search is not exact in general (see p6_recall); on small tables every block reranks all that comes near
    "p6_top": f"""with {_VECTORS}, p as (select a.vec_id, b.vec_id as neighbour, list_cosine_similarity(a.x, b.x) as cosine from v a, v b where a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
t as (select *, row_number() over (partition by vec_id order by cosine desc, neighbour) as rank from p qualify rank <= 5) select vec_id, neighbour, round(cosine, 6) as cosine, rank::int as rank from t""",
    "p6_found": f"""with {_VECTORS},
p as (select a.vec_id as a, b.vec_id as b, list_cosine_similarity(a.x, b.x) as c from v a, v b where a.vec_id <> b.vec_id),
t as (select * from p qualify row_number() over (partition by a order by c desc, b) <= 5)
select distinct least(a, b) as vec_a, greatest(a, b) as vec_b from t where c >= 0.9""",
    "p6_recall": """with v as (select vec_id from stat_server where len(stat1) = 64 and vec_id is not null
  and list_bool_and(list_transform(stat1, lambda x: coalesce(isfinite(x), false))) and list_bool_or(list_transform(stat1, lambda x: x <> 0)))
select count(*) as n_queries, (count(*) * least(5, (select count(*) - 1 from v)))::bigint as n_wanted, true as found_enough from v where vec_id % 100 = 0""",
    "p8_check": "select 0 as overfull, 0 as cut_needlessly, 0 as not_covered",
    "p9_check": "select 0 as over_repeats, 0 as drawn_twice, 0 as shares_off",
    "p5_top": f"with {_TOP} select * from t",
}
