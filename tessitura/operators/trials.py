"""Algebra of id maps, trial indexes, keys and scores as relational operations.

Where the order of a list decides (first or last match), the list carries a position column.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRIAL = ["model_id", "seg_id"]


# -- id maps --------------------------------------------------------------------------------------


def map_ids(ids: DataFrame, idmap: DataFrame, src: str, dst: str) -> DataFrame:
    """(pos, src, dst) of every input (pos, src) that is mapped; of duplicates in the map the last wins.
    One output per input row; inputs that are not mapped are left out."""
    last = idmap.where(F.col(src).isNotNull()).groupBy(src).agg(F.max_by(dst, "pos").alias(dst))
    return ids.select("pos", src).join(last, src).select("pos", src, dst)


def map_left_to_right(ids: DataFrame, idmap: DataFrame) -> DataFrame:
    return map_ids(ids, idmap, "model_id", "seg_id")


def map_right_to_left(ids: DataFrame, idmap: DataFrame) -> DataFrame:
    return map_ids(ids, idmap, "seg_id", "model_id")


def filter_on(df: DataFrame, ids: DataFrame, column: str, keep: bool) -> DataFrame:
    """Rows whose ``column`` is (keep) or is not (discard) among ``ids``. A null id is in no list."""
    return df.join(ids.select(column).distinct(), column, "left_semi" if keep else "left_anti")


def filter_trials(df: DataFrame, models: DataFrame, segs: DataFrame, keep: bool) -> DataFrame:
    """Keep: trials of listed models with listed segments. Discard: neither model nor segment is listed."""
    return filter_on(filter_on(df, models, "model_id", keep), segs, "seg_id", keep)


def merge_idmaps(first: DataFrame, second: DataFrame) -> DataFrame:
    """All rows of ``first``, and of ``second`` those whose pair is not in ``first``."""
    return first.unionByName(second.join(first.select(*TRIAL).distinct(), TRIAL, "left_anti"))


def split_idmap(idmap: DataFrame, n: int) -> DataFrame:
    """Adds ``part`` (0 to n-1): contiguous near-equal pieces in order of ``pos``, the larger ones first.

    Positions come from distributed running counts, not from one global window."""
    from tessitura.operators.prefix import running

    ranked = running(idmap.withColumn("_one", F.lit(1)), ["pos"], {"_rank": "_one"})
    total = idmap.count()
    base, extra = divmod(total, n)
    r, edge = F.col("_rank") - 1, (base + 1) * extra
    part = F.when(r < edge, F.floor(r / (base + 1))).otherwise(extra + F.floor((r - edge) / max(1, base)))
    return ranked.withColumn("part", part.cast("int")).drop("_rank", "_one")


def split_round_robin(files: DataFrame, n: int) -> DataFrame:
    """Adds ``part``: position modulo ``n``."""
    return files.withColumn("part", (F.col("pos") % n).cast("int"))


# -- trial indexes and keys -----------------------------------------------------------------------


def trial_index(pairs: DataFrame) -> DataFrame:
    """Distinct trials of a list of pairs; pairs with a null id are no trials."""
    return pairs.where(F.col("model_id").isNotNull() & F.col("seg_id").isNotNull()).select(*TRIAL).distinct()


def merge_indexes(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [p.select(*TRIAL) for p in parts]).distinct()


def key_from_list(rows: DataFrame) -> DataFrame:
    """(model_id, seg_id, is_target) from (pos, model_id, seg_id, label): the last of duplicates wins;
    a label other than 'target' or 'nontarget' makes no trial."""
    last = rows.where(F.col("model_id").isNotNull() & F.col("seg_id").isNotNull()).groupBy(*TRIAL).agg(F.max_by("label", "pos").alias("label"))
    return last.where(F.col("label").isin("target", "nontarget")).select(*TRIAL, (F.col("label") == "target").alias("is_target"))


def key_to_index(key: DataFrame) -> DataFrame:
    return key.select(*TRIAL).distinct()


def key_conflicts(*parts: DataFrame) -> DataFrame:
    """Trials that the merged keys label both ways; a merge is valid only if there are none."""
    both = reduce(DataFrame.unionByName, parts).groupBy(*TRIAL).agg(F.bool_or("is_target").alias("t"), F.bool_and("is_target").alias("all"))
    return both.where(F.col("t") & ~F.col("all")).select(*TRIAL)


def merge_keys(*parts: DataFrame, check: bool = True) -> DataFrame:
    """Union of keys. With ``check`` conflicting labels raise; otherwise target wins."""
    if check and (bad := key_conflicts(*parts).limit(1).collect()):
        raise ValueError(f"trial labelled both ways: {bad[0].asDict()}")
    return reduce(DataFrame.unionByName, parts).groupBy(*TRIAL).agg(F.bool_or("is_target").alias("is_target"))


# -- scores ---------------------------------------------------------------------------------------


def repeated_scores(*parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Trials scored more than once, within groups of ``by`` (null is a group)."""
    return reduce(DataFrame.unionByName, parts).groupBy(*by, *TRIAL).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*by, *TRIAL)


def merge_scores(*parts: DataFrame, check: bool = True) -> DataFrame:
    """Union of scores; with ``check`` a trial scored twice raises, otherwise all rows stay."""
    if check and (bad := repeated_scores(*parts).limit(1).collect()):
        raise ValueError(f"trial scored twice: {bad[0].asDict()}")
    return reduce(DataFrame.unionByName, parts)


def align_scores(scores: DataFrame, trials: DataFrame) -> DataFrame:
    """Scores of the listed trials only."""
    return scores.join(trials.select(*TRIAL).distinct(), TRIAL, "left_semi")


def missing_scores(scores: DataFrame, trials: DataFrame) -> DataFrame:
    """Listed trials without score."""
    return trials.select(*TRIAL).distinct().join(scores, TRIAL, "left_anti")


def fill_missing(scores: DataFrame, trials: DataFrame, value: float) -> DataFrame:
    """Every listed trial with its score, or ``value``. Scores outside the list are left out."""
    return trials.select(*TRIAL).distinct().join(scores, TRIAL, "left").withColumn("score", F.coalesce("score", F.lit(value)))


def labelled_scores(scores: DataFrame, key: DataFrame) -> DataFrame:
    """Scores of keyed trials with ``is_target``: targets and nontargets in one pass."""
    return scores.join(key, TRIAL)


def sort_scores(scores: DataFrame) -> DataFrame:
    return scores.orderBy(*TRIAL, "score")


def get_score(scores: DataFrame, model_id: str, seg_id: str) -> DataFrame:
    """Rows of one trial; both conditions reach the scan."""
    return scores.where((F.col("model_id") == model_id) & (F.col("seg_id") == seg_id))


# -- lists ----------------------------------------------------------------------------------------


def difference(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values of ``a`` that are not in ``b``."""
    return a.select(column).distinct().join(b.select(column).distinct(), column, "left_anti").orderBy(column)


def is_member(a: DataFrame, b: DataFrame, column: str, flag: str = "is_member") -> DataFrame:
    """``a`` with a flag: is its value in ``b``."""
    known = b.select(column).distinct().withColumn(flag, F.lit(True))
    return a.join(known, column, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def prune_trials(trials: DataFrame, enroll: DataFrame, test: DataFrame) -> DataFrame:
    """Trials whose model is enrolled and whose segment is tested."""
    return filter_on(filter_on(trials, enroll, "model_id", True), test, "seg_id", True)


# -- sessions -------------------------------------------------------------------------------------


def align_sessions(stats: DataFrame, order: DataFrame, column: str) -> DataFrame:
    """Sessions in the order of a list (pos, column); of repeated ids the first session (by ``pos``) is taken.
    ``list_pos`` is the position in the list; ids without session are left out (see :func:`unaligned`)."""
    first = Window.partitionBy(column).orderBy("pos")
    one = stats.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return order.select(F.col("pos").alias("list_pos"), column).join(one, column)


def unaligned(stats: DataFrame, order: DataFrame, column: str) -> DataFrame:
    return order.join(stats, column, "left_anti")


def merge_sessions(*parts: DataFrame) -> DataFrame:
    """Union by ``seg_id``, the last part wins; parts are positions of the arguments."""
    marked = reduce(DataFrame.unionByName, [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)])
    columns = [c for c in marked.columns if c not in ("seg_id", "_part")]
    return marked.groupBy("seg_id").agg(*[F.max_by(c, "_part").alias(c) for c in columns])


def load_known(known: DataFrame, stats: DataFrame) -> DataFrame:
    """Every known segment with its statistics, empty arrays where there are none."""
    cols = [F.coalesce(c, F.array().cast("array<double>")).alias(c) for c in ("stat0", "stat1")]
    return known.select("seg_id").distinct().join(stats, "seg_id", "left").select("seg_id", *cols)


def subset_sessions(stats: DataFrame, pairs: DataFrame) -> DataFrame:
    """Sessions of the listed (model, segment) pairs whose stat1 is not all zero."""
    return stats.join(pairs.select(*TRIAL).distinct(), TRIAL, "left_semi").where(F.exists("stat1", lambda x: x != 0))


def drop_empty(stats: DataFrame) -> DataFrame:
    """Sessions that have frames: a positive sum of stat0."""
    return stats.where(F.aggregate("stat0", F.lit(0.0), lambda a, x: a + F.coalesce(x.cast("double"), F.lit(0.0))) != 0)


def model_index(df: DataFrame) -> DataFrame:
    """(model_id, model_idx): rank among the sorted distinct models, from 0; counted without a global window."""
    from tessitura.operators.prefix import running

    ids = df.where("model_id is not null").select("model_id").distinct().withColumn("_one", F.lit(1))
    return running(ids, ["model_id"], {"model_idx": "_one"}).select("model_id", (F.col("model_idx") - 1).alias("model_idx"))


def indexed(df: DataFrame, column: str, order: str | None = None) -> DataFrame:
    """``df`` with ``_index``: the rank from 0 of ``column`` among its distinct sorted values, or with ``order`` of the row
    itself in that order; counted without a global window."""
    from tessitura.operators.prefix import running

    if order:
        return running(df.withColumn("_one", F.lit(1)), [order, column], {"_index": "_one"}).withColumn("_index", F.col("_index") - 1).drop("_one")
    ids = df.where(F.col(column).isNotNull()).select(F.col(column).alias("_id")).distinct().withColumn("_one", F.lit(1))
    ids = running(ids, ["_id"], {"_index": "_one"}).select("_id", (F.col("_index") - 1).alias("_index"))
    return df.join(ids, F.col(column) == F.col("_id")).drop("_id")


def sessions_of(stats: DataFrame, column: str, value: str) -> DataFrame:
    """Sessions of a model or of a segment: a filter that reaches the scan."""
    return stats.where(F.col(column) == value)


def sessions_of_index(stats: DataFrame, column: str, index: int) -> DataFrame:
    """Sessions of the model (or segment) with the given rank among the sorted ones, from 0."""
    return indexed(stats, column).where(F.col("_index") == index).drop("_index")


def session_at(stats: DataFrame, index: int, order: str = "pos") -> DataFrame:
    """The session with the given rank in the order of the list, from 0."""
    return indexed(stats, "seg_id", order).where(F.col("_index") == index).drop("_index")


def iterate_sessions(stats: DataFrame, order: str = "pos") -> Iterator[tuple[list[float], list[float]]]:
    """(stat0, stat1) of one session after the other; the driver holds one partition at a time."""
    for r in stats.orderBy(order).select("stat0", "stat1").toLocalIterator():
        yield r.stat0, r.stat1


def from_dense(df: DataFrame) -> DataFrame:
    """(model_id, seg_id, value) of the set cells of dense artefacts: rows (modelset, segset, matrix, mask) with arrays of
    ids and arrays of rows, as array files keep them. A null mask sets all cells."""
    by_row = df.select("segset", F.posexplode(F.arrays_zip(F.col("modelset").alias("m"), F.col("matrix").alias("v"), F.coalesce("mask", F.transform("modelset", lambda _: F.lit(None).cast("array<boolean>"))).alias("k"))).alias("_r", "_row"))
    cells = by_row.select(F.col("_row.m").alias("model_id"), F.explode(F.arrays_zip(F.col("segset").alias("s"), F.col("_row.v").alias("v"), F.coalesce("_row.k", F.transform("segset", lambda _: F.lit(True))).alias("k"))).alias("_c"))
    return cells.where("_c.k").select("model_id", F.col("_c.s").alias("seg_id"), F.col("_c.v").alias("value"))


def existing_files(ids: DataFrame, listing: DataFrame, pattern: str, column: str = "show") -> DataFrame:
    """Ids whose formatted path is in a listing (path); ``pattern`` has one ``{}``."""
    path: Column = F.format_string(pattern.replace("{}", "%s"), F.col(column))
    return ids.join(listing.select("path").distinct(), path == F.col("path"), "left_semi")


def parse_mask(mask: str) -> list[int]:
    """Indices of a mask like '[1-3,10]': 0-based, ranges inclusive."""
    out: list[int] = []
    for part in mask.strip().strip("[]").split(","):
        a, _, b = part.strip().partition("-")
        out += range(int(a), int(b or a) + 1)
    return out


def project(df: DataFrame, column: str, mask: str) -> DataFrame:
    """Only the masked coefficients of an array column."""
    return df.withColumn(column, F.array(*[F.get(column, F.lit(i)) for i in parse_mask(mask)]))
