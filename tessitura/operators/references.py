"""References to records that do not exist.

A Bloom filter of the parent keys, broadcast, proves most orphans without a join; only references that the
filter lets through are verified by an exact anti-join against the registry, and causes are looked up for
the orphans that remain. The filter is a table of blocks of four 64-bit words, built by ``bit_or``, sized by the keys
up to a broadcast budget of MAX_BLOCKS rows; where so many keys would share them that it would let more than
USELESS of the missing ones through, it is left out and all references are joined. The result is the same. Keys with
many references (one model may have a third of them) are cut into shards in that join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessitura.functions.ids import bare, seg_id
from tessitura.operators.skew import hot_keys, split_join

#: Upper bound of broadcast filter blocks (32 bytes each plus the row).
MAX_BLOCKS = 1 << 20
#: Expected share of missing keys let through from which the filter is left out.
USELESS = 0.5
#: 64-bit words of a block, in each of which a key sets one bit, and keys that a block is sized for.
WORDS, KEYS_PER_BLOCK = 4, 20


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("long")


def _masks(key: Column) -> list[Column]:
    """The key's bit in each word."""
    h, one = F.xxhash64(F.lit("bloom"), key), F.lit(1).cast("long")
    return [F.call_function("shiftleft", one, F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(WORDS)]


def bloom_blocks(parents: DataFrame, key: str, n_keys: int) -> tuple[DataFrame, int]:
    """Filter table (block, words) over ``key`` and its number of blocks."""
    blocks = min(MAX_BLOCKS, 1 << max(6, (n_keys // KEYS_PER_BLOCK).bit_length()))
    k = F.col(key)
    words = [F.bit_or(m).alias(f"_w{i}") for i, m in enumerate(_masks(k))]
    return parents.groupBy(_block(k, blocks).alias("_block")).agg(*words), blocks


def passes(n_keys: int, blocks: int) -> float:
    """Expected share of keys that are not among ``n_keys`` and yet pass a filter of so many blocks."""
    return (1 - (1 - 1 / 64) ** (n_keys / blocks)) ** WORDS


def orphans(refs: DataFrame, parents: DataFrame, row: list[str] | None = None) -> DataFrame:
    """Rows of ``refs`` (key, at, ...) without a parent alive at ``at``, with ``cause``; ``row`` names their identity (default: all columns).

    ``parents`` (key, created_at, deleted_at): alive at t if created_at <= t and deleted_at is null or > t.
    Cause 'missing': no parent row; 'late': all created after t; else 'deleted'. Null keys refer to nothing
    and are left out. A null ``at`` compares with nothing: such a reference is an orphan, 'missing' without
    parent row, else 'deleted'. A parent row whose created_at is null is never alive.
    """
    row = row or refs.columns
    parents = parents.where(F.col("key").isNotNull()).select("key", F.col("created_at").alias("_created"), F.col("deleted_at").alias("_deleted"))
    n_refs = refs.count()  # rows without a key included: it only sets what is hot
    refs = refs.where(F.col("key").isNotNull())
    n_keys = parents.agg(F.approx_count_distinct("key")).first()[0]
    table, blocks = bloom_blocks(parents, "key", n_keys)
    maybe, definite = refs, None
    if passes(n_keys, blocks) <= USELESS:
        hit = reduce(Column.__and__, [F.col(f"_w{i}").bitwiseAND(m) != 0 for i, m in enumerate(_masks(F.col("key")))])
        tested = (
            refs.withColumn("_block", _block(F.col("key"), blocks))
            .join(F.broadcast(table), "_block", "left")  # at most MAX_BLOCKS rows
            .withColumn("_maybe", F.coalesce(hit, F.lit(False)))
            .drop("_block", *[f"_w{i}" for i in range(WORDS)])
        )
        definite = tested.where(~F.col("_maybe")).drop("_maybe").withColumn("cause", F.lit("missing"))
        maybe = tested.where("_maybe").drop("_maybe")
    hot = hot_keys(refs, "key", n_refs)
    alive = (F.col("_created") <= F.col("at")) & (F.col("_deleted").isNull() | (F.col("_deleted") > F.col("at")))
    dead = split_join(maybe, parents, "key", hot, row, "left_anti", alive)
    first = parents.groupBy("key").agg(F.min("_created").alias("_first"), F.lit(True).alias("_known"))
    late = F.col("_first") > F.col("at")
    cause = F.when(F.col("_known").isNull(), "missing").when(late, "late").otherwise("deleted")
    verified = split_join(dead, first, "key", hot, row).withColumn("cause", cause).drop("_first", "_known")
    return verified if definite is None else definite.unionByName(verified)


def trial_references(scores: DataFrame, trial_key: DataFrame, field: str) -> DataFrame:
    """(tbl, row_id, field, key, at) of one reference column of both tables."""
    key = seg_id("segset") if field == "segset" else F.when(bare("modelset").isNotNull(), F.col("modelset"))

    def of(df: DataFrame, tbl: str, row_id: str, at: str) -> DataFrame:
        return df.select(F.lit(tbl).alias("tbl"), F.col(row_id).alias("row_id"), F.lit(field).alias("field"), key.alias("key"), F.col(at).alias("at"))

    return of(scores, "scores", "score_id", "scored_at").unionByName(of(trial_key, "trial_key", "key_id", "keyed_at"))


def orphan_references(scores: DataFrame, trial_key: DataFrame, models: DataFrame, segments: DataFrame) -> DataFrame:
    """(tbl, row_id, field, cause, key, at) of every reference to a model or segment that did not exist then."""
    row = ["tbl", "row_id"]
    by_model = orphans(trial_references(scores, trial_key, "modelset"), models.select(F.col("model_id").alias("key"), "created_at", "deleted_at"), row)
    by_seg = orphans(trial_references(scores, trial_key, "segset"), segments.select(F.col("seg_id").alias("key"), "created_at", "deleted_at"), row)
    return by_model.unionByName(by_seg)


def orphan_report(scores: DataFrame, trial_key: DataFrame, models: DataFrame, segments: DataFrame) -> DataFrame:
    """Counts of orphan references per table, field, cause and month of the reference."""
    found = orphan_references(scores, trial_key, models, segments)
    return found.groupBy("tbl", "field", "cause", F.date_format("at", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n_orphans"))
