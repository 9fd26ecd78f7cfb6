"""Mixing sources to target weights.

Documents of a source are dealt into blocks by hash, so many that an output shard gets the same number of every
source's blocks whatever the size of the data. Running token sums over the permuted blocks fix which uses of them meet
each source's quota. A splitting tree of multivariate hypergeometric draws partitions these exact block quotas among
output shards; its upper part is drawn on the driver, its subtrees on the executors. Each shard then takes the next disjoint
blocks of every source's random permutation, by a join on their positions, and documents are shuffled inside
their shard only. The driver sees numbers by source and at most TOP nodes of the tree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessitura.llm.tokens import with_token_counts
from tessitura.operators.prefix import running
from tessitura.workspace import Workspace

#: Blocks of every source in an output shard; tokens of a shard aimed at; fewest shards.
PER_SHARD, SHARD_TOKENS, MIN_SHARDS = 64, 16_000_000, 8
#: Nodes of the splitting tree that the driver draws.
TOP = 256
#: Uses from which a node is divided in proportion: its draw would differ by a few parts in 100,000.
EXACT = 10**9


@dataclass(frozen=True)
class Quota:
    source: str
    target: float
    wanted: float
    available: int
    repeats: int


def quotas(have: dict[str, int], targets: list[tuple[str, float, int]], total: float | None = None) -> list[Quota]:
    """Tokens wanted of every source with tokens and a positive target, repeats observed.

    Without ``total`` the mixture is the largest in which every source meets its share. With one, sources
    that would need more than their repeats allow give all they may and the others share the rest.
    """
    rows = [(s, w, max(0, r)) for s, w, r in targets if have.get(s, 0) > 0 and w > 0 and r > 0]
    weight = sum(w for _, w, _ in rows)
    most = {s: r * have[s] for s, _, r in rows}
    if not rows:
        return []
    if total is None:
        total = min(most[s] * weight / w for s, w, _ in rows)
    want, open_, left = {}, list(rows), float(total)
    while open_:
        w_open = sum(w for _, w, _ in open_)
        full = [(s, w, r) for s, w, r in open_ if most[s] < left * w / w_open * (1 - 1e-12)]
        if not full:
            want |= {s: left * w / w_open for s, w, _ in open_}
            break
        for s, _, _ in full:
            want[s] = float(most[s])
            left -= most[s]
        open_ = [x for x in open_ if x not in full]
    return [Quota(s, w / weight, want[s], have[s], r) for s, w, r in rows]


def _draw(counts: np.ndarray, shards: int, seed: int, path: int) -> np.ndarray:
    """Uses of every source that a node's left half gets, drawn without replacement."""
    left = shards // 2
    draw = int(counts.sum()) * left // shards
    if counts.sum() < EXACT:
        return np.random.default_rng([seed, path]).multivariate_hypergeometric(counts, draw, method="marginals")
    part = counts * left // shards
    part[np.argsort(-(counts * left % shards), kind="stable")[: draw - int(part.sum())]] += 1
    return part


def split_tree(counts: np.ndarray, shards: int, seed: int, path: int = 1) -> list[np.ndarray]:
    """Uses of every source by shard. Each node draws its left half's uses without replacement."""
    if shards == 1:
        return [counts]
    part = _draw(counts, shards, seed, path)
    return split_tree(part, shards // 2, seed, 2 * path) + split_tree(counts - part, shards - shards // 2, seed, 2 * path + 1)


def subtrees(counts: np.ndarray, shards: int, seed: int, limit: int, path: int = 1) -> list[tuple[int, int, np.ndarray]]:
    """(path, shards, counts) of at most ``limit`` nodes, in the order of their shards, that split_tree goes on from."""
    if limit < 2 or shards == 1:
        return [(path, shards, counts)]
    part = _draw(counts, shards, seed, path)
    return subtrees(part, shards // 2, seed, limit // 2, 2 * path) + subtrees(counts - part, shards - shards // 2, seed, limit - limit // 2, 2 * path + 1)


class Mixture:
    """``rows``: (shard, position, source, doc_id, repeat, n_tokens); ``report``: actual shares by source.

    ``documents``: (doc_id, source, text); ``targets``: (source, target_share, max_repeats), one row per source
    (of several the largest share holds). Shares are relative to those of the sources that have tokens;
    documents without tokens, and sources that are null or have no target, are not drawn. A null max_repeats is 1.
    """

    def __init__(self, documents: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = 11, path: str | None = None):
        spark = documents.sparkSession
        ws = Workspace(spark, "mixing")
        wanted = targets.where("source is not null and target_share > 0").groupBy("source").agg(F.max(F.struct("target_share", F.coalesce("max_repeats", F.lit(1)).alias("r"))).alias("t"))
        rules = [(r.source, float(r.t.target_share), int(r.t.r)) for r in wanted.orderBy("source").collect()]
        chosen = documents.where(F.col("source").isin([s for s, _, _ in rules]))
        sizes = ws.write(with_token_counts(chosen, ["doc_id", "source"], path=path).where("n_tokens > 0"), "sizes")
        have = {r.source: r.n for r in sizes.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}  # targets
        self.quotas = quotas(have, rules, total_tokens)
        self.shards = max(MIN_SHARDS, math.ceil(sum(q.wanted for q in self.quotas) / SHARD_TOKENS))
        plan = []
        for i, q in enumerate(self.quotas):
            passes = min(q.repeats, int(q.wanted // q.available))
            blocks = max(1, math.ceil(PER_SHARD * self.shards * q.available / max(1.0, q.wanted)))
            plan.append((q.source, i, blocks, passes, q.wanted - passes * q.available if passes < q.repeats else 0.0))
        rules_ = F.broadcast(spark.createDataFrame(plan, "source string, nr int, blocks long, passes int, rest double"))  # targets
        block = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col("blocks"))
        sized = sizes.join(rules_, "source").select("doc_id", "source", "nr", "n_tokens", "passes", "rest", block.alias("block"))
        sums = ws.write(sized.groupBy("nr", "block", "passes", "rest").agg(F.sum("n_tokens").alias("n")), "blocks")
        full = sums.where("passes > 0").select("nr", "block", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)).alias("repeat"))
        # a last pass over a permuted prefix of blocks: those of which the nearer half is within the quota
        prefix = running(sums.where("rest > 0"), [F.xxhash64(F.lit(seed), F.lit("pass"), "block"), "block"], {"upto": "n"}, ["nr"])
        part = prefix.where(F.col("upto") - F.col("n") / 2 <= F.col("rest")).select("nr", "block", F.col("passes").alias("repeat"))
        order = [F.xxhash64(F.lit(seed), F.lit("deal"), "block", "repeat"), "block", "repeat"]
        uses = ws.write(running(full.unionByName(part).withColumn("one", F.lit(1)), order, {"nth": "one"}, ["nr"]).select("nr", "block", "repeat", "nth"), "uses")
        counts = np.zeros(max(1, len(plan)), dtype=np.int64)
        for r in uses.groupBy("nr").count().collect():
            counts[r.nr] = r["count"]
        dealt = ws.write(uses.join(self._leaves(spark, counts, seed), ["nr", "nth"]).select("nr", "block", "repeat", "shard"), "dealt")
        drawn = sized.join(dealt, ["nr", "block"])  # broadcast or shuffled, as the written size suggests
        local = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "shard", "doc_id", "repeat"), "doc_id", "repeat")
        self.rows = drawn.withColumn("position", F.row_number().over(local)).select("shard", "position", "source", "doc_id", "repeat", "n_tokens")
        self.targets = spark.createDataFrame([(q.source, q.target, q.wanted, q.available, q.repeats) for q in self.quotas], "source string, target_share double, wanted_tokens double, available_tokens long, max_repeats int")
        self.drawn = drawn

    def _leaves(self, spark: SparkSession, counts: np.ndarray, seed: int) -> DataFrame:
        """(nr, nth, shard): the shard of every position of every source's permutation."""
        nodes, shard, begin = [], 0, np.zeros_like(counts)
        for path, n, c in subtrees(counts, self.shards, seed, TOP):
            nodes.append((path, shard, n, c.tolist(), begin.tolist()))
            shard, begin = shard + n, begin + c

        def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for path, first, n, c, at in zip(*(b[x].to_pylist() for x in ("path", "shard", "shards", "counts", "begin"))):
                    leaves = np.array(split_tree(np.array(c, dtype=np.int64), n, seed, path))
                    stop = np.array(at) + np.cumsum(leaves, axis=0)
                    k = leaves.shape[1]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.tile(np.arange(k, dtype=np.int32), n)), pa.array(np.repeat(first + np.arange(n, dtype=np.int32), k)), pa.array((stop - leaves).ravel() + 1), pa.array(stop.ravel())], ["nr", "shard", "lo", "hi"]
                    )

        tree = spark.createDataFrame(nodes, "path long, shard int, shards int, counts array<long>, begin array<long>").repartition(min(len(nodes), 64), "path")
        return tree.mapInArrow(grow, "nr int, shard int, lo long, hi long").where("hi >= lo").select("nr", F.explode(F.sequence("lo", "hi")).alias("nth"), "shard")

    def report(self) -> DataFrame:
        """Per source: target and actual share of tokens, tokens and documents drawn, most uses of a document."""
        used = self.drawn.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("uses"), F.sum("n_tokens").alias("n"))
        by = used.groupBy("source").agg(F.sum("n").alias("n_tokens"), F.count(F.lit(1)).alias("n_documents"), F.max("uses").alias("most_uses"))
        rows = self.targets.join(by, "source", "left")
        share = F.col("n_tokens") / F.sum("n_tokens").over(Window.partitionBy(F.lit(1)))  # one row per target
        return rows.withColumn("actual_share", share)


def mixture_check(drawn: DataFrame, targets: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """One row: documents used more often than their source allows, uses drawn twice, and sources whose share of the drawn
    tokens is off its target (among the sources drawn) by more than ``tolerance``."""
    named = targets.where("source is not null and target_share > 0").groupBy("source").agg(F.max(F.struct("target_share", F.coalesce("max_repeats", F.lit(1)).alias("r"))).alias("t"))
    per = drawn.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("uses"), F.count_distinct("repeat").alias("repeats"), F.sum("n_tokens").alias("n"))
    by = per.join(F.broadcast(named.select("source", F.col("t.r").alias("r"), F.col("t.target_share").alias("w"))), "source", "left")  # targets
    by = by.groupBy("source").agg(F.sum("n").alias("n"), F.max("w").alias("w"), F.count_if(F.coalesce(F.col("uses") > F.col("r"), F.lit(True))).alias("over"), F.count_if(F.col("uses") != F.col("repeats")).alias("twice"))
    every = Window.partitionBy(F.lit(1))  # one row a source
    off = F.abs(F.col("n") / F.sum("n").over(every) - F.col("w") / F.sum("w").over(every)) > tolerance
    out = by.withColumn("off", off).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("over", "over_repeats"), ("twice", "drawn_twice"))], F.count_if("off").alias("shares_off"))
    return out.select(*[F.col(c).cast("long").alias(c) for c in out.columns])
