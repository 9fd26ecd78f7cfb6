"""Filling fixed-capacity containers with items: variable-capacity best fit.

A container of capacity C may be cut to any of its permitted lengths (C, C/2, C/4, C/8). Items are placed by
falling size into the open bin they fill best. Where none has room a bin is opened at the length of least cost
for each token it is expected to hold, judged against the items still to come; a bin costs BIN_COST of the
capacity besides its unused room. In the end every bin is cut to the shortest permitted length that holds its
contents. Items longer than C are cut into full bins and a rest; nothing else is ever cut. Items are packed in
shards of bounded size by a hash of their id, each losing at most its own last bins.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.llm.tokens import with_token_counts
from tessitura.workspace import Workspace, spread

#: Items of a shard, on average.
SHARD_ITEMS = 32_000
#: Cost of a bin in parts of the capacity, besides what stays unused.
BIN_COST = 0.1
#: Permitted lengths as parts of the capacity.
PARTS = (1, 2, 4, 8)


def permitted(capacity: int, parts: tuple[int, ...] = PARTS) -> list[int]:
    """Ascending permitted lengths of a capacity; parts that do not divide it are rounded up."""
    return sorted({-(-capacity // p) for p in parts})


def best_fit(sizes: list[int], lengths: list[int]) -> tuple[list[int], list[int]]:
    """Bin of every item and length of every bin. All sizes must fit the longest length."""
    lengths, order = sorted(lengths), sorted(range(len(sizes)), key=lambda i: -sizes[i])
    left: dict[int, int] = {}
    present = 0  # bit s: an item of size s is still to come
    for s in sizes:
        left[s] = left.get(s, 0) + 1
        present |= 1 << s
    rooms: dict[int, list[int]] = {}
    roomy = 0  # bit r: an open bin has room r
    fixed = BIN_COST * lengths[-1]
    bins, length, used = [0] * len(sizes), [], []

    def unused(gap: int) -> int:
        """Room that stays empty if the largest items to come are filled in."""
        below = gap
        while gap > 0:
            fit = present & ((2 << min(gap, below)) - 1) & ~1
            if not fit:
                break
            s = fit.bit_length() - 1
            gap -= min(left[s], gap // s) * s
            below = s - 1
        return gap

    for i in order:
        s = sizes[i]
        left[s] -= 1
        if not left[s]:
            present &= ~(1 << s)
        fit = roomy >> s
        if fit:
            r = s + (fit & -fit).bit_length() - 1
            b = rooms[r].pop()
            if not rooms[r]:
                roomy &= ~(1 << r)
        else:
            at, least = lengths[-1], float("inf")
            for x in reversed(lengths):
                if x < s:
                    break
                empty = unused(x - s)
                if (cost := (empty + fixed) / max(1, x - empty)) < least:
                    at, least = x, cost
            b, r = len(length), at
            length.append(at)
            used.append(0)
        bins[i] = b
        used[b] += s
        rooms.setdefault(r - s, []).append(b)
        roomy |= 1 << (r - s)
    return bins, [min(x for x in lengths if x >= u) for u in used]


def pack(sizes: DataFrame, containers: DataFrame, ws: Workspace) -> DataFrame:
    """(container, doc_id, piece, start_token, n_tokens, bin, bin_length) for every document and container.

    ``sizes``: (doc_id, n_tokens) written to ``ws``; ``containers``: (container, capacity_tokens), every row
    a task of its own (a small table by its meaning). Pieces of a document are numbered from 0; a document is
    cut only if it is longer than the capacity. Documents of 0 tokens take no room but get a bin. Containers
    with a null or non-positive capacity are left out.
    """
    shards = max(1, -(-sizes.count() // SHARD_ITEMS))
    whole = F.when(F.col("n_tokens") > F.col("capacity"), F.floor(F.col("n_tokens") / F.col("capacity"))).otherwise(F.lit(0)).cast("long")
    rows = containers.where("capacity_tokens > 0").select("container", "capacity_tokens").collect()
    tasks = F.explode(F.array(*[F.struct(F.lit(r.container).alias("container"), F.lit(r.capacity_tokens).cast("long").alias("capacity")) for r in rows]))
    if not rows:
        return sizes.sparkSession.createDataFrame([], "container string, doc_id long, piece int, start_token long, n_tokens long, bin string, bin_length long")
    items = sizes.withColumn("t", tasks).select("doc_id", "n_tokens", "t.*").withColumn("whole", whole)
    full = items.where("whole > 0").select(
        "container", "doc_id", F.explode(F.sequence(F.lit(0), F.col("whole").cast("int") - 1)).alias("piece"), "capacity"
    )
    full = full.select(
        "container", "doc_id", "piece", (F.col("piece") * F.col("capacity")).alias("start_token"), F.col("capacity").alias("n_tokens"),
        F.concat_ws(":", F.lit("full"), F.col("doc_id"), F.col("piece")).alias("bin"), F.col("capacity").alias("bin_length"),
    )
    rest = items.withColumn("size", F.col("n_tokens") - F.col("whole") * F.col("capacity")).where("size > 0 or n_tokens = 0")
    rest = rest.select("container", "capacity", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard"), "doc_id", F.col("whole").cast("int").alias("piece"), "size")

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("size", "descending"), ("doc_id", "ascending")])
        capacity, sizes = t["capacity"][0].as_py(), t["size"].to_pylist()
        bins, lengths = best_fit(sizes, permitted(capacity))
        shard = t["shard"][0].as_py()
        return pa.table(
            {
                "container": t["container"], "doc_id": t["doc_id"], "piece": t["piece"],
                "start_token": pa.array([p * capacity for p in t["piece"].to_pylist()], pa.int64()), "n_tokens": t["size"],
                "bin": pa.array([f"{shard}:{b}" for b in bins]), "bin_length": pa.array([lengths[b] for b in bins], pa.int64()),
            }
        )

    schema = "container string, doc_id long, piece int, start_token long, n_tokens long, bin string, bin_length long"
    return full.unionByName(spread(rest, len(rows) * shards, "container", "shard").groupBy("container", "shard").applyInArrow(run, schema))


def pack_documents(documents: DataFrame, containers: DataFrame, path: str | None = None) -> DataFrame:
    """Packing of ``documents.text`` in tokens of the tokenizer at ``path``; texts are tokenized once."""
    ws = Workspace(documents.sparkSession, "packing")
    return pack(ws.write(with_token_counts(documents, ["doc_id"], path=path), "sizes"), containers, ws)


def pack_report(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """Per container: documents, pieces, bins, tokens, and the used share of full capacity and of bin lengths."""
    bins = packed.groupBy("container", "bin").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("pieces"), F.max("bin_length").alias("length"))
    out = bins.groupBy("container").agg(F.count(F.lit(1)).alias("n_bins"), F.sum("pieces").alias("n_pieces"), F.sum("n").alias("n_tokens"), F.sum("length").alias("length"))
    return out.join(containers.select("container", "capacity_tokens"), "container").select(
        "container", "capacity_tokens", "n_bins", "n_pieces", "n_tokens",
        (F.col("n_tokens") / (F.col("n_bins") * F.col("capacity_tokens"))).alias("used_of_capacity"), (F.col("n_tokens") / F.col("length")).alias("used_of_length"),
    )


def pack_check(documents: DataFrame, packed: DataFrame, containers: DataFrame, path: str | None = None) -> DataFrame:
    """One row: bins that hold more than their length or are longer than the capacity, documents cut though they would
    fit, and documents whose pieces are not their tokens, each counted by container."""
    caps = F.broadcast(containers.where("capacity_tokens > 0").select("container", "capacity_tokens"))  # tasks
    bins = packed.groupBy("container", "bin").agg(F.sum("n_tokens").alias("n"), F.min("bin_length").alias("length")).join(caps, "container")
    overfull = bins.agg(F.count_if((F.col("n") > F.col("length")) | (F.col("length") > F.col("capacity_tokens"))).alias("overfull"))
    want = with_token_counts(documents, ["doc_id"], path=path).crossJoin(caps)  # every row of the small table is a task
    got = packed.groupBy("container", "doc_id").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("pieces"))
    both = want.join(got, ["container", "doc_id"], "full")
    cut = (F.col("pieces") > 1) & (F.col("n_tokens") <= F.col("capacity_tokens"))
    covered = both.agg(F.count_if(cut).alias("cut_needlessly"), F.count_if(~F.col("n").eqNullSafe(F.col("n_tokens"))).alias("not_covered"))
    return overfull.crossJoin(covered)  # one row each
