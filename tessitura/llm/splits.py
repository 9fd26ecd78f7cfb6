"""Splits that keep related records together: grouped iterative stratification over connected components.

Records sharing a left id or a segment, directly or through others, form a component. Components come from
alternating large-star and small-star steps on the cluster; every step is a group minimum (combined before
the shuffle) and an equi-join in which a hub's links are cut into shards, so a hub with a third of all links is neither
collected nor met by one task. Placement sees a bounded number of units: components above a fixed share of all rows by
themselves, all others bundled by their rarest label and a hash. One rule places all of them; where large components
leave the splits off their share of rows, whole units then move between splits, those first whose labels suffer least.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessitura.functions.ids import is_named, seg_id
from tessitura.operators.skew import hot_keys, split_join
from tessitura.workspace import Workspace

#: A component with more than 1 / LARGE of all rows is placed by itself.
LARGE = 2000
#: A label's other components are dealt to this many bundles for all rows, by its share of them, and to FEWEST at least.
BUNDLES, FEWEST = 8192, 32
#: Labels with less than 1 / RARE of all rows are stratified in POOLS by the hash of their name, so that the driver
#: knows at most RARE labels; every other label counts for itself.
RARE, POOLS = 20_000, 64
#: Shares of rows are repaired to this part of all rows.
TOLERANCE = 0.0002
#: Weight of the splits' rows beside that of all labels together.
ROWS = 4.0


def _changed(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % (1 << 40))).first())


def connected(edges: DataFrame, ws: Workspace, name: str = "cc") -> DataFrame:
    """(node, root) of every node of ``edges`` (u, v), root being the smallest node of its component.

    Self-loops are kept as single nodes only if nothing else names the node. Works on any orderable type.
    """
    loops = edges.where("u = v").select(F.col("u").alias("node"))
    now = ws.write(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}0")
    seen, step = _changed(now), 0
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: every larger neighbour points to the smallest node around
        larger = now.select(F.col("v").alias("u"), F.col("u").alias("v"))
        large = split_join(larger, least, "u", hot_keys(larger, "u", seen[0]), ["v"], "inner")
        large = ws.write(large.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"{name}{step + 1}a")
        # small star: the node and its smaller neighbours point to the smallest of them
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = split_join(large, down, "u", hot_keys(large, "u", seen[0]), ["v"], "inner")
        small = small.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = ws.write(small.unionByName(down.select("u", F.col("m").alias("v"))).distinct(), f"{name}{step + 1}")
        ws.drop(f"{name}{step}")
        ws.drop(f"{name}{step + 1}a")
        now, was, seen, step = after, seen, _changed(after), step + 1
        if seen == was:
            break
    members = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    heads = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    alone = loops.distinct().join(members.unionByName(heads).select("node"), "node", "left_anti").select("node", F.col("node").alias("root"))
    return members.unionByName(heads).unionByName(alone)


def _ids() -> list[Column]:
    return [F.when(is_named("leftids"), F.col("leftids")).alias("leftid"), seg_id("rightids").alias("seg_id")]


def tied_left_ids(idmap: DataFrame, ws: Workspace | None = None) -> DataFrame:
    """(leftid, group_leftid) of every named left id; groups are closed under shared segments.

    ``group_leftid`` is the smallest of the group in code-point order. A segment links each of its left ids
    to the smallest one, so links grow with listed pairs, never with their square.
    """
    ws = ws or Workspace(idmap.sparkSession, "splits")
    pairs = ws.write(idmap.select(*_ids()).where("leftid is not null").distinct(), "pairs")
    first = pairs.where("seg_id is not null").groupBy("seg_id").agg(F.min("leftid").alias("v"))
    joined = split_join(pairs, first, "seg_id", hot_keys(pairs, "seg_id", pairs.count()), ["leftid"])
    links = joined.select(F.col("leftid").alias("u"), F.coalesce("v", "leftid").alias("v")).distinct()
    return connected(links, ws).select(F.col("node").alias("leftid"), F.col("root").alias("group_leftid"))


def tied_groups(idmap: DataFrame) -> DataFrame:
    """(group_leftid, leftid) of every left id that is not the smallest of its group."""
    return tied_left_ids(idmap).where(F.col("leftid") != F.col("group_leftid")).select("group_leftid", "leftid")


class Placement:
    """Splits of units by iterative stratification.

    ``unit``, ``label``, ``n``: cells of the units' label vectors; ``shares``: positive targets. ``out`` is the split of
    every unit, ``rows`` and ``have`` the splits' rows, in all and by label.
    """

    def __init__(self, unit: np.ndarray, label: np.ndarray, n: np.ndarray, shares: np.ndarray):
        order = np.lexsort((label, unit))
        unit, self.label, self.n = (np.asarray(x)[order] for x in (unit, label, n))
        self.n = self.n.astype(np.float64)
        self.units = int(unit.max()) + 1 if len(unit) else 0
        self.at = np.searchsorted(unit, np.arange(self.units + 1))
        self.size = np.bincount(unit, weights=self.n, minlength=self.units)
        labels = int(self.label.max()) + 1 if len(unit) else 0
        self.total = np.bincount(self.label, weights=self.n, minlength=labels)
        self.shares = np.asarray(shares, dtype=np.float64) / np.sum(shares)
        self.want_rows, self.want = self.shares * self.size.sum(), np.outer(self.shares, self.total)
        self.rows, self.have = np.zeros(len(self.shares)), np.zeros_like(self.want)
        self.out = np.full(self.units, -1)
        self._stratify()
        self._repair()

    def _cells(self, u: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.at[u], self.at[u + 1])
        return self.label[part], self.n[part]

    def _misfit(self, u: int) -> np.ndarray:
        """Change, by split, of the labels' squared distance from their targets if the unit came to it."""
        k, c = self._cells(u)
        return ((2 * (self.have[:, k] - self.want[:, k]) + c) * c / self.want[:, k]).sum(1) / len(self.total)

    def _move(self, u: int, s: int, sign: float = 1.0) -> None:
        k, c = self._cells(u)
        self.have[s, k] += sign * c
        self.rows[s] += sign * self.size[u]

    def _stratify(self) -> None:
        """Takes the label with the fewest outstanding rows and its largest unit, which goes to the split that it brings
        nearest to its targets of labels and rows: while units are small, that in greatest need of them."""
        queues: dict[int, list[int]] = {}
        for u in np.lexsort((np.arange(self.units), self.size)):  # the largest last
            for k in self._cells(u)[0]:
                queues.setdefault(int(k), []).append(int(u))
        left = self.total.copy()
        heap = [(left[k], k) for k in queues]
        heapq.heapify(heap)
        while heap:
            known, k = heapq.heappop(heap)
            q = queues[k]
            while q and self.out[q[-1]] >= 0:
                q.pop()
            if not q:
                continue
            if known != left[k]:  # others took rows of it meanwhile
                heapq.heappush(heap, (left[k], k))
                continue
            u = q.pop()
            x = self.size[u]
            rows = (2 * (self.rows - self.want_rows) * x + x**2) / self.want_rows
            s = int(np.argmin(self._misfit(u) + ROWS * rows))
            self.out[u] = s
            self._move(u, s)
            c = self._cells(u)
            left[c[0]] -= c[1]
            heapq.heappush(heap, (left[k], k))
        self.out[self.out < 0] = int(np.argmax(self.shares))

    def _harm(self, a: int, b: int) -> np.ndarray:
        """Change of the labels' misfit by every unit if it went from split ``a`` to ``b``."""
        k, c, d = self.label, self.n, self.have - self.want
        change = (c - 2 * d[a, k]) * c / self.want[a, k] + (c + 2 * d[b, k]) * c / self.want[b, k]
        return np.add.reduceat(change, self.at[:-1])

    def _repair(self) -> None:
        """While rows are off and a move lessens it: the unit (or exchange of two) with the least damage to labels for
        what it mends goes from the fullest split to the emptiest."""
        close = max(1.0, TOLERANCE * self.size.sum())
        for _ in range(4 * self.units):
            off = self.rows - self.want_rows
            a, b = int(np.argmax(off)), int(np.argmin(off))
            gap = off[a] - off[b]
            if max(off[a], -off[b]) <= close:
                return
            mine = np.flatnonzero((self.out == a) & (self.size > 0))
            fit = mine[self.size[mine] < gap]
            best: tuple[float, int, int] | None = None
            if len(fit):
                mends, harm = gap**2 - (gap - 2 * self.size[fit]) ** 2, self._harm(a, b)[fit]
                worth = np.where(harm > 0, harm / mends, harm * mends)
                best = (0.0, int(fit[int(np.argmin(worth))]), -1)
            else:
                theirs = np.flatnonzero(self.out == b)
                theirs = theirs[np.argsort(self.size[theirs], kind="stable")]
                at = np.searchsorted(self.size[theirs], self.size[mine] - gap / 2)
                for u, i in zip(mine, at):
                    for j in (i - 1, i):
                        if 0 <= j < len(theirs) and 0 < (d := self.size[u] - self.size[theirs[j]]) < gap and (best is None or abs(d - gap / 2) < best[0]):
                            best = (abs(d - gap / 2), int(u), int(theirs[j]))
            if best is None:
                return
            for u, s, t in ((best[1], a, b), (best[2], b, a)):
                if u >= 0:
                    self._move(u, s, -1.0)
                    self._move(u, t)
                    self.out[u] = t


def stratify(counts: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Split of every unit; ``counts``: rows by (unit, label). Units without rows go to the largest split."""
    counts = np.asarray(counts)
    unit, label = np.nonzero(counts)
    out, filled = np.full(len(counts), int(np.argmax(shares))), np.unique(unit)
    out[filled] = Placement(np.searchsorted(filled, unit), label, counts[unit, label], shares).out
    return out


class GroupedSplits:
    """Split of every row of ``idmap`` such that rows sharing a left id or a segment stay together.

    Rows without a left id follow their segment, rows without a segment their left id, rows with neither are
    alone. A null ``list_name`` is a label of its own. Targets that are null or not positive get nothing;
    shares are taken relative to their sum. An empty ``idmap`` gives empty results.
    """

    def __init__(self, idmap: DataFrame, targets: DataFrame):
        spark = idmap.sparkSession
        self.ws = ws = Workspace(spark, "splits")
        lefts = ws.write(tied_left_ids(idmap, ws), "lefts")
        pairs = idmap.select(*_ids()).distinct()
        self.total = idmap.count()
        rows = idmap.select("pos", F.coalesce("list_name", F.lit("")).alias("label"), *_ids())
        hot = hot_keys(rows, "leftid", self.total)
        named = split_join(pairs.where("leftid is not null and seg_id is not null"), lefts, "leftid", hot, ["seg_id"], "inner")
        of_seg = named.groupBy("seg_id").agg(F.min("group_leftid").alias("by_seg"))
        group = F.coalesce("group_leftid", "by_seg", F.concat(F.lit("segment:"), "seg_id"), F.concat(F.lit("row:"), F.col("pos").cast("string")))
        placed = split_join(split_join(rows, lefts, "leftid", hot, ["pos"]), of_seg, "seg_id", hot_keys(rows, "seg_id", self.total), ["pos"])
        self.rows = ws.write(placed.select("pos", "label", group.alias("group")), "rows")
        self.targets = [(r.split_name, float(r.target_share)) for r in targets.where("split_name is not null and target_share > 0").orderBy("split_name").collect()]
        self.units = self._place()

    def _place(self) -> DataFrame:
        """(group, split_name, size, large) of every component."""
        ws, spark = self.ws, self.rows.sparkSession
        counts = self.rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
        common = counts.where(F.col("n") * RARE >= F.lit(self.total)).orderBy(F.desc("n"), "label").collect()  # at most RARE labels
        labels = [(r.label, k, max(FEWEST, BUNDLES * r.n // max(1, self.total))) for k, r in enumerate(common)]
        known = F.broadcast(spark.createDataFrame(labels, "label string, k int, bundles int"))
        pool = F.lit(len(common)) + F.pmod(F.xxhash64("label"), F.lit(POOLS)).cast("int")
        cells = self.rows.groupBy("group", "label").agg(F.count(F.lit(1)).alias("n")).join(known, "label", "left")
        cells = cells.select("group", F.coalesce("k", pool).alias("k"), F.coalesce("bundles", F.lit(FEWEST)).alias("bundles"), "n")
        rarest = F.max(F.struct("k", "bundles"))
        sizes = cells.groupBy("group").agg(F.sum("n").alias("size"), rarest.alias("rarest"))
        large = F.col("size") * LARGE > F.lit(self.total)
        bundle = F.concat_ws(":", F.lit("bundle"), F.col("rarest.k").cast("string"), F.pmod(F.xxhash64("group"), F.col("rarest.bundles")).cast("string"))
        sizes = ws.write(sizes.select("group", "size", large.alias("large"), F.when(large, F.concat(F.lit("group:"), "group")).otherwise(bundle).alias("unit")), "sizes")
        # at most LARGE large components, BUNDLES + FEWEST * (labels + POOLS) bundles, and their labels
        vectors = cells.join(sizes.select("group", "unit"), "group").groupBy("unit", "k").agg(F.sum("n").alias("n")).toPandas()
        names, unit = np.unique(vectors["unit"].to_numpy(dtype=object), return_inverse=True)
        split = Placement(unit, vectors["k"].to_numpy(), vectors["n"].to_numpy(), np.array([s for _, s in self.targets])).out if len(names) and self.targets else []
        chosen = spark.createDataFrame(pa.table({"unit": pa.array(names[: len(split)], pa.string()), "split_name": pa.array([self.targets[s][0] for s in split], pa.string())}))
        return ws.write(sizes.join(F.broadcast(chosen), "unit").select("group", "split_name", "size", "large"), "units")

    def assignment(self) -> DataFrame:
        """(pos, split_name) of every row."""
        hot = self.units.where("large").select(F.col("group").alias("_hot_key"), F.ceil(F.col("size") * LARGE / F.lit(max(1, self.total))).cast("int").alias("_hot_cut"))
        return split_join(self.rows, self.units.select("group", "split_name"), "group", hot, ["pos"]).select("pos", "split_name")

    def _targets(self) -> DataFrame:
        total = sum(s for _, s in self.targets)
        return self.rows.sparkSession.createDataFrame([(n, s / total) for n, s in self.targets], "split_name string, target_share double")

    def report(self) -> DataFrame:
        """Per split: target and actual share of rows, rows and components."""
        have = self.units.groupBy("split_name").agg(F.sum("size").alias("n_rows"), F.count(F.lit(1)).alias("n_groups"))
        return self._targets().join(have, "split_name", "left").select(
            "split_name", "target_share", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("n_groups", F.lit(0)).alias("n_groups"),
            F.try_divide(F.coalesce("n_rows", F.lit(0)), F.lit(self.total)).alias("actual_share"),
        )

    def label_report(self) -> DataFrame:
        """Per label and split: rows, share of the label's rows, and the same for rows of small components only, which
        are those that could be spread as the targets say."""
        small = F.when(~F.col("large"), F.col("n"))
        cells = self.rows.groupBy("group", "label").agg(F.count(F.lit(1)).alias("n"))
        by = cells.join(self.units, "group").groupBy("label", "split_name").agg(F.sum("n").alias("n_rows"), F.coalesce(F.sum(small), F.lit(0)).alias("n_small"))
        whole = by.groupBy("label").agg(F.sum("n_rows").alias("_all"), F.sum("n_small").alias("_small"))
        return by.join(whole, "label").select("label", "split_name", "n_rows", (F.col("n_rows") / F.col("_all")).alias("label_share"), "n_small", F.try_divide("n_small", "_small").alias("small_share"))


def split_check(idmap: DataFrame, targets: DataFrame, assignment: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """One row: rows of ``idmap`` not assigned once, left ids and segments in more than one split, and splits whose
    share of rows is off its target by more than ``tolerance``, seen from the tables alone."""
    rows = idmap.select("pos", *_ids()).join(assignment, "pos", "left")
    per_row = rows.groupBy("pos").agg(F.count("split_name").alias("times"))
    by = {c: rows.where(F.col(c).isNotNull()).groupBy(c).agg((F.min("split_name") != F.max("split_name")).alias("two")) for c in ("leftid", "seg_id")}
    named = targets.where("split_name is not null and target_share > 0")
    want = named.select("split_name", (F.col("target_share") / named.agg(F.sum("target_share")).first()[0]).alias("want"))
    share = want.join(assignment.groupBy("split_name").agg(F.count(F.lit(1)).alias("n")), "split_name", "left")
    off = F.abs(F.coalesce("n", F.lit(0)) / F.lit(max(1, idmap.count())) - F.col("want")) > tolerance
    counts = [per_row.agg(F.count_if(F.col("times") != 1).alias("unassigned")), *[by[c].agg(F.count_if("two").alias(f"split_{c}s")) for c in by], share.agg(F.count_if(off).alias("shares_off"))]
    out = counts[0]
    for c in counts[1:]:
        out = out.crossJoin(c)  # one row each
    return out
