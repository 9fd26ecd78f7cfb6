"""Most similar vectors by additive quantisation.

A vector is the sum of one codeword from each of M full-dimensional codebooks; codebooks are fitted on the
residuals of their predecessors and codes are found by beam search over all of them. An index row is M codes
and the stored norm of their sum, a query scores it by adding M entries of its lookup table. The first codebooks
are also the partition: a vector lives in the cell that it reaches greedily through them (which need not be the codes
that the beam chose), and a query visits its own cell and those that a beam search through them finds nearest. There is
one such level while its codewords are few, and more of them as rows grow, so that a cell keeps about the same number
of rows. What passes the lookup is rescored inside its block, each query keeps a bounded number there, and the
best of all blocks are reranked by exact cosine. Cells larger than a block are cut into blocks on both sides, so no task
holds more than a block of either, whatever a cell holds. Exact copies are indexed once and joined back afterwards.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessitura.operators.skew import hot_keys, split_join
from tessitura.workspace import Workspace, bounded_sample, spread

#: Vectors that codebooks are fitted on, at least and for every codeword of a level (a bound of the fit only: every vector
#: is encoded and indexed).
FIT_ROWS, FIT_PER_CODEWORD = 16_000, 16
#: Codebooks, codewords of all but the first, beam width, iterations of k-means.
CODEBOOKS, CODEWORDS, BEAM, ITERATIONS = 6, 128, 3, 6
#: Vectors per cell aimed at, most codewords of a level of the partition, cells visited.
CELL_ROWS, MAX_BOOK, PROBES = 1200, 2048, 8
#: Index rows and queries of a block.
BLOCK, QUERY_BLOCK = 8192, 32768
#: Candidates that a query keeps of each block and of all, beyond the neighbours wanted.
SPARE = 11
#: Margin of the quantised cosine below its expected value, in parts of the residual; a pair is lost only if
#: both of its directions fall below.
MARGIN = 0.3


def usable(c: str, dim: int) -> Column:
    """True for vectors of length ``dim`` with finite entries that are not all zero."""
    v = F.col(c)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(v) == dim) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


@dataclass
class AdditiveQuantizer:
    """Residual codebooks with beam-search encoding; ``books[m]`` is (codewords, dim)."""

    books: list[np.ndarray]
    levels: int = 1

    @staticmethod
    def fit(x: np.ndarray, first: int, codewords: int = CODEWORDS, codebooks: int = CODEBOOKS, iterations: int = ITERATIONS, seed: int = 7, levels: int = 1) -> AdditiveQuantizer:
        """Fit on ``x`` (n, dim): ``levels`` books of ``first`` codewords, then the others. Codewords beyond the number
        of rows repeat rows with a little noise."""
        rng, r, books = np.random.default_rng(seed), np.array(x, dtype=np.float32), []
        for m in range(codebooks + levels - 1):
            k = first if m < levels else codewords
            c = r[rng.choice(len(r), k, replace=len(r) < k)] + rng.normal(0, 1e-4, (k, r.shape[1])).astype(np.float32)
            for _ in range(iterations):
                near = _nearest(r, c)
                n = np.bincount(near, minlength=k)
                order = np.argsort(near, kind="stable")
                sums = np.add.reduceat(r[order], np.minimum(np.cumsum(n) - n, len(r) - 1), axis=0)
                c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c).astype(np.float32)
            books.append(c)
            r = r - c[_nearest(r, c)]
        return AdditiveQuantizer(books, levels)

    def encode(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Codes (n, M): the best of ``beam`` partial sums kept at every codebook."""
        codes, residual = self._beam(x, beam, self.books)
        return codes[np.arange(len(x)), (residual**2).sum(2).argmin(1)]

    def cells(self, x: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
        """(own, others): the cell that every row reaches greedily, and up to ``probes`` - 1 others near it; -1 is none."""
        part = self.books[: self.levels]
        own = self._number(self._beam(x, 1, part)[0])
        codes, residual = self._beam(x, 2 * probes if self.levels > 1 else probes, part)
        near = self._number(codes)
        order = np.argsort((residual**2).sum(2), axis=1, kind="stable")
        near = np.take_along_axis(near, order, 1)
        other = near != own
        rank = np.cumsum(other, axis=1)
        return own[:, 0], np.where(other & (rank < probes), near, -1)

    def _number(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros(codes.shape[:2], dtype=np.int64)
        for m in range(self.levels):
            out = out * len(self.books[m]) + codes[:, :, m]
        return out

    @staticmethod
    def _beam(x: np.ndarray, beam: int, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(codes, residuals) of the ``beam`` best partial sums through ``books``."""
        n, rows = len(x), np.arange(len(x))[:, None]
        residual, codes = x[:, None, :].astype(np.float32), np.zeros((n, 1, 0), dtype=np.int16)
        for c in books:
            b, k = residual.shape[1], len(c)
            # squared length of the new residual
            cost = (residual**2).sum(2)[:, :, None] - 2 * (residual.reshape(n * b, -1) @ c.T).reshape(n, b, k) + (c**2).sum(1)
            flat = cost.reshape(n, b * k)
            keep = min(beam, b * k)
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep] if keep < b * k else np.broadcast_to(np.arange(b * k), (n, b * k))
            residual = residual[rows, best // k] - c[best % k]
            codes = np.concatenate([codes[rows, best // k], (best % k).astype(np.int16)[:, :, None]], axis=2)
        return codes, residual

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(b[codes[:, m]] for m, b in enumerate(self.books))

    def tables(self, q: np.ndarray) -> list[np.ndarray]:
        """Lookup tables of queries: inner products of all codewords (rows) with all queries."""
        return [b @ q.T for b in self.books]


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c**2).sum(1) / 2
    return np.concatenate([(x[i : i + 8192] @ c.T - half).argmax(1) for i in range(0, len(x), 8192)]) if len(x) else np.zeros(0, dtype=np.int64)


def lookup_scores(tables: list[np.ndarray], codes: np.ndarray) -> np.ndarray:
    """(codes, queries): inner product of every query with every sum of codewords, by adding table rows.
    Divided by the stored norm it is the quantised cosine."""
    out = tables[0][codes[:, 0]]
    for m in range(1, len(tables)):
        out += tables[m][codes[:, m]]
    return out


def _unit(vectors: pa.Array) -> np.ndarray:
    flat = np.asarray(vectors.flatten(), dtype=np.float64).reshape(len(vectors), -1)
    return (flat / np.sqrt((flat**2).sum(1, keepdims=True))).astype(np.float32)


def _bytes(a: np.ndarray) -> pa.Array:
    """Rows of ``a`` as binary values."""
    a = np.ascontiguousarray(a)
    width = a.shape[1] * a.itemsize
    return pa.Array.from_buffers(pa.binary(width), len(a), [None, pa.py_buffer(a.tobytes())]).cast(pa.binary())


def _rows(c: pa.ChunkedArray, dtype: type, width: int) -> np.ndarray:
    """Binary values as the rows of a matrix."""
    return np.frombuffer(b"".join(c.to_pylist()), dtype=dtype).reshape(-1, width)


def _shards(n: int) -> int:
    return max(1, -(-n // BLOCK))


def _best(x: np.ndarray, q: np.ndarray, passed: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, query, inner product) of the ``keep`` best rows of ``x`` for every query among those that ``passed``."""
    most = int(passed.sum(0).max(initial=0))
    if most <= keep:
        r, c = np.nonzero(passed)
        return r, c, np.einsum("ij,ij->i", x[r], q[c])
    s = np.where(passed, x @ q.T, np.float32(-4))
    r = np.argpartition(-s, keep - 1, axis=0)[:keep] if keep < len(x) else np.broadcast_to(np.arange(len(x))[:, None], s.shape)
    r, c = r.ravel(), np.tile(np.arange(len(q)), len(r))
    return r, c, s[r, c]


class Neighbours:
    """Index of the usable vectors of ``df``, and searches against it.

    ``id_col`` is a unique long, ``vector_col`` an array of numbers, compared as floats of 32 bits with
    exact cosines in 64 bits. Rows that are not usable (null, wrong size, null or non-finite entries, all
    zero, null id) are neither found nor searched for. Equal cosines are ordered by id. An empty input
    gives empty results; other columns are not looked at.
    """

    def __init__(self, df: DataFrame, id_col: str, vector_col: str, dim: int):
        self.spark, self.dim = df.sparkSession, dim
        self.ws = Workspace(self.spark, "neighbours")
        self.raw = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("v"))
        self.n = self.raw.count()  # not usable rows included: it only sets sizes
        cells = max(8, self.n / CELL_ROWS)
        self.levels = max(1, math.ceil(math.log(cells) / math.log(MAX_BOOK) - 1e-9))
        self.book = 2 ** round(math.log2(cells)) if self.levels == 1 else math.ceil(cells ** (1 / self.levels))
        sample = bounded_sample(self.raw, "id", max(FIT_ROWS, FIT_PER_CODEWORD * self.book), self.n).where(usable("v", dim)).toArrow()
        self.quantizer = AdditiveQuantizer.fit(_unit(sample["v"].combine_chunks()), self.book, levels=self.levels) if sample.num_rows else None

    @property
    def rows(self) -> DataFrame:
        """Usable vectors, -0.0 being 0.0."""
        clean = F.transform("v", lambda x: F.when(x == 0, F.lit(0.0).cast("float")).otherwise(x))
        return self.raw.where(usable("v", self.dim)).withColumn("v", clean)

    # -- encoding ---------------------------------------------------------------------------------

    def encoded(self) -> DataFrame:
        """(id, h1, h2, cell, probes, codes, norm, rho, hi, lo): the index row and the query of every vector.

        ``norm`` is the length of the sum of codewords, ``rho`` its cosine with the vector; ``hi`` and ``lo`` are the bytes
        of the vector's entries as whole numbers of 16 bits, ``hi`` alone being the vector in coarser steps. h1 and
        h2 are 64-bit hashes of the whole vector.
        """
        shared, probes = self.spark.sparkContext.broadcast(self.quantizer), PROBES

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            aq = shared.value
            for b in batches:
                for at in range(0, b.num_rows, 1024):
                    part = b.slice(at, 1024)
                    x = _unit(part["v"])
                    codes = aq.encode(x)
                    sums = aq.decode(codes)
                    norm = np.maximum(np.sqrt((sums**2).sum(1)), 1e-6)
                    own, others = aq.cells(x, probes)
                    ends = np.concatenate([[0], np.cumsum((others >= 0).sum(1))]).astype(np.int32)
                    whole = np.rint(x / (np.abs(x).max(1, keepdims=True) / 32000)).astype(np.int32)
                    hi = (whole + 128) >> 8
                    yield pa.RecordBatch.from_arrays(
                        [
                            part["id"], part["h1"], part["h2"], pa.array(own), pa.ListArray.from_arrays(ends, pa.array(others[others >= 0])),
                            _bytes(codes), pa.array(norm), pa.array(((x * sums).sum(1) / norm).astype(np.float32)), _bytes(hi.astype(np.int8)), _bytes((whole - (hi << 8)).astype(np.int8)),
                        ],
                        ["id", "h1", "h2", "cell", "probes", "codes", "norm", "rho", "hi", "lo"],
                    )

        hashed = self.rows.select("id", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit("again"), "v").alias("h2"), "v")
        schema = "id long, h1 long, h2 long, cell long, probes array<long>, codes binary, norm float, rho float, hi binary, lo binary"
        return self.ws.write(hashed.mapInArrow(encode, schema), "encoded")

    # -- all vectors against all, above a cosine --------------------------------------------------

    def similar_pairs(self, min_cosine: float, k: int = 5) -> DataFrame:
        """(vec_a, vec_b, cosine), smaller id first, of pairs with at least ``min_cosine`` in which one is
        among the other's ``k`` most similar vectors.

        Every vector is a query. Only candidates whose quantised cosine reaches what ``min_cosine`` implies
        for the stored norm, less a margin, are rescored, and only the best ``k`` + SPARE of a query reranked, so
        candidates grow with the rows, however dense a cluster is. Exact copies search once.
        """
        empty = self.spark.createDataFrame([], "vec_a long, vec_b long, cosine double")
        if self.quantizer is None:
            return empty
        enc = self.encoded()
        groups = enc.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
        repeated = self.ws.write(groups.where("n > 1"), "repeated")
        hashes = enc.select("id", "h1", "h2")
        members = split_join(hashes, repeated.withColumnRenamed("h2", "_h2"), "h1", hot_keys(hashes, "h1", self.n), ["id"], "inner", F.col("h2") == F.col("_h2"))
        members = self.ws.write(members.select("rep", "id", "n"), "members")
        reps = enc.drop("h1", "h2").join(members.where("id <> rep").select("id"), "id", "left_anti")
        found = self.ws.write(self._candidates(reps, min_cosine, k + SPARE), "candidates")
        needed = found.select(F.col("a").alias("id")).unionByName(found.select(F.col("b").alias("id"))).distinct()
        vectors = self.ws.write(self.raw.join(needed, "id", "left_semi"), "vectors")  # candidates are usable
        cosine = _cosine(F.col("va"), F.col("vb"))
        va = vectors.select(F.col("id").alias("a"), F.col("v").alias("va"))
        vb = vectors.select(F.col("id").alias("b"), F.col("v").alias("vb"))
        near = found.join(va, "a").join(vb, "b").select("a", "b", cosine.alias("cosine")).where(F.col("cosine") >= min_cosine)
        near = self.ws.write(near, "near")
        both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "cosine"))

        # copies: a group shows its k + 1 smallest ids to others; groups of more than k find only themselves
        first = Window.partitionBy("rep").orderBy("id")
        copies = self.ws.write(members.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).drop("r"), "copies")
        shown = copies.select("rep", F.col("id").alias("x"))
        among = split_join(members.select("rep", "id"), shown, "rep", hot_keys(members, "rep", self.n), ["id"], "inner")
        among = among.where("id <> x").select(F.col("id").alias("q"), "x", F.lit(1.0).alias("cosine"))
        few = copies.where(F.col("n") <= k).select(F.col("rep").alias("a"), F.col("id").alias("qa"))
        big = copies.where(F.col("n") > k).select(F.col("rep").alias("a")).distinct()
        xs = copies.select(F.col("rep").alias("b"), F.col("id").alias("xb"))
        others = (
            both.join(big, "a", "left_anti").join(few, "a", "left").join(xs, "b", "left")
            .select(F.coalesce("qa", "a").alias("q"), F.coalesce("xb", "b").alias("x"), "cosine")
        )
        best = Window.partitionBy("q").orderBy(F.col("cosine").desc(), "x")
        top = among.unionByName(others).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k)
        return top.groupBy(F.least("q", "x").alias("vec_a"), F.greatest("q", "x").alias("vec_b")).agg(F.max("cosine").alias("cosine"))

    def _candidates(self, reps: DataFrame, min_cosine: float, keep: int) -> DataFrame:
        """(a, b), a < b: the ``keep`` best candidates of every vector, rescored, from the visited cells."""
        one, none = F.lit(1), F.lit(0)
        visits = reps.select(F.col("cell").alias("c"), one.alias("x"), one.alias("q")).unionByName(reps.select(F.explode("probes").alias("c"), none.alias("x"), one.alias("q")))
        sizes = visits.groupBy("c").agg(F.sum("x").alias("x"), F.sum("q").alias("q")).where("x > 0")
        sizes = self.ws.write(sizes.select("c", F.ceil(F.col("x") / BLOCK).cast("int").alias("nx"), F.ceil(F.col("q") / QUERY_BLOCK).cast("int").alias("nq")), "sizes")
        groups = sizes.agg(F.sum(F.col("nx") * F.col("nq"))).first()[0] or 1
        cut = sizes.where("nx > 1 or nq > 1")  # few: each has as many rows as a block; joined as its written size suggests

        def placed(df: DataFrame) -> DataFrame:
            out = df.join(cut, "c", "left")
            return out.withColumns({"nx": F.coalesce("nx", one), "nq": F.coalesce("nq", one)})

        def shard(n: str) -> Column:
            return F.pmod(F.xxhash64("id"), F.col(n)).cast("int")

        def every(n: str) -> Column:
            return F.explode(F.sequence(none, F.col(n) - 1))

        index = placed(reps.select(F.col("cell").alias("c"), "id", "codes", "norm", "rho", "hi", "lo"))
        query = placed(reps.select(F.explode("probes").alias("c"), "id", "hi", F.lit(None).cast("binary").alias("lo")))
        # in a cell of one block index rows search their own cell themselves; larger ones need copies as queries
        own = placed(reps.select(F.col("cell").alias("c"), "id", "hi", "lo")).where("nx > 1")
        absent = {"codes": F.lit(None).cast("binary"), "norm": F.lit(None).cast("float"), "rho": F.lit(None).cast("float")}
        index = index.withColumn("xs", shard("nx")).withColumn("qs", every("nq"))
        query = query.unionByName(own).withColumns(absent).withColumn("qs", shard("nq")).withColumn("xs", every("nx"))
        shared, dim = self.spark.sparkContext.broadcast(self.quantizer), self.dim
        side = math.sqrt(max(0.0, 1 - min_cosine**2)) * MARGIN

        def vectors(t: pa.Table, fine: bool) -> tuple[np.ndarray, np.ndarray]:
            """Unit vectors, and how far an inner product with one may be off."""
            v = _rows(t["hi"], np.int8, dim).astype(np.float32)
            if fine:
                v = v * 256 + _rows(t["lo"], np.int8, dim)
            length = np.sqrt((v**2).sum(1))
            return v / length[:, None], 2 / length + np.float32(1e-4)

        def scan(t: pa.Table) -> pa.Table:
            aq, is_x, fine = shared.value, t["codes"].is_valid(), t["lo"].is_valid()
            x = t.filter(is_x)
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            if x.num_rows:
                xid, codes = x["id"].to_numpy(), _rows(x["codes"], np.int16, len(aq.books))
                xv, xoff = vectors(x, True)
                rho = x["rho"].to_numpy()
                floor = min_cosine * rho - side * np.sqrt(np.maximum(0, 1 - rho**2)) - 0.02
                floor = (floor * x["norm"].to_numpy())[:, None].astype(np.float32)
                sets = [(g["id"].to_numpy(), *vectors(g, f)) for f in (False, True) if (g := t.filter(pc.and_(pc.invert(is_x), fine if f else pc.invert(fine)))).num_rows]
                if x["nx"][0].as_py() == 1 and x["qs"][0].as_py() == 0:
                    sets.append((xid, xv, xoff))
                for qid, qv, off in sets:
                    for i in range(0, len(qid), 128):
                        v = qv[i : i + 128]
                        passed = lookup_scores(aq.tables(v), codes) >= floor
                        r, c, s = _best(xv, v, passed, keep + 1)
                        ok = (s >= min_cosine - off[i + c]) & (xid[r] != qid[i + c])
                        out.append((qid[i + c[ok]], xid[r[ok]], s[ok]))
            a, b, s = (np.concatenate(z) for z in zip(*out)) if out else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float32))
            return pa.table({"q": pa.array(a, pa.int64()), "x": pa.array(b, pa.int64()), "s": pa.array(s, pa.float32())})

        columns = ["c", "xs", "qs", "id", "codes", "norm", "rho", "hi", "lo", "nx"]
        blocks = spread(index.select(*columns).unionByName(query.select(*columns)), groups, "c", "xs", "qs").groupBy("c", "xs", "qs")
        best = Window.partitionBy("q").orderBy(F.col("s").desc(), "x")
        top = blocks.applyInArrow(scan, "q long, x long, s float").withColumn("r", F.row_number().over(best)).where(F.col("r") <= keep)
        return top.select(F.least("q", "x").alias("a"), F.greatest("q", "x").alias("b")).distinct()

    # -- a stated query set against all -----------------------------------------------------------

    def search(self, is_query: Column, k: int = 5, rerank: int = 512) -> DataFrame:
        """(vec_id, neighbour, cosine, rank): the ``k`` most similar other vectors of every query row.

        The queries visit every block of the index: codes are scored by lookup, the best ``rerank`` of each
        block are reranked exactly there, so what a block returns is exact among them.
        """
        schema = "vec_id long, neighbour long, cosine double"
        if self.quantizer is None:
            return self.spark.createDataFrame([], schema + ", rank int")
        blocks = _shards(self.n)
        index = self.rows.select("id", "v", F.lit(False).alias("is_q"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
        query = self.rows.where(is_query).select("id", "v", F.lit(True).alias("is_q"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        shared = self.spark.sparkContext.broadcast(self.quantizer)

        def scan(t: pa.Table) -> pa.Table:
            aq = shared.value
            t = t.sort_by("id")
            is_q = np.asarray(t["is_q"])
            ids, flat = t["id"].to_numpy(), np.asarray(t["v"].combine_chunks().flatten(), dtype=np.float64).reshape(t.num_rows, -1)
            unit = flat / np.sqrt((flat**2).sum(1, keepdims=True))
            x, xid, q, qid = unit[~is_q], ids[~is_q], unit[is_q], ids[is_q]
            out: list[tuple[int, int, float]] = []
            if len(x) and len(q):
                codes = np.concatenate([aq.encode(x[i : i + 2048].astype(np.float32)) for i in range(0, len(x), 2048)])
                norm = np.maximum(np.sqrt((aq.decode(codes) ** 2).sum(1)), 1e-6)
                for i in range(0, len(q), 512):
                    s = (lookup_scores(aq.tables(q[i : i + 512].astype(np.float32)), codes) / norm[:, None]).T
                    keep = min(rerank + 1, len(x))
                    edge = -np.partition(-s, keep - 1, axis=1)[:, keep - 1]
                    for j in range(len(s)):
                        c = np.flatnonzero(s[j] > edge[j])
                        c = np.concatenate([c, np.flatnonzero(s[j] == edge[j])[: keep - len(c)]])
                        c = c[xid[c] != qid[i + j]]
                        cos = x[c] @ q[i + j]
                        best = np.lexsort((xid[c], -cos))[:k]
                        out += [(qid[i + j], xid[c[b]], cos[b]) for b in best]
            a, b, c = (list(z) for z in zip(*out)) if out else ([], [], [])
            return pa.table({"vec_id": pa.array(a, pa.int64()), "neighbour": pa.array(b, pa.int64()), "cosine": pa.array(c, pa.float64())})

        near = spread(index.unionByName(query), blocks, "block").groupBy("block").applyInArrow(scan, schema)
        rank = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.col("cosine").desc(), "neighbour"))
        return near.withColumn("rank", rank).where(F.col("rank") <= k)


def search_recall(df: DataFrame, id_col: str, vector_col: str, dim: int, is_query: Column, k: int = 5) -> DataFrame:
    """One row (n_queries, n_wanted, n_found) of :meth:`Neighbours.search` against all cosines of the query rows, which
    are computed block by block. Found is what is at least as near as the k-th of all."""
    index = Neighbours(df, id_col, vector_col, dim)
    got = index.ws.write(index.search(is_query, k), "got")
    rows, blocks = index.rows, _shards(index.n)
    every = rows.where(is_query).select("id", "v", F.lit(True).alias("is_q"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")

    def scan(t: pa.Table) -> pa.Table:
        is_q, ids = np.asarray(t["is_q"]), t["id"].to_numpy()
        x = np.asarray(t["v"].combine_chunks().flatten(), dtype=np.float64).reshape(t.num_rows, -1)
        x /= np.sqrt((x**2).sum(1, keepdims=True))
        keep, out = min(k + 1, int((~is_q).sum())), []
        for i in range(0, int(is_q.sum()), 512):
            q, s = ids[is_q][i : i + 512], x[is_q][i : i + 512] @ x[~is_q].T
            best = np.argpartition(-s, keep - 1, axis=1)[:, :keep] if keep else np.zeros((len(q), 0), dtype=int)
            out.append((np.repeat(q, keep), ids[~is_q][best].ravel(), np.take_along_axis(s, best, 1).ravel()))
        a, b, c = (np.concatenate(z) for z in zip(*out)) if out else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))
        return pa.table({"vec_id": pa.array(a, pa.int64()), "x": pa.array(b, pa.int64()), "c": pa.array(c, pa.float64())})

    near = spread(rows.select("id", "v", F.lit(False).alias("is_q"), block.alias("block")).unionByName(every), blocks, "block").groupBy("block").applyInArrow(scan, "vec_id long, x long, c double")
    nth = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.col("c").desc()))
    true = near.where("vec_id <> x").withColumn("r", nth).where(F.col("r") <= k).groupBy("vec_id").agg(F.min("c").alias("least"), F.count(F.lit(1)).alias("wanted"))
    hits = got.groupBy("vec_id").agg(F.collect_list("cosine").alias("c"))  # at most k
    found = F.size(F.filter(F.coalesce("c", F.array().cast("array<double>")), lambda c: c >= F.col("least") - 1e-9))
    return true.join(hits, "vec_id", "left").agg(F.count(F.lit(1)).alias("n_queries"), F.coalesce(F.sum("wanted"), F.lit(0)).alias("n_wanted"), F.coalesce(F.sum(found), F.lit(0)).alias("n_found"))


def _cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, r: p.cast("double") * r.cast("double")), F.lit(0.0), lambda s, z: s + z)

    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
