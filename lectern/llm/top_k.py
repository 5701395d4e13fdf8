"""Exact top-k by inner product over an impact-ordered index, score at a time.

Candidates are dealt into blocks, and each block is indexed once: every dimension has a posting list, the vectors in the
order of their components there. A query makes each posting an impact, the product of the two components less the least
that the dimension can give. Impacts are quantised into ``STEPS`` levels; as products rise or fall along a posting list, the
postings of one level are a segment of each list. Segments are processed by descending level, each posting once, into
accumulators, one number a vector that holds the impacts gained and the number of postings met.

After each level a vector can still gain at most, for each dimension whose posting has not been met, the bound of the
level (or the dimension's greatest impact, where that is less). The bar is the k-th best exact score among the vectors
that lead, and rises from level to level. Processing stops only when the bounds prove that no more than a share of the block can reach the
bar, or when all postings are met; the vectors that can are scored again exactly, so the result is exact whenever
processing stops. The k best of each block are merged.

Queries are a stated set, in blocks; each block of queries meets each block of candidates once, and a block is one row.

Defined cases: vectors that are null, or hold null or non-finite components, or have no components take no part; neither do
rows without vec_id; ties go to the smaller id; rows that repeat an id each count as candidates, but a query never meets
rows of its own id, and a query row that repeats another counts once; only vectors of the same number of components meet;
scores are exact up to 2^62 in size, beyond which the query fails; with fewer than k candidates all are returned; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import bounded, written

#: Components in a block of candidates (so vectors of 64 are dealt by 16,384), and vectors in a block of queries.
BLOCK_CELLS, QUERIES = 1 << 20, 512
#: Levels of impact; vectors that raise the bar besides the k, and the share of postings after which bounds are tried.
STEPS, TRIED, FIRST = 8, 64, 0.3
#: Share of a block that is scored again exactly rather than processing another level.
RESCORE = 0.25


class Index:
    """Posting lists of a block of integer vectors: ``order`` holds for each dimension the vectors by ascending component."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, order: np.ndarray | None = None):
        self.ids, self.vectors = ids, vectors.astype(np.int64)
        self.order = (np.argsort(vectors, axis=0, kind="stable").T if order is None else order).astype(np.intp)
        self.sorted = np.take_along_axis(self.vectors.T, self.order, 1)
        self.least, self.most = self.sorted[:, 0].copy(), self.sorted[:, -1].copy()
        self.as_floats = self.sorted.astype(np.float64)
        self.by_id = np.argsort(ids, kind="stable")
        self.sorted_ids = ids[self.by_id]
        #: Unit of the impacts in an accumulator, which counts postings below it.
        self.unit = 1 << int(len(self.least)).bit_length()

    def _levels(self, q: np.ndarray, floor: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """For each bound and dimension, how many postings from the list's strong end have impacts above the bound."""
        out = np.zeros((len(bounds), len(q)), np.int64)
        n, used = self.sorted.shape[1], np.flatnonzero(q)
        # The product is above floor + bound from some component on, which whole numbers find exactly.
        edges = (floor[used] + bounds[:, None]) // np.abs(q[used])
        for d, edge in zip(used.tolist(), edges.T):
            if q[d] > 0:
                out[:, d] = n - np.searchsorted(self.sorted[d], edge, side="right")
            else:
                out[:, d] = np.searchsorted(self.sorted[d], -edge, side="left")
        return out

    def possible(self, q: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
        """The vectors whose score may be among the k best, proved by bounds; ``own`` are not counted."""
        n, dims = self.vectors.shape
        if n <= 2 * (TRIED + k):
            return np.arange(n)
        floor = np.minimum(self.least * q, self.most * q)
        impacts = np.maximum(self.least * q, self.most * q) - floor
        if int(impacts.sum()) * self.unit >= 1 << 53:
            return np.arange(n)  # accumulators would not be exact
        bounds = int(impacts.max()) * (STEPS - np.arange(1, STEPS)) // STEPS
        ends = self._levels(q, floor, bounds)
        done, met, base, bar = np.zeros(dims, np.int64), np.zeros(n), int(floor.sum()), -np.inf
        # No bound is tried before the first so many postings, so their levels are processed in one.
        first = int(np.searchsorted(ends.sum(1), FIRST * n * np.count_nonzero(impacts)))
        scale, shift = (q * self.unit).astype(float).tolist(), (1 - floor * self.unit).astype(float).tolist()
        left = np.arange(n)
        for bound, now in zip(bounds[first:].tolist(), ends[first:]):
            rows, gains = [], []
            for d in np.flatnonzero(now > done).tolist():
                part = slice(n - now[d], n - done[d]) if scale[d] > 0 else slice(done[d], now[d])
                rows.append(self.order[d, part])
                gain = self.as_floats[d, part] * scale[d]  # whole numbers below 2^53, so exact
                gain += shift[d]
                gains.append(gain)
            done = now
            if rows:
                met += np.bincount(np.concatenate(rows), np.concatenate(gains), n)
            # Dimensions that are not active yet may give all they have; in the others a posting not met gives the bound.
            active = impacts > bound
            gained = np.floor(met / self.unit)
            upper = gained - (met - gained * self.unit) * bound
            rest = int(impacts[~active].sum()) + np.count_nonzero(active) * bound + base
            lead = np.argpartition(upper, n - TRIED - k)[n - TRIED - k :]
            lead = lead[~np.isin(lead, own)] if len(own) else lead
            if len(lead) >= k:
                bar = max(bar, np.sort(self.vectors[lead] @ q)[-k])
            left = np.flatnonzero(upper >= bar - rest)
            if len(left) <= RESCORE * n:
                break
        return left

    def search(self, owners: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query, (ids, scores) of the k best, ties to smaller ids, without vectors of the id of its owner."""
        most = np.maximum(np.abs(self.least).astype(object), np.abs(self.most).astype(object))
        if len(queries) and int((most * np.abs(queries).max(0).astype(object)).sum()) >= 1 << 62:
            raise OverflowError("scores beyond 2^62")
        out = []
        for owner, q in zip(owners.tolist(), queries.astype(np.int64)):
            own = self.by_id[slice(*np.searchsorted(self.sorted_ids, [owner, owner + 1]))]
            rows = self.possible(q, own, k)
            if len(own):
                rows = rows[~np.isin(rows, own)]
            exact = self.vectors[rows] @ q
            if len(rows) > 4 * k:
                bar = np.partition(exact, len(exact) - k)[len(exact) - k]
                rows, exact = rows[exact >= bar], exact[exact >= bar]
            order = np.lexsort((self.ids[rows], -exact))[:k]
            out.append((self.ids[rows][order], exact[order]))
        return out


def integer_vectors(table: DataFrame, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, vector: each component as floor(scale * x), x as double; rows that take no part are left out."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    good = F.col("x").isNotNull() & (F.size("x") > 0) & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where(good).where("vec_id is not null")
    return rows.select("vec_id", F.transform("x", lambda c: F.floor(F.lit(scale) * c).cast("long")).alias("vector"))


def _small(x: np.ndarray) -> np.ndarray:
    """The same whole numbers in as few bytes as hold them."""
    low, high = (int(x.min()), int(x.max())) if x.size else (0, 0)
    return x.astype(next(t for t in ("<i2", "<i4", "<i8") if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def _packed(rows: DataFrame, size, index: bool, name: str) -> DataFrame:
    """The written table of blocks of vectors with the same number of components: dims, block, ids and vectors, and with
    ``index`` their posting lists, as bytes. ``size`` is the number of vectors in a block, a column over dims."""

    def pack(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids = group["vec_id"].to_numpy().astype("<i8")
        vectors = group["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        columns = {"dims": pa.array([vectors.shape[1]], pa.int32()), "block": group["block"][:1].cast(pa.int32()), "ids": pa.array([ids.tobytes()], pa.binary())}
        small = _small(vectors)
        columns |= {"vectors": pa.array([small.tobytes()], pa.binary()), "width": pa.array([small.itemsize], pa.int32())}
        if index:
            columns["postings"] = pa.array([np.argsort(small, axis=0, kind="stable").T.astype("<i4").tobytes()], pa.binary())
        return pa.table(columns)

    rows = rows.withColumn("dims", F.size("vector"))
    counts = written(rows.groupBy("dims").count().select("dims", F.ceil(F.col("count") / size).cast("long").alias("blocks")), name + "-widths")
    # Rows are dealt by their place, so those that share an id are spread too.
    keyed = rows.withColumn("place", F.xxhash64(F.monotonically_increasing_id())).join(bounded(counts), "dims")
    keyed = keyed.select("vec_id", "vector", "dims", F.pmod("place", "blocks").cast("int").alias("block"))
    schema = "dims int, block int, ids binary, vectors binary, width int" + ", postings binary" * index
    return written(keyed.groupBy("dims", "block").applyInArrow(pack, schema), name)


def top_k(candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """candidates, queries: vec_id, vector (see ``integer_vectors``). Returns query_id, rank, vec_id, score."""
    packed = _packed(candidates, F.greatest(F.lit(256), F.lit(BLOCK_CELLS) / F.col("dims")), True, "top-candidates")
    asked = _packed(queries.dropDuplicates(["vec_id", "vector"]), F.lit(QUERIES), False, "top-queries")
    # Every block of queries meets every block of candidates of its width, each as one row.
    numbers = bounded(written(packed.select("dims", F.col("block").alias("at")), "top-numbers"))
    pairs = asked.select("dims", *(F.col(c).alias("query_" + c) for c in ("ids", "vectors", "width"))).join(numbers, "dims")
    pairs = pairs.join(packed.withColumnRenamed("block", "at"), ["dims", "at"])
    columns = ["dims", "ids", "vectors", "width", "postings", "query_ids", "query_vectors", "query_width"]

    def search(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                dims, ids, vectors, width, postings, query_ids, query_vectors, query_width = (batch.column(c)[at].as_py() for c in columns)
                index = Index(np.frombuffer(ids, "<i8"), np.frombuffer(vectors, f"<i{width}").reshape(-1, dims), np.frombuffer(postings, "<i4").reshape(dims, -1))
                owners, asked = np.frombuffer(query_ids, "<i8"), np.frombuffer(query_vectors, f"<i{query_width}").reshape(-1, dims).astype(np.int64)
                found = index.search(owners, asked, k)
                sizes = [len(f[0]) for f in found]
                which = np.repeat(np.arange(len(owners)), sizes)
                marks = np.array([int.from_bytes(_mark(q), "little", signed=True) for q in asked], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(owners[which]), pa.array(marks[which]), pa.array(np.concatenate([f[0] for f in found])), pa.array(np.concatenate([f[1] for f in found]).astype(np.int64))], names=["query_id", "mark", "vec_id", "score"])

    found = pairs.select(*columns).repartition(F.xxhash64("query_ids", "ids")).mapInArrow(search, "query_id long, mark long, vec_id long, score long")
    best = W.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _mark(vector: np.ndarray) -> bytes:
    return hashlib.blake2b(vector.tobytes(), digest_size=8).digest()
