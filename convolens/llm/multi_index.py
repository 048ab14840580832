"""Nearest neighbours by an inverted multi-index: both halves of a vector quantised, cells visited by a heap.

Equal vectors are one entry, which keeps as many of its smallest ids as any answer can need. Two codebooks, one a
half, are fitted on a bounded sample; a cell is a pair of centroids, and every vector is indexed under its cell. A
query visits cells by falling sum of the two halves' inner products, until they hold as many entries as an audit
found necessary: there a bounded set of queries is compared with all entries, and the budget is what reaches
TARGET of their neighbours.

Cells lie in order in blocks of some BLOCK entries; a larger cell takes several. A query is sent once to each block
it visits, and is compared with that block's entries in double precision; what scores below the last neighbour of a
bounded sample isn't given on. Blocks that very many queries visit are
repeated for parts of their queries. So a task holds a bounded number of entries and queries, whatever is popular.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, join_counted

NEAREST, EVERY = 20, 20
#: Rows, and bytes of them, that codebooks are fitted on; centroids of a half at most; rounds of fitting.
SAMPLE_ROWS, SAMPLE_BYTES, MOST_CENTROIDS, FIT_ROUNDS = 32_768, 32_000_000, 512, 8
#: Queries compared with all entries, and the share of their neighbours that the budget must reach.
AUDIT_QUERIES, TARGET = 256, 0.94
#: Entries of a block and queries of a part of it, on average; queries that one task sends to blocks.
BLOCK, PART, ASKING = 2048, 2048, 256
#: Entries for a cell, on average; rows of the sample that tell a query what its last neighbour scores at least.
CELL, FLOOR_ROWS = 16, 16_384
#: Candidates beyond those asked for that are scored again in a fixed order of additions.
SPARE = 8


def _dtype(rows: DataFrame, vec_col: str) -> str:
    return "<f8" if "double" in rows.schema[vec_col].dataType.simpleString() else "<f4"


def _valid(rows: DataFrame, id_col: str, vec_col: str, dtype: str) -> DataFrame:
    """(vec_id, vec): vectors that take part, their components as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for i, x in enumerate(batch.column(1)):
                if x.is_valid and len(x) and x.values.null_count == 0:
                    a = x.values.to_numpy(zero_copy_only=False).astype(dtype)
                    if np.isfinite(a).all() and a.any():
                        at.append(i)
                        out.append((a + 0).tobytes())  # -0 as 0
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(out, pa.binary())], names=["vec_id", "vec"])

    own = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v"))
    return own.mapInArrow(run, "vec_id long, vec binary")


def _matrix(column: pa.Array | pa.ChunkedArray, dtype: str) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), dtype).reshape(len(values), -1).astype(np.float64)


def _nearest_centroid(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    norms = np.einsum("ij,ij->i", centroids, centroids) / 2
    return np.concatenate([np.argmin(norms - x[i : i + 4096] @ centroids.T, axis=1) for i in range(0, len(x), 4096)] or [np.empty(0, np.int64)])


def fit_codebook(x: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """k-means from rows drawn at random, so that dense regions get centroids by their weight; in order along one axis."""
    centroids = x[np.random.default_rng(seed).permutation(len(x))[:k]]
    for _ in range(FIT_ROUNDS):
        at = _nearest_centroid(x, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, at, x)
        n = np.bincount(at, minlength=len(centroids))
        centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centroids)
    spread = centroids - centroids.mean(axis=0)
    axis = np.linalg.svd(spread, full_matrices=False)[2][0] if centroids.shape[1] else np.empty(0)
    return centroids[np.argsort(spread @ axis)]


class Index:
    """The codebooks, and the cells' sizes and blocks: bounded by MOST_CENTROIDS squared."""

    def __init__(self, sample: np.ndarray, entries: int):
        self.half = sample.shape[1] // 2
        k = int(np.clip(math.sqrt(entries / CELL), 1, min(MOST_CENTROIDS, len(sample))))
        self.books = [fit_codebook(part, k, seed) for seed, part in enumerate((sample[:, : self.half], sample[:, self.half :]))]
        self.k, self.sample = k, sample[:FLOOR_ROWS].astype(np.float32)
        self.widest = float(np.sqrt(np.einsum("ij,ij->i", sample, sample).max()))

    def floors(self, queries: np.ndarray, k: int) -> np.ndarray:
        """What the k-th neighbour of each query scores at least: the k-th best score of the sample, but for rounding."""
        if len(self.sample) < k:
            return np.full(len(queries), -np.inf)
        found = []
        for i in range(0, len(queries), 256):
            score = queries[i : i + 256].astype(np.float32) @ self.sample.T
            found.append(np.partition(score, -k, axis=1)[:, -k].astype(np.float64))
        return np.concatenate(found) - 1e-4 * np.linalg.norm(queries, axis=1) * self.widest

    def cells(self, x: np.ndarray) -> np.ndarray:
        one, two = (_nearest_centroid(part, book) for part, book in zip((x[:, : self.half], x[:, self.half :]), self.books))
        return one * self.k + two

    def set_sizes(self, cells: np.ndarray, n: np.ndarray) -> None:
        self.sizes = np.zeros(self.k * self.k, np.int64)
        self.sizes[cells] = n
        ends = np.cumsum(self.sizes)
        self.first, self.last = (ends - self.sizes) // BLOCK, np.maximum(ends - 1, 0) // BLOCK

    def halves(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.books[0] @ query[: self.half], self.books[1] @ query[self.half :]

    def needed(self, query: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Entries that a query meets up to and with each of `cells`."""
        one, two = self.halves(query)
        total = np.add.outer(one, two).ravel()
        order = np.argsort(-total)
        met = np.empty(len(total), np.int64)
        met[order] = np.cumsum(self.sizes[order])
        return met[cells]

    def visited(self, query: np.ndarray, budget: int) -> list[int]:
        """Non-empty cells by falling sum of inner products, until they hold `budget` entries."""
        one, two = self.halves(query)
        by_one, by_two = np.argsort(-one), np.argsort(-two)
        one, two, rows, columns = one[by_one].tolist(), two[by_two].tolist(), (by_one * self.k).tolist(), by_two.tolist()
        sizes, k, met, out = self.sizes_list, self.k, 0, []
        reached = [0] * k  # of each row, the columns taken so far
        heap = [(-(one[0] + two[0]), 0, 0)]
        while heap and met < budget:
            _, i, j = heappop(heap)
            reached[i] = j + 1
            cell = rows[i] + columns[j]
            if sizes[cell]:
                met += sizes[cell]
                out.append(cell)
            # a pair is a candidate once both pairs in front of it are taken
            if j + 1 < k and (i == 0 or reached[i - 1] > j + 1):
                heappush(heap, (-(one[i] + two[j + 1]), i, j + 1))
            if i + 1 < k and reached[i + 1] == j:
                heappush(heap, (-(one[i + 1] + two[j]), i + 1, j))
        return out

    def blocks(self, query: np.ndarray, budget: int) -> np.ndarray:
        if not hasattr(self, "sizes_list"):
            self.sizes_list = self.sizes.tolist()
        cells = self.visited(query, budget)
        return np.unique(np.concatenate([np.arange(self.first[c], self.last[c] + 1) for c in cells]))


def _in_order(queries: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows, components added from the first to the last."""
    total = np.zeros(len(queries))
    for d in range(queries.shape[1]):
        total += queries[:, d] * entries[:, d]
    return total


def _best(queries: np.ndarray, floors: np.ndarray, entries: np.ndarray, ids: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of the k best ids of each query that reach its floor, ties to the smaller id."""
    m, offsets, values, out = min(k + SPARE, len(entries)), ids.offsets.to_numpy(), ids.values.to_numpy(), []
    for i in range(0, len(queries), 128):
        own = queries[i : i + 128]
        rough = own @ entries.T
        reached = rough >= floors[i : i + 128, None]
        if reached.sum(axis=1).max(initial=0) > m:
            near = np.argpartition(-rough, m - 1, axis=1)[:, :m]
            kept = np.zeros_like(reached)
            np.put_along_axis(kept, near, True, axis=1)
            reached &= kept
        query, node = np.nonzero(reached)
        score = _in_order(own[query], entries[node])
        many = np.diff(offsets)[node]
        start = np.repeat(offsets[node] - np.cumsum(many) + many, many)
        found = values[start + np.arange(many.sum())]
        query, score = np.repeat(query, many), np.repeat(score, many)
        order = np.lexsort((found, -score, query))
        query, found, score = query[order], found[order], score[order]
        first = np.arange(len(query)) - np.searchsorted(query, query) < k
        out.append((query[first] + i, found[first], score[first]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _audit(index: Index, queries: np.ndarray, entries: DataFrame, dtype: str, k: int) -> int:
    """Entries to visit so that TARGET of the neighbours of `queries`, found among all entries, are met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(queries), 0), 0.0), np.empty((len(queries), 0), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            score = queries @ _matrix(batch.column(1), dtype).T
            cell = np.broadcast_to(batch.column(0).to_numpy(), score.shape)
            score, cell = np.concatenate([best[0], score], axis=1), np.concatenate([best[1], cell], axis=1)
            near = np.argsort(-score, axis=1, kind="stable")[:, : k + 1]
            best = np.take_along_axis(score, near, 1), np.take_along_axis(cell, near, 1)
        at = np.repeat(np.arange(len(queries)), best[0].shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(best[1].ravel()), pa.array(best[0].ravel())], names=["q", "cell", "score"])

    found = entries.select("cell", "vec").mapInArrow(run, "q long, cell long, score double")
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))
    true = found.withColumn("nth", nth).where(F.col("nth") <= k + 1).select("q", "cell").toPandas()
    needed = [index.needed(queries[q], cells.to_numpy()) for q, cells in true.groupby("q")["cell"]]
    return int(np.quantile(np.concatenate(needed), TARGET, method="higher"))


def _asks(queries: DataFrame, index: Index, budget: int, dtype: str, k: int) -> DataFrame:
    """(q, vec, floor, block): each query with the blocks it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            asked = _matrix(batch.column(1), dtype)
            found = [index.blocks(x, budget) for x in asked]
            at = np.repeat(np.arange(len(found)), [len(f) for f in found])
            arrays = [batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(index.floors(asked, k)[at]), pa.array(np.concatenate(found))]
            yield pa.RecordBatch.from_arrays(arrays, names=["q", "vec", "floor", "block"])

    tasks = min(max(1, queries.count() // ASKING), 10_000)
    return queries.select("q", "vec").repartition(tasks, "q").mapInArrow(run, "q long, vec binary, floor double, block long")


def _indexed(nodes: DataFrame, index: Index, dtype: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(index.cells(_matrix(batch.column(0), dtype))), *batch.columns], names=["cell", "vec", "ids"])

    return nodes.select("vec", "ids").mapInArrow(run, "cell long, vec binary, ids array<long>")


def _placed(entries: DataFrame, index: Index) -> DataFrame:
    """(block, vec, ids): a cell that spans blocks deals its entries over them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, deal = batch.column(0).to_numpy(), batch.column(3).to_numpy()
            block = index.first[cell] + deal % (index.last[cell] - index.first[cell] + 1)
            yield pa.RecordBatch.from_arrays([pa.array(block), *batch.columns[1:3]], names=["block", "vec", "ids"])

    return entries.select("cell", "vec", "ids", F.xxhash64("vec").alias("deal")).mapInArrow(run, "block long, vec binary, ids array<long>")


_RESULT = "query_id long, rank int, vec_id long, score double"


def nearest(rows: DataFrame, k: int = NEAREST, every: int = EVERY, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each row whose id `every` divides.

    Vectors that are null, zero, or hold null or non-finite components, rows without an id, and vectors of another
    length than the commonest take no part. Rows of one id are one row, with the least of their vectors in byte order.
    Ties go to the smaller id. A query with fewer candidates than k gets them all; an empty table gives no rows. Other
    columns aren't read.
    """
    spark, scratch, dtype = rows.sparkSession, Scratch(rows.sparkSession, "nearest"), _dtype(rows, vec_col)
    vectors = scratch.table(_valid(rows, id_col, vec_col, dtype).groupBy("vec_id").agg(F.min("vec").alias("vec")), "vectors")
    width = vectors.groupBy(F.length("vec").alias("width")).count().orderBy(F.desc("count"), "width").first()
    if not width:
        return spark.createDataFrame([], _RESULT)
    vectors = vectors.where(F.length("vec") == width[0])
    least = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    nodes = vectors.withColumn("nth", least).where(F.col("nth") <= k + 1).groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    nodes = scratch.table(nodes, "nodes")
    asked = vectors.where(F.pmod("vec_id", F.lit(every)) == 0)
    counted = scratch.table(asked.groupBy("vec").agg(F.min("vec_id").alias("q"), F.count("*").alias("n")), "queries")
    picked = lambda df, n: _matrix(df.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(n).toArrow().column(0), dtype)
    if counted.isEmpty():
        return spark.createDataFrame([], _RESULT)
    audited = picked(counted, AUDIT_QUERIES)
    index = Index(picked(nodes, min(SAMPLE_ROWS, max(256, SAMPLE_BYTES // width[0]))), nodes.count())
    entries = scratch.table(_indexed(nodes, index, dtype), "entries")
    sizes = entries.groupBy("cell").count().toArrow()  # at most MOST_CENTROIDS squared
    index.set_sizes(*(sizes.column(c).to_numpy() for c in ("cell", "count")))
    budget = _audit(index, audited, entries, dtype, k)
    found = _searched(scratch, entries, counted, index, budget, dtype, k)
    best = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("away"), "vec_id"))), lambda x: F.struct(x["vec_id"].alias("vec_id"), (-x["away"]).alias("score")))
    answers = found.groupBy("q").agg(best.alias("best")).join(counted.select("q", "n"), "q")
    askers = join_counted(asked, counted, ["vec"]).select(F.col("vec_id").alias("query_id"), "q")
    met = join_counted(askers, scratch.table(answers, "answers"), ["q"])
    others = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    ranked = met.select("query_id", F.posexplode(others).alias("rank", "found"))
    return ranked.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "found.vec_id", "found.score")


def _searched(scratch: Scratch, entries: DataFrame, queries: DataFrame, index: Index, budget: int, dtype: str, k: int) -> DataFrame:
    """(q, vec_id, score): the k + 1 best ids of each query, itself among them."""
    asks = scratch.table(_asks(queries, index, budget, dtype, k + 1), "asks")
    parts = scratch.table(asks.groupBy("block").agg(F.count("*").alias("n"), F.ceil(F.count("*") / PART).alias("parts")), "parts")
    dealt = join_counted(asks, parts, ["block"]).withColumn("part", F.pmod(F.xxhash64("q"), "parts"))
    placed = _placed(entries, index).join(parts, "block").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))

    def compared(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            empty = np.empty(0, np.int64)
            return pa.table([pa.array(empty), pa.array(empty), pa.array(np.empty(0))], names=["q", "vec_id", "score"])
        q = left.column("q").to_numpy()
        at, ids, score = _best(_matrix(left.column("vec"), dtype), left.column("floor").to_numpy(), _matrix(right.column("vec"), dtype), right.column("ids").combine_chunks(), k + 1)
        return pa.table([pa.array(q[at]), pa.array(ids), pa.array(score)], names=["q", "vec_id", "score"])

    sides = dealt.select("block", "part", "q", "vec", "floor"), placed.select("block", "part", "vec", "ids")
    found = sides[0].groupBy("block", "part").cogroup(sides[1].groupBy("block", "part")).applyInArrow(compared, "q long, vec_id long, score double")
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("nth", nth).where(F.col("nth") <= k + 1).drop("nth")
