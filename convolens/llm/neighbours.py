"""Embedding near-dedup: NN-descent over vectors of one label, then links at a cosine threshold.

Equal vectors of a label are one node. A first neighbour graph comes from buckets of random hyperplanes;
each round then joins neighbours of neighbours: the nodes around a node are compared with each other and
improve their lists, until few lists change. A list that is full of links may have missed some: such lists
are enlarged, and rounds go on. Links at the threshold make components, and links are counted inside each
component, compared in blocks in double precision. An audit compares a bounded set of nodes of each size of
label with all nodes; while too few of their links were found, buckets of new hyperplanes are added and rounds
go on. The last graph is audited too: under LEAST_RECALL the operator fails.

The number of hyperplanes follows each label's own size; a label that fits one bucket is compared whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .components import components

THRESHOLD = 0.93
NEIGHBOURS, TABLES, BUCKET_ROWS, CHUNK_ROWS = 10, 6, 48, 192
#: Nodes around one node that are compared at once; blocks of a component that one task compares.
JOIN_ROWS, BLOCK_ROWS = 64, 512
MAX_ROUNDS, SETTLED = 6, 0.02
#: Nodes of each class of label sizes; the recall that more rounds are run for; the least one that is accepted.
AUDIT_QUERIES, GOOD_RECALL, LEAST_RECALL, MAX_AUDITS = 512, 0.97, 0.9, 5


def _vectors(rows: DataFrame, dtype: str) -> DataFrame:
    """(vec_id, label, vec): the components as bytes, null if the vector links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, label in zip(batch.column(1), batch.column(2)):
                v = None
                if x.is_valid and label.is_valid and len(x) and x.values.null_count == 0:
                    a = x.values.to_numpy(zero_copy_only=False).astype(dtype)
                    wide = a.astype(np.float64)
                    if np.isfinite(wide).all() and wide.any() and np.isfinite(wide @ wide) and wide @ wide > 0:
                        v = (a + 0).tobytes()  # -0 as 0
                out.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.binary())], names=["vec_id", "label", "vec"])

    kinds = [rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")]
    return rows.select("vec_id", "embedding", "label").mapInArrow(run, f"vec_id {kinds[0]}, label {kinds[1]}, vec binary")


def _unit(column: pa.Array, dtype: str) -> np.ndarray:
    """Unit vectors in double precision; all are of one length."""
    x = np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1).astype(np.float64)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _groups(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[pa.Table]:
    """Runs of equal first columns, cut into pieces of at most `most` rows."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t])
        key = t.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for lo, hi in zip(edges[:-2], edges[1:-1]):
            for at in range(lo, hi, most or hi - lo):
                yield t.slice(at, min(most or hi - lo, hi - at))
        rest = t.slice(edges[-2])
        while most and rest.num_rows > most:
            yield rest.slice(0, most)
            rest = rest.slice(most)
        rest = rest.combine_chunks()
    if rest is not None and rest.num_rows:
        yield rest


def _emit(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    u, v, s = (np.concatenate(c) for c in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(s)], names=["u", "v", "sim"])


_EDGE = "u long, v long, sim double"


def _buckets(nodes: DataFrame, dtype: str, most_bits: int, seed: int, scratch: Scratch) -> DataFrame:
    """(key, nid, vec): each node once for each table of hyperplanes; large buckets in chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            codes = []
            for v in batch.column(1):
                x = np.frombuffer(v.as_py(), dtype)
                if len(x) not in planes:
                    planes[len(x)] = np.random.default_rng(seed).standard_normal((len(x), TABLES * most_bits))
                on = (x.astype(np.float64) @ planes[len(x)] > 0).reshape(TABLES, most_bits)
                codes.append((on @ (1 << np.arange(most_bits))).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.list_(pa.int64()))], names=["nid", "codes"])

    codes = nodes.select("nid", "vec").mapInArrow(run, "nid long, codes array<long>")
    codes = codes.select("nid", F.posexplode("codes").alias("t", "code")).join(nodes.select("nid", "grp", "bits"), "nid").where("bits > 0 OR t = 0")
    own = F.expr("code & (shiftleft(1L, bits) - 1L)")
    keyed = scratch.table(codes.select("nid", F.xxhash64("grp", "t", own).alias("key")), "buckets")
    sizes = keyed.groupBy("key").agg(F.ceil(F.count("*") / CHUNK_ROWS).alias("n")).where("n > 1")
    chunk = F.pmod(F.xxhash64("nid", "key"), F.coalesce("n", F.lit(1)))
    return keyed.join(sizes, "key", "left").select(F.xxhash64("key", chunk).alias("key"), "nid").join(nodes.select("nid", "vec"), "nid").select("key", "nid", "vec")


def _bucket_graph(nodes: DataFrame, dtype: str, k: int, most_bits: int, seed: int, scratch: Scratch) -> DataFrame:
    dealt = _buckets(nodes, dtype, most_bits, seed, scratch).repartition("key").sortWithinPartitions("key", "nid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for t in _groups(batches, 4 * CHUNK_ROWS):
            if t.num_rows > 1:
                ids, x = t.column(1).to_numpy(), _unit(t.column(2), dtype)
                s = x @ x.T
                np.fill_diagonal(s, -2)
                m = min(k, len(ids) - 1)
                best = np.argpartition(-s, m - 1, axis=1)[:, :m]
                found.append((np.repeat(ids, m), ids[best].ravel(), np.take_along_axis(s, best, 1).ravel()))
            if len(found) >= 500:
                yield _emit(found)
                found = []
        yield _emit(found)

    return dealt.mapInArrow(run, _EDGE)


def _best(edges: DataFrame, long: DataFrame, k: int, most: int) -> DataFrame:
    """The k most similar neighbours of each node, `most` of those in `long` (u)."""
    order = Window.partitionBy("u").orderBy(F.desc("sim"), "v")
    one = edges.groupBy("u", "v").agg(F.max("sim").alias("sim"))
    ranked = one.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    return ranked.join(long.select("u", F.lit(True).alias("long")), "u", "left").where((F.col("n") <= k) | F.col("long")).select("u", "v", "sim")


def _saturated(graph: DataFrame, k: int, threshold: float) -> DataFrame:
    """(u): nodes whose list is full of links."""
    return graph.where(F.col("sim") >= threshold).groupBy("u").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("u")


def _improved(graph: DataFrame, nodes: DataFrame, dtype: str, k: int) -> DataFrame:
    """One round: candidates from the nodes around each node, forward and backward, better than what they have."""
    worst = graph.groupBy("u").agg(F.when(F.count("*") >= k, F.min("sim")).otherwise(-2.0).alias("worst"))
    info = nodes.select("nid", "vec").join(worst.withColumnRenamed("u", "nid"), "nid", "left").withColumn("worst", F.coalesce("worst", F.lit(-2.0)))
    around = graph.select(F.col("u").alias("w"), F.col("v").alias("nid")).union(graph.select("v", "u")).distinct()
    degree = around.groupBy("w").agg(F.ceil(F.count("*") / JOIN_ROWS).alias("n"))
    around = around.join(degree, "w").select(F.xxhash64("w", F.pmod(F.xxhash64("nid"), F.col("n"))).alias("w"), "nid")
    dealt = around.join(info, "nid").select("w", "nid", "vec", "worst").repartition("w").sortWithinPartitions("w", "nid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for t in _groups(batches, 4 * JOIN_ROWS):
            if t.num_rows > 1:
                ids, x, worst = t.column(1).to_numpy(), _unit(t.column(2), dtype), t.column(3).to_numpy()
                s = x @ x.T
                np.fill_diagonal(s, -3)
                i, j = np.nonzero(s > worst[:, None])
                found.append((ids[i], ids[j], s[i, j]))
            if len(found) >= 2000:
                yield _emit(found)
                found = []
        yield _emit(found)

    return dealt.mapInArrow(run, _EDGE)


def _descent(nodes: DataFrame, dtype: str, most_bits: int, attempt: int, threshold: float, graph: DataFrame | None, scratch: Scratch) -> DataFrame:
    """Adds a bucket graph to `graph` and runs rounds until few lists change; saturated lists are twice as long, and doubled in each attempt."""
    n, k, most = nodes.count(), NEIGHBOURS, NEIGHBOURS << (attempt + 1)
    found = _bucket_graph(nodes, dtype, k, most_bits, 11 + attempt, scratch)
    found = scratch.table(found if graph is None else found.union(graph), "found")
    graph = scratch.table(_best(found, _saturated(found.distinct(), k, threshold), k, most), "graph")
    for _ in range(MAX_ROUNDS):
        better = graph.union(_improved(graph, nodes, dtype, k))
        better = scratch.table(_best(better, _saturated(graph, k, threshold), k, most), "graph")
        changed = better.join(graph, ["u", "v"], "left_anti").count()
        graph = better
        if changed <= SETTLED * n * k:
            break
    return graph


def _linked(graph: DataFrame, nodes: DataFrame, dtype: str, threshold: float, scratch: Scratch) -> DataFrame:
    """(nid, component, links, linked_rows): links inside each component, by comparing its blocks."""
    near = graph.where(F.col("sim") >= threshold).select("u", "v")
    parts = scratch.table(components(near, scratch).select(F.col("node").alias("nid"), "component"), "parts")
    blocks = parts.groupBy("component").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("n"))
    x = F.pmod(F.xxhash64("nid"), F.col("n")).cast("int")
    rows = parts.join(blocks, "component").join(nodes.select("nid", "vec", "rows"), "nid")
    rows = rows.select("component", "nid", "vec", "rows", x.alias("x"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("y"))
    key = F.xxhash64("component", F.least("x", "y"), F.greatest("x", "y")).alias("key")
    dealt = rows.select(key, "nid", "vec", "rows", "x", (F.col("x") == F.col("y")).alias("own")).repartition("key").sortWithinPartitions("key", "x", "nid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            ids, unit, rows, block = t.column(1).to_numpy(), _unit(t.column(2), dtype), t.column(3).to_numpy(), t.column(4).to_numpy()
            hit = unit @ unit.T >= threshold
            np.fill_diagonal(hit, False)
            if not t.column(5)[0].as_py():  # two blocks: only what lies between them
                hit &= block[:, None] != block[None, :]
            arrays = [pa.array(ids), pa.array(hit.sum(1).astype(np.int64)), pa.array((hit @ rows).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, names=["nid", "links", "linked_rows"])

    counts = dealt.mapInArrow(run, "nid long, links long, linked_rows long").groupBy("nid").agg(F.sum("links").alias("links"), F.sum("linked_rows").alias("linked_rows"))
    return parts.join(counts, "nid")


def _recall(nodes: DataFrame, linked: DataFrame, dtype: str, threshold: float) -> float:
    """The share found of all links of a bounded set of nodes, compared with every node: the least over the classes of label sizes."""
    order = Window.partitionBy("bits").orderBy(F.xxhash64("nid", F.lit("audit")), "nid")
    sample = nodes.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= AUDIT_QUERIES)
    sample = sample.join(linked.select("nid", "links"), "nid", "left").select("nid", "grp", "bits", "vec", F.coalesce("links", F.lit(0)).alias("links")).collect()
    by_group: dict[int, tuple[list[int], np.ndarray]] = {}
    for grp in {r["grp"] for r in sample}:
        own = [r for r in sample if r["grp"] == grp]
        by_group[grp] = ([r["nid"] for r in own], _unit(pa.array([bytes(r["vec"]) for r in own], pa.binary()), dtype))
    shared = nodes.sparkSession.sparkContext.broadcast(by_group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches:
            grp = batch.column(0).to_numpy()
            for g in np.unique(grp).tolist():
                if g in shared.value:
                    ids, queries = shared.value[g]
                    mine = batch.filter(pa.array(grp == g))
                    hit = _unit(mine.column(2), dtype) @ queries.T >= threshold
                    n = int((hit & (mine.column(1).to_numpy()[:, None] != np.array(ids)[None, :])).sum())
                    bits = mine.column(3)[0].as_py()
                    total[bits] = total.get(bits, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())], names=["bits", "n"])

    true = {r[0]: r[1] for r in nodes.select("grp", "nid", "vec", "bits").mapInArrow(run, "bits int, n long").groupBy("bits").agg(F.sum("n")).collect()}
    have: dict[int, int] = {}
    for r in sample:
        have[r["bits"]] = have.get(r["bits"], 0) + r["links"]
    return min((have.get(b, 0) / n for b, n in true.items() if n), default=1.0)


def near_vectors(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id (smallest id reachable by links), kept.

    Vectors that are null, empty, zero, without a label or hold null or non-finite components have no
    links. Vectors of different lengths don't link. Fails if the audit finds a recall under LEAST_RECALL. Equal vectors of a label link with each other; so do
    repeated rows. A null id is a component's id only if it has no other. Other columns are not read.
    """
    scratch = Scratch(rows.sparkSession, "vectors")
    dtype = "<f8" if "double" in rows.schema["embedding"].dataType.simpleString() else "<f4"
    group: Column = F.xxhash64("label", F.octet_length("vec"))
    all_rows = _vectors(rows, dtype).withColumn("grp", F.when(F.col("vec").isNotNull(), group))
    all_rows = scratch.table(all_rows.withColumn("nid", F.when(F.col("vec").isNotNull(), F.xxhash64("grp", "vec"))), "rows")
    nodes = all_rows.where("vec IS NOT NULL").groupBy("nid", "grp", "vec").agg(F.count("*").alias("rows"), F.min("vec_id").alias("least"))
    sizes = nodes.groupBy("grp").agg(F.count("*").alias("n"))
    bits = F.when(F.col("n") <= CHUNK_ROWS, 0).otherwise(F.ceil(F.log2(F.col("n") / BUCKET_ROWS))).cast("int").alias("bits")
    nodes = scratch.table(scratch.table(nodes, "distinct").join(sizes.select("grp", bits), "grp"), "nodes")
    most_bits = max(1, nodes.agg(F.max("bits")).first()[0] or 0)
    graph = None
    for audit in range(MAX_AUDITS):
        graph = _descent(nodes, dtype, most_bits, audit, threshold, graph, scratch)
        linked = scratch.table(_linked(graph, nodes, dtype, threshold, scratch), "linked")
        recall = _recall(nodes, linked, dtype, threshold)
        if recall >= GOOD_RECALL:
            break
    if recall < LEAST_RECALL:
        raise RuntimeError(f"the audit found {recall:.3f} of the links after {MAX_AUDITS} rounds of buckets")
    found = nodes.select("nid", "rows", "least").join(linked, "nid", "left").withColumn("component", F.coalesce("component", "nid"))
    firsts = found.groupBy("component").agg(F.min("least").alias("component_id"))
    found = found.join(firsts, "component").select("nid", (F.coalesce("linked_rows", F.lit(0)) + F.col("rows") - 1).alias("n_links"), "component_id")
    out = all_rows.select("vec_id", "nid").join(found, "nid", "left")
    component = F.when(F.col("nid").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
