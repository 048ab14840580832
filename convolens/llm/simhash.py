"""SimHash near-duplicates: fingerprints of word shingles, linked through BK-trees of shards.

Two fingerprints at most three bits apart agree in all but three of any b blocks of their bits. So each
fingerprint goes to one shard for each choice of b - 3 blocks, keyed by the bits in them: two that link
meet in at least one shard, and shards stay small. A shard's task builds a BK-tree (children keyed by
the Hamming distance to their parent) and follows only the edges that the radius allows. Shards are
dealt by shuffle and not broadcast: a broadcast tree would grow with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh, join_counted
from .components import components

RADIUS, SHINGLE_WORDS, SEED = 3, 3, 42
#: Fingerprints that one tree may hold before its shard is split by further bits.
SHARD_ROWS = 4096
_CHUNK = 1 << 16


def fingerprint(text: str | None) -> int:
    """Bit i is set if it is set in over half the shingle hashes; no words: 0."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda at, n: at + 1 + n))
    starts = [0, *(e + 1 for e in ends)]
    n = max(1, len(words) - SHINGLE_WORDS + 1)
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    last = ends[SHINGLE_WORDS - 1 :] or ends[-1:]
    for at in range(0, n, _CHUNK):
        hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[at : at + _CHUNK], last[at : at + _CHUNK])], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tk, fp) of each row; tk: its text's hash; fp: the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py()) for t in batch.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], names=["doc_id", "tk", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("tk"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"doc_id {kind}, tk long, fp long")


class BKTree:
    """Children keyed by integer Hamming distance to the parent."""

    def __init__(self, root: int):
        self.values, self.children = [root], [{}]

    def find_and_add(self, value: int, radius: int) -> list[int]:
        """Places of the stored values within `radius`; then stores `value`."""
        found, todo, values, children = [], [0], self.values, self.children
        while todo:
            at = todo.pop()
            d = (values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            below = children[at]
            if len(below) <= 2 * radius + 1:
                todo.extend(c for k, c in below.items() if -radius <= k - d <= radius)
            else:
                todo.extend(below[k] for k in range(max(1, d - radius), d + radius + 1) if k in below)
        at = 0
        while (d := (values[at] ^ value).bit_count()) in children[at]:
            at = children[at][d]
        children[at][d] = len(values)
        values.append(value)
        children.append({})
        return found


def spanning_links(values: list[int], radius: int = RADIUS) -> Iterator[tuple[int, int]]:
    """Links within `radius` between distinct values, without those that close a circle."""
    tree, parent = BKTree(values[0]), list(range(len(values)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for i, value in enumerate(values[1:], 1):
        for j in tree.find_and_add(value, radius):
            if (a := root(i)) != (b := root(j)):
                parent[a] = b
                yield values[j], value


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _block_masks(blocks: int) -> list[int]:
    edges = [64 * k // blocks for k in range(blocks + 1)]
    parts = [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(parts, blocks - RADIUS)]


#: The bits outside a mask, dealt in turn to RADIUS + 1 masks of their own.
_FOUR_PARTS = f"""transform(sequence(0, {RADIUS}), k -> aggregate(
    filter(filter(sequence(0, 63), i -> (shiftrightunsigned({{mask}}, i) & 1L) = 0), (bit, nth) -> nth % {RADIUS + 1} = k),
    0L, (sum, bit) -> sum | shiftleft(1L, bit)))"""


def _shards(prints: DataFrame, scratch: Scratch, shard_rows: int) -> DataFrame:
    """(fp, key): one row for each shard that a fingerprint goes to.

    Two prints of a shard over `shard_rows` still differ in at most RADIUS of the bits outside its mask.
    These are cut into four parts and the shard is split by each of them, again and again while it is too
    large: two prints that link agree in one part at least, at every level.
    """
    n = prints.count()
    blocks = next((b for b in (4, 5, 6) if n <= 64 << min(m.bit_count() for m in _block_masks(b))), 7)
    masks = F.explode(F.array(*(F.lit(_signed(m)).cast("long") for m in _block_masks(blocks))))
    keyed = prints.select("fp", masks.alias("mask")).select("fp", "mask", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"))
    done = []
    parts = F.expr(_FOUR_PARTS.format(mask="m"))
    while True:
        large = keyed.groupBy("key").agg(F.count("*").alias("n"), F.first("mask").alias("m")).where((F.col("n") > shard_rows) & (F.bit_count("m") <= 63 - RADIUS))
        large = scratch.table(large.select("key", parts.alias("parts")), "large")
        if large.isEmpty():
            return reduce(DataFrame.union, [*done, keyed.select("fp", "key")])
        done.append(keyed.join(large, "key", "left_anti").select("fp", "key"))
        again = keyed.join(large, "key").select("fp", "mask", F.col("key").alias("old"), F.explode("parts").alias("more"))
        again = again.select("fp", F.col("mask").bitwiseOR(F.col("more")).alias("mask"), "more", "old")
        keyed = scratch.table(again.select("fp", "mask", F.xxhash64("old", "more", F.col("fp").bitwiseAND(F.col("mask"))).alias("key")), "finer")


def links(prints: DataFrame, scratch: Scratch, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Links (a, b) between distinct fingerprints that join all that are at most RADIUS bits apart."""
    shards = _shards(prints, scratch, shard_rows).select("key", "fp")
    dealt = shards.repartition("key").sortWithinPartitions("key", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_key, rest = None, []
        for batch in batches:
            keys, values = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            if not len(keys):
                continue
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            edges = [0, *cuts.tolist(), len(keys)]
            out = []
            for lo, hi in zip(edges, edges[1:]):
                if keys[lo] != rest_key:
                    if len(rest) > 1:
                        out += spanning_links(rest)
                    rest_key, rest = keys[lo], []
                rest += values[lo:hi].tolist()
            yield _edges(out)
        if len(rest) > 1:
            yield _edges(list(spanning_links(rest)))

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["a", "b"])


def _grouped(docs: DataFrame, id_col: str, text_col: str, shard_rows: int) -> DataFrame:
    """(doc_id, tk, fp, component_id) of each row."""
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.table(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = scratch.table(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    linked = scratch.table(components(scratch.table(links(distinct.select("fp"), scratch, shard_rows), "links"), scratch), "linked")
    members = linked.join(distinct, linked["node"] == distinct["fp"]).select("fp", "component", "least")
    groups = members.join(members.groupBy("component").agg(F.min("least").alias("group")), "component").select("fp", "group")
    groups = scratch.table(groups, "groups")
    firsts = distinct.join(groups, "fp", "left").select("fp", F.coalesce("group", "least").alias("component_id"))
    return prints.join(firsts, "fp")


def text_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Links (a, b) between texts, by their hashes: the texts of each component of fingerprints as a star around its least."""
    scratch = Scratch(docs.sparkSession, "simhash")
    texts = scratch.table(fingerprints(docs, id_col, text_col).select("tk", "fp").distinct(), "texts")
    linked = components(scratch.table(links(scratch.table(texts.select("fp").distinct(), "distinct"), scratch, shard_rows), "links"), scratch)
    parts = scratch.table(texts.join(linked, texts["fp"] == linked["node"], "left").select("tk", F.coalesce("component", "fp").alias("part")), "parts")
    counted = scratch.table(parts.groupBy("part").agg(F.count("*").alias("n"), F.min("tk").alias("least")).where("n > 1"), "counted")
    return join_counted(parts, counted, ["part"]).where("tk != least").select(F.col("least").alias("a"), F.col("tk").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex), component_id (smallest id reachable by links).

    A null, empty or blank text has fingerprint 0 and links like any other. Repeated rows keep a row
    each. A null id keeps its row; it is a component's id only if no other id is there. An empty table
    gives no rows. Columns beside the id and text are not read.
    """
    return _grouped(docs, id_col, text_col, shard_rows).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all their columns, whose id is the smallest of their near-duplicate component.

    A row is known by its id and text: of several texts under one id each goes or stays by its own
    component. Rows of a component that share its smallest id all stay; so do rows with a null id.
    """
    tk = fresh(docs, "tk")[0]
    gone = _grouped(docs, id_col, text_col, SHARD_ROWS).where("doc_id != component_id").select(F.col("doc_id").alias(id_col), F.col("tk").alias(tk)).distinct()
    return docs.withColumn(tk, F.xxhash64(text_col)).join(gone, [id_col, tk], "left_anti").select(docs.columns)
