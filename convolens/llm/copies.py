"""Near copies of documents: links of an exact Jaccard similarity of five-word shingles of at least 0.8.

SimHash can't find all of these pairs by its index: at a similarity of 0.8 about ten of 64 bits differ, and blocks
that a radius of that width leaves whole are too short to deal by. So the pairs come from MinHash bands; the
pipeline adds the links that SimHash finds (`simhash.text_links`), and components are those of both.

1. Each text's shingles are hashed once, and 100 minima of them into 20 bands of 5.
2. Texts that share a band are candidate pairs; their texts are fetched by a second pass, which a bitmap
   filters, and the pairs are compared by exact Jaccard similarity (`similar`).
3. Distributed union-find over the verified links; of each component the smallest id stays.

A text is identified by two 64-bit hashes, one in a link by the first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh
from .components import components
from .lines import bitmap, marked
from .similar import Measure, nested, similar_parts, standing

SHINGLE_WORDS, SIMILARITY = 5, 0.8
#: A pair at the threshold shares a band with probability 1 - (1 - 0.8**5)**20 = 0.9996.
BANDS, ROWS = 20, 5
BINS = BANDS * ROWS
_SLICE = 2048
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)
_ODD = np.random.default_rng(11).integers(0, 1 << 63, BINS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of `size` words (of all words if they are fewer; no words: one hash)."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), 1)], np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        h = w[: len(w) - size + 1]
        for k in range(1, size):
            h = (h ^ (h >> np.uint64(31))) * _BASE + w[k : len(w) - size + 1 + k]
        h = (h ^ (h >> np.uint64(29))) * _MIX
    return np.unique(h ^ (h >> np.uint64(32)))


def minima(own: np.ndarray) -> np.ndarray:
    """BINS minima of a text's shingles, each in an order of its own."""
    out = np.full(BINS, 0xFFFFFFFF, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(own), _SLICE):
            h = own[None, at : at + _SLICE] * _ODD[:, None]
            h ^= h >> np.uint64(29)
            h *= _MIX
            np.minimum(out, h.min(1) >> np.uint64(32), out=out)
    return out.astype(np.uint32)


def bands(bins: np.ndarray) -> np.ndarray:
    """A 64-bit key for each text and band."""
    with np.errstate(over="ignore"):
        key = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[None, :], len(bins), 0)
        for r in range(ROWS):
            key = (key ^ bins[:, r::ROWS].astype(np.uint64)) * _MIX
            key ^= key >> np.uint64(31)
    return key.view(np.int64)


MEASURE = Measure(lambda texts: [shingles(t) for t in texts], lambda sets: bands(np.array([minima(s) for s in sets], np.uint32).reshape(-1, BINS)), SIMILARITY)


def _signed(docs: DataFrame, text_col: str) -> DataFrame:
    """(h, chars, stands, shares) of each text, once for each batch; h: the text's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at = np.unique(batch.column(0).to_numpy(), return_index=True)
            texts = [x.as_py() for x in batch.column(1).take(pa.array(at))]
            bins = np.array([minima(shingles(t)) for t in texts], np.uint32).reshape(-1, BINS)
            keys = bands(bins)
            stands, shares = standing(keys)
            chars = pa.array([len(t or "") + 1 for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ids), chars, nested(keys, stands), nested(keys, shares)], names=["h", "chars", "stands", "shares"])

    return docs.select(F.xxhash64(text_col).alias("h"), text_col).mapInArrow(run, "h long, chars long, stands array<long>, shares array<long>")


def _texts(docs: DataFrame, text_col: str, wanted: np.ndarray) -> DataFrame:
    """(h, text) of the texts whose bit is set, once for each batch."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at = np.unique(batch.column(0).to_numpy(), return_index=True)
            yield batch.take(pa.array(at[marked(shared.value, ids)]))

    return docs.select(F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text")).mapInArrow(run, "h long, text string")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: DataFrame | None = None) -> DataFrame:
    """The rows of `docs`, all their columns, whose id is the smallest of its component of near copies.

    `more`: further links (a, b) between texts, by their hashes, that join components as the own ones do.

    Words are split at white space, A-Z counting as a-z; null, empty and blank texts are copies of each
    other. Rows that share the smallest id all stay; so do rows with a null id, which nothing identifies.
    """
    scratch = Scratch(docs.sparkSession, "copies")
    signed = scratch.table(_signed(docs, text_col), "signed")
    parts = similar_parts(signed, lambda wanted: _texts(docs, text_col, bitmap(wanted)), MEASURE, scratch)
    if more is not None:
        parts = components(scratch.table(parts.toDF("b", "a").select("a", "b").union(more.select("a", "b")), "all_links"), scratch)
    parts = parts.select(F.col("node").alias("h"), "component")
    tk = fresh(docs, "tk")[0]
    keyed = docs.withColumn(tk, F.xxhash64(text_col))
    places = keyed.select(F.col(id_col).alias("doc_id"), F.col(tk).alias("h"), F.xxhash64(F.lit(1), text_col).alias("g")).where("doc_id IS NOT NULL")
    part = (F.coalesce("component", "h").alias("part"), F.when(F.col("component").isNull(), F.col("g")).otherwise(0).alias("g"))
    places = scratch.table(places.join(parts, "h", "left").select("doc_id", "h", *part), "places")
    firsts = places.groupBy("part", "g").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")
    gone = places.join(firsts, ["part", "g"]).where("doc_id != first").select(F.col("doc_id").alias(id_col), F.col("h").alias(tk)).distinct()
    return keyed.join(scratch.table(gone, "gone"), [id_col, tk], "left_anti").select(docs.columns)
