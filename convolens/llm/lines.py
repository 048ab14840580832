"""Line dedup: near-equal lines by MinHash, one line kept of each component.

1. Each document is split into lines once. A line's character shingles are hashed into bins (one
   permutation, empty bins filled from others), and the bins into bands.
2. Lines that share a band are candidate pairs. The texts of these lines are fetched by a second pass, which
   a bitmap of their hashes filters, and the pairs are compared by exact Jaccard similarity (`similar`).
3. Distributed union-find over the verified links; the first line of each component stays.

A line is identified by a 128-bit hash of its text, one in a link by the first half of it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh, join_counted, replaced
from .similar import Measure, nested, similar_parts, standing

SHINGLE_CHARS, SIMILARITY = 8, 0.8
#: A pair at the threshold shares a band with probability 1 - (1 - 0.8**4)**10 = 0.995.
BANDS, ROWS = 10, 4
BINS = BANDS * ROWS
#: Bits of the map of candidate lines: 16 a line within these bounds.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 27
_SEGMENT = 1 << 19
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)
_EMPTY = np.uint32(0xFFFFFFFF)


def normal(line: str) -> str:
    return " ".join(line.split())


def line_hashes(lines: list[str]) -> np.ndarray:
    """Two signed 64-bit numbers for each normal line."""
    made = b"".join([xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for x in lines])
    return np.frombuffer(made, "<i8").reshape(-1, 2)


def _hashed(lines: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of all character shingles and the places of their lines, in slices of bounded size."""
    part, owners, size, k = [], [], 0, SHINGLE_CHARS

    def flush() -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(p) for p in part])
        h = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        step, scale = 1, _BASE
        while step < k:  # k is a power of two
            h = h[:-step] * scale + h[step:]
            step, scale = step * 2, scale * scale
        last = np.repeat(np.cumsum(lengths), lengths)[: len(h)] - k
        good = np.arange(len(h)) <= last
        h = (h[good] ^ (h[good] >> np.uint64(29))) * _MIX
        h ^= h >> np.uint64(32)
        h *= _MIX
        return h, np.repeat(np.array(owners), lengths - (k - 1))

    with np.errstate(over="ignore"):
        for i, line in enumerate(lines):
            for at in range(0, max(1, len(line) - k + 1), _SEGMENT):
                piece = line[at : at + _SEGMENT + k - 1].ljust(k, "\0")
                part.append(piece)
                owners.append(i)
                size += len(piece)
                if size >= _SEGMENT:
                    yield flush()
                    part, owners, size = [], [], 0
        if part:
            yield flush()


def shingles(lines: list[str]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each line."""
    own: list[list[np.ndarray]] = [[] for _ in lines]
    for h, owner in _hashed(lines):
        edges = [0, *(np.flatnonzero(owner[1:] != owner[:-1]) + 1).tolist(), len(h)]
        for a, b in zip(edges, edges[1:]):
            own[owner[a]].append(h[a:b])
    return [np.unique(x[0] if len(x) == 1 else np.concatenate(x)) for x in own]


def _bins(parts: Iterable[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """BINS minima of each of n lines' shingle hashes."""
    out = np.full(n * BINS, _EMPTY, np.uint32)
    for h, owner in parts:
        slot = owner * BINS + (((h >> np.uint64(40)) * np.uint64(BINS)) >> np.uint64(24)).astype(np.int64)
        np.minimum.at(out, slot, (h & np.uint64(0xFFFFFFFE)).astype(np.uint32))
    return _filled(out.reshape(-1, BINS))


def _filled(bins: np.ndarray) -> np.ndarray:
    """Empty bins take the value of another, tried in an order that depends on the bin alone."""
    order = np.random.default_rng(7)
    out = bins.copy()
    row, col = np.nonzero(out == _EMPTY)
    for _ in range(24):
        if not len(row):
            break
        out[row, col] = bins[row, order.integers(0, BINS, BINS)[col]]
        still = out[row, col] == _EMPTY
        row, col = row[still], col[still]
    if len(row):
        out[row, col] = bins.min(1)[row]
    return out


def bands(bins: np.ndarray) -> np.ndarray:
    """A 64-bit key for each line and band."""
    with np.errstate(over="ignore"):
        key = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[None, :], len(bins), 0)
        for r in range(ROWS):
            key = (key ^ bins[:, r::ROWS].astype(np.uint64)) * _MIX
            key ^= key >> np.uint64(31)
    return key.view(np.int64)


def _band_keys(sets: list[np.ndarray]) -> np.ndarray:
    return bands(_bins([(np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets]))] if sets else [], len(sets)))


MEASURE = Measure(shingles, _band_keys, SIMILARITY)


def _read_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, tk, n_lines, lines): the lines of each document that are not blank.

    Keys are given at the first place of a line in its batch only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index: dict[str, int] = {}
            at, nos, edges, counts = [], [], [0], []
            for text in batch.column(2).to_pylist():
                parts = text.split("\n") if text else []
                for no, line in enumerate(parts):
                    if line := normal(line):
                        at.append(index.setdefault(line, len(index)))
                        nos.append(no)
                edges.append(len(at))
                counts.append(len(parts))
            lines, place = list(index), np.array(at, np.int64)
            hashes = line_hashes(lines)
            keys = bands(_bins(_hashed(lines), len(lines)))
            stands, shares = standing(keys)
            new = np.zeros(len(place), bool)
            new[np.unique(place, return_index=True)[1]] = True  # a line's first place; the others carry no keys
            fields = [
                pa.array(hashes[place, 0]),
                pa.array(hashes[place, 1]),
                pa.array(nos, pa.int32()),
                pa.array(np.array([len(x) for x in lines], np.int64)[place]),
                nested(keys[place], stands[place] & new[:, None]),
                nested(keys[place], shares[place] & new[:, None]),
            ]
            found = pa.StructArray.from_arrays(fields, ["h", "g", "no", "chars", "stands", "shares"])
            found = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), found)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), found], names=["doc_id", "tk", "n_lines", "lines"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, tk long, n_lines long, lines array<struct<h:long,g:long,no:int,chars:long,stands:array<long>,shares:array<long>>>"
    source = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("tk"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, schema)


def bitmap(ids: DataFrame, bits: int | None = None) -> np.ndarray:
    """A bit for each residue of `h`: 16 for each row within the bounds, or as many as given; a power of two."""
    if bits is None:
        bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * ids.count()).bit_length()))
    place = (F.pmod("h", F.lit(bits)) + 1).alias("p")
    parts = ids.select(place).groupBy(F.bitmap_bucket_number("p").alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for r in parts.collect():
        out[(r["n"] - 1) * 4096 : r["n"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def marked(wanted: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of `h` have their bit set."""
    place = h & (8 * len(wanted) - 1)
    return (wanted[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def _texts(docs: DataFrame, text_col: str, wanted: np.ndarray) -> DataFrame:
    """(h, text) of the lines whose bit is set, once for each batch."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = list(dict.fromkeys(x for t in batch.column(0).to_pylist() if t for x in map(normal, t.split("\n")) if x))
            h = line_hashes(lines)[:, 0]
            found = marked(shared.value, h)
            yield pa.RecordBatch.from_arrays([pa.array(h[found]), pa.array([lines[i] for i in np.flatnonzero(found)], pa.string())], names=["h", "text"])

    return docs.select(text_col).mapInArrow(run, "h long, text string")


def _dropped(docs: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The documents with their lines; (doc_id, tk, dropped): the numbers of lines to drop."""
    read = scratch.table(_read_lines(docs, id_col, text_col), "lines")
    lines = read.select(F.explode("lines").alias("x")).select("x.h", "x.chars", "x.stands", "x.shares")
    parts = similar_parts(lines, lambda wanted: _texts(docs, text_col, bitmap(wanted)), MEASURE, scratch)
    parts = parts.select(F.col("node").alias("h"), "component")
    places = read.select("doc_id", "tk", F.explode("lines").alias("x")).select("doc_id", "tk", "x.h", "x.g", "x.no")
    lone = F.col("component").isNull()
    places = places.join(parts, "h", "left").select("doc_id", "tk", "no", F.coalesce("component", "h").alias("part"), F.when(lone, F.col("g")).otherwise(0).alias("g"))
    places = scratch.table(places, "places")
    counted = places.groupBy("part", "g").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")
    several = scratch.table(join_counted(places, scratch.table(counted, "counted"), ["part", "g"]), "several")
    keep = several.where("doc_id <=> first").groupBy("part", "g").agg(F.min(F.struct("tk", "no")).alias("keep"), F.max("n").alias("n"))
    gone = join_counted(several.drop("n"), scratch.table(keep, "keep"), ["part", "g"]).where("NOT (doc_id <=> first AND tk = keep.tk AND no = keep.no)")
    return read, gone.groupBy("doc_id", "tk").agg(F.array_sort(F.collect_set("no")).alias("dropped"))


def duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, dropped (numbers of its lines that go, from 0).

    Of each component of similar lines the first stays: the smallest id, then the first line. Lines of
    white space alone are never dropped. A null or empty text has no lines. Rows equal in id and text
    count as one document and get the same row each; null ids come last. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    read, gone = _dropped(docs, id_col, text_col, scratch)
    gone = gone.select(F.col("doc_id").alias("i"), F.col("tk").alias("t"), "dropped")
    joined = read.join(gone, read["doc_id"].eqNullSafe(gone["i"]) & (read["tk"] == gone["t"]), "left")
    dropped = F.coalesce("dropped", F.array().cast("array<int>"))
    return joined.select("doc_id", "n_lines", F.size(dropped).cast("long").alias("n_dropped"), dropped.alias("dropped"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs`, all their columns, without the duplicate lines; a document that loses all its lines goes."""
    scratch = Scratch(docs.sparkSession, "lines")
    tk, gone_id, gone_tk, gone_no = fresh(docs, "tk", "gone_id", "gone_tk", "gone_no")
    gone = scratch.table(_dropped(docs, id_col, text_col, scratch)[1].toDF(gone_id, gone_tk, gone_no), "dropped")
    keyed = docs.withColumn(tk, F.xxhash64(text_col))
    joined = keyed.join(gone, F.col(id_col).eqNullSafe(F.col(gone_id)) & (F.col(tk) == F.col(gone_tk)), "left").select(*docs.columns, gone_no)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep = [], []
            for text, no in zip(batch.column(text_col).to_pylist(), batch.column(gone_no).to_pylist()):
                if no:
                    gone = set(no)
                    text = "\n".join([x for i, x in enumerate(text.split("\n")) if i not in gone])
                keep.append(not no or bool(text.strip()))
                texts.append(text)
            out = replaced(batch, text_col, texts).drop_columns([gone_no])
            yield out.filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(run, docs.schema)
