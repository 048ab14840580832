"""Benchmark decontamination: Wu-Manber multi-pattern search over word sequences.

The patterns are the test windows (runs of ten words of a benchmark item). A shift table on blocks of
two words tells how far the search may jump; a block that ends some window selects a bucket by the
window's suffix, and a direct comparison confirms. Documents are scanned whole, where they lie: no
document text is shuffled. The windows go to the driver and the tasks in blocks of bounded size; a benchmark
with more windows is searched block by block. The hits of each pass but the last are written by the text's
hashes and joined to the rows of the last one.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, Scratch

WINDOW_WORDS = 10
#: Windows that one pass holds (some 20 MB on the driver, 60 MB as tables in a task).
BLOCK_WINDOWS = 100_000
#: Word characters in UTF-8: 0-9, a-z (A-Z as a-z) and all bytes over 0x7F; every other byte separates.
_TABLE = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_SQL_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


class WuManber:
    """Finds all occurrences of word patterns of one length."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], list[str]]):
        self.m, self.b = length, min(2, length)
        self.far = self.m - self.b + 1
        self.shift: dict = {}
        self.buckets: dict = {}
        for pattern, ids in patterns.items():
            for end in range(self.b, self.m + 1):
                block = pattern[end - self.b : end]
                self.shift[block] = min(self.shift.get(block, self.far), self.m - end)
            self.buckets.setdefault(pattern[self.m - self.b :], []).append((pattern, ids))

    def find(self, words: list[bytes]) -> Iterator[tuple[int, list[str]]]:
        """(start, ids) of every occurrence, overlapping ones too."""
        m, b, far, shift, at = self.m, self.b, self.far, self.shift.get, self.m - 1
        while at < len(words):
            jump = shift(tuple(words[at - b + 1 : at + 1]), far)
            if jump:
                at += jump
                continue
            found = tuple(words[at - m + 1 : at + 1])
            for pattern, ids in self.buckets.get(found[m - b :], ()):
                if pattern == found:
                    yield at - m + 1, ids
            at += 1


class Scanner:
    """Searches documents for one block of windows: (item id, words) pairs."""

    def __init__(self, windows: list[tuple[str, list[str]]]):
        self.windows = windows
        self.machines: list[WuManber] | None = None

    def hits(self, words: list[bytes]) -> list[tuple[int, int, str]]:
        """(start, end, item id) of every occurrence."""
        if self.machines is None:  # in the task: the tables are not sent
            by_length: dict[int, dict[tuple[bytes, ...], list[str]]] = {}
            for item, window in self.windows:
                key = tuple(w.encode() for w in window)
                by_length.setdefault(len(key), {}).setdefault(key, []).append(item)
            self.machines = [WuManber(n, p) for n, p in sorted(by_length.items())]
        return [(s, s + x.m, i) for x in self.machines for s, ids in x.find(words) for i in ids]


def windows_of(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The distinct test windows: item (string; a null id is ''), words (array)."""
    words = F.regexp_extract_all(F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER), F.lit(_SQL_WORD), F.lit(0))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - (WINDOW_WORDS - 1)))
    return (
        benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), words.alias("words"))
        .where(F.size("words") > 0)
        .select("item", "words", F.explode(starts).alias("at"))
        .select("item", F.slice("words", F.col("at"), F.lit(WINDOW_WORDS)).alias("words"))
        .distinct()
    )


def scanners(benchmark: DataFrame, scratch: Scratch, item_col: str = "item_id", text_col: str = "text", block_windows: int = BLOCK_WINDOWS) -> Iterator[tuple[Scanner, bool]]:
    """One scanner after another, each for a block of at most about `block_windows` windows; whether it is the last."""
    windows = scratch.table(windows_of(benchmark, item_col, text_col), "windows")
    blocks = max(1, math.ceil(windows.count() / block_windows))
    part = F.pmod(F.xxhash64("item", F.to_json("words")), F.lit(blocks))
    for k in range(blocks):
        yield Scanner([(r[0], r[1]) for r in windows.where(part == k).collect()]), k == blocks - 1


_HITS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("item", pa.string())]))
_HITS_SQL = "array<struct<start:int,end:int,item:string>>"


def _scanned(docs: DataFrame, scan: Scanner) -> DataFrame:
    """(doc_id, h, g, n_words, hits) of each row of `docs` (doc_id, text); h and g: its text's hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, hits = [], []
            for text in batch.column(3):
                words = words_of(text.as_py())
                n_words.append(len(words))
                hits.append([{"start": s, "end": e, "item": x} for s, e, x in scan.hits(words)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n_words, pa.int64()), pa.array(hits, _HITS)], names=["doc_id", "h", "g", "n_words", "hits"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("g"), "text")
    return source.mapInArrow(run, f"doc_id {kind}, h long, g long, n_words long, hits {_HITS_SQL}")


def covered(spans: list[tuple[int, int]]) -> int:
    """Words inside any of the spans."""
    total, end = 0, 0
    for s, e in sorted(spans):
        total += max(0, e - max(s, end))
        end = max(end, e)
    return total


_REPORT = "doc_id {id}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """One row per document: its words, the words inside any occurrence of a test window, the items.

    A null or empty text has no words; a benchmark without words hits nothing; repeated documents and
    ids each keep their row; repeated items count once; columns beside the id and text are not read.
    """
    scratch = Scratch(docs.sparkSession, "windows")
    kind = docs.schema[id_col].dataType.simpleString()
    docs, earlier = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), []
    for scan, last in scanners(benchmark, scratch, text_col=text_col, block_windows=block_windows):
        rows = _scanned(docs, scan)
        if not last:  # each text's hits once; the texts themselves stay where they are
            found = rows.where(F.size("hits") > 0).select("h", "g", "hits").dropDuplicates(["h", "g"])
            earlier.append(scratch.table(found, "hits"))
    if earlier:
        found = reduce(DataFrame.union, earlier).groupBy("h", "g").agg(F.flatten(F.collect_list("hits")).alias("more"))
        rows = rows.join(found, ["h", "g"], "left").withColumn("hits", F.concat("hits", F.coalesce("more", F.array().cast(_HITS_SQL))))

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for hits in batch.column(2).to_pylist():
                items = sorted({h["item"] for h in hits})
                n_hit = covered([(h["start"], h["end"]) for h in hits]) if hits else 0
                out.append((n_hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), n_hit > 0))
            columns = zip(*out) if out else ([], [], [], [])
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.bool_())
            arrays = [batch.column(0), batch.column(1), *(pa.array(list(c), type=t) for c, t in zip(columns, kinds))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return rows.select("doc_id", "n_words", "hits").mapInArrow(report, _REPORT.format(id=kind))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The rows of `docs`, all their columns, that hold no test window. A null text is kept."""
    scratch = Scratch(docs.sparkSession, "windows")
    for scan, last in scanners(benchmark, scratch, block_windows=block_windows):

        def clean(batches: Iterator[pa.RecordBatch], scan: Scanner = scan) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = [not scan.hits(words_of(t.as_py())) for t in batch.column(text_col)]
                yield batch.filter(pa.array(keep, type=pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
        if not last:  # one block is in the tasks at a time
            docs = scratch.table(docs, "clean")
    return docs
