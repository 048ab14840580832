"""Packing: documents into sequences of fixed capacity, shortest-pack-first over the length histogram.

A document's ids are cut into full pieces and one shorter rest. Only the histogram of piece lengths (at
most `capacity` rows) reaches the driver, which places lengths longest first, each into the patterns
that are shortest so far, and counts the packs of each pattern. The patterns go back to the pieces as a
small table of rank intervals per length; a piece's rank within its length is numbered in blocks, so no
length is gathered in one task.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

CAPACITY = 1024
#: Pieces of one length that one task ranks.
BLOCK_ROWS = 4096
#: Chunks of text whose ids a worker remembers.
MEMO = 800_000


#: White space that a text cut at spaces and line ends must not hold, and ASCII signs but the apostrophe.
_OTHER_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
_SIGNS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves, the others as letters from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Encoder:
    """Token ids of texts, equal to the tokenizer's, each distinct chunk being encoded once.

    The byte-level pattern never joins characters across a single space or line end between two visible
    ones, so such a text can be cut there and its ids are those of its chunks. A chunk of letters, and the
    signs behind it, are encoded by the vocabulary's model directly. Texts with other white space, or with
    a special token's string, and vocabularies with another pattern go to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, made = self.tokenizer.model, json.loads(self.tokenizer.to_str())
        cut = made["pre_tokenizer"] or {}
        self.cuts = made["normalizer"] is None and made["model"]["type"] == "BPE" and (cut.get("type"), cut.get("add_prefix_space"), cut.get("use_regex", True)) == ("ByteLevel", False, True)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = _byte_letters()
        self.memo: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _part(self, part: str) -> bytes:
        """The ids of a part that the pattern doesn't cut."""
        if (found := self.memo.get(part)) is None:
            ids = [t.id for t in self.model.tokenize(part.encode().decode("latin-1").translate(self.letters))]
            self.memo[part] = found = np.array(ids, "<u4").tobytes()
        return found

    def _learn(self, chunk: str) -> bytes:
        core = chunk.rstrip(_SIGNS)
        if (core[1:] if core[:1] == " " else core).isalpha():
            found = self._part(core)
            if len(core) < len(chunk):
                self.memo[chunk] = found = found + self._part(chunk[len(core) :])
            return found
        self.memo[chunk] = found = self.whole(chunk)
        return found

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        memo = self.memo
        for text in texts:
            if not self._plain(text):
                yield self.whole(text) if text else b""
                continue
            chunks = text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
            found = list(map(memo.get, chunks))
            if None in found:
                if len(memo) > MEMO:
                    memo.clear()
                for i, x in enumerate(found):
                    if x is None:
                        found[i] = memo.get(chunks[i]) or self._learn(chunks[i])
            yield b"".join(found)

    def _plain(self, text: str) -> bool:
        if not self.cuts or "\0" in text or "  " in text or " \n" in text or "\n " in text or "\n\n" in text:
            return False
        return not any(s in text for s in self.special) and not any(c in text for c in _OTHER_SPACE)


_ENCODERS: dict[str, Encoder] = {}

_PIECES = pa.schema([("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): each document's ids and `end_id`, cut into pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get(tokenizer) or _ENCODERS.setdefault(tokenizer, Encoder(tokenizer))
        tail = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            at, rows = [], []
            for i, ids in enumerate(encoder.encode([t.as_py() or "" for t in batch.column(1)])):
                ids += tail
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    part = ids[4 * start : 4 * (start + capacity)]
                    at.append(i)
                    rows.append((start, len(part) // 4, zlib.crc32(part), n))
            columns = list(zip(*rows)) if rows else [[], [], [], []]
            arrays = [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, pa.int64()) for c in columns)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *_PIECES.names])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def pack_histogram(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, packs) pairs that hold all lengths: longest first, each into the shortest packs with room."""
    room: dict[int, list[list]] = {}  # by the total so far: [pattern, packs]
    totals: list[int] = []
    for length in sorted((n for n in histogram if histogram[n]), reverse=True):
        left = histogram[length]
        moved: list[tuple[int, list]] = []
        while left and totals and totals[0] + length <= capacity:
            entries = room[totals[0]]
            pattern, packs = entries[-1]
            take = min(packs, left)
            left -= take
            if take == packs:
                entries.pop()
                if not entries:
                    del room[heappop(totals)]
            else:
                entries[-1][1] -= take
            moved.append((sum(pattern) + length, [(*pattern, length), take]))
            if (total := moved[-1][0]) + length <= capacity:  # it may take this length again, when it is the shortest
                _put(room, totals, *moved.pop())
        if left:
            each = max(1, capacity // length)
            if left >= each:
                moved.append((each * length, [(length,) * each, left // each]))
            if left % each:
                moved.append((left % each * length, [(length,) * (left % each), 1]))
        for total, entry in moved:
            _put(room, totals, total, entry)
    return [(pattern, packs) for entries in room.values() for pattern, packs in entries]


def _put(room: dict[int, list[list]], totals: list[int], total: int, entry: list) -> None:
    if total not in room:
        room[total] = []
        heappush(totals, total)
    same = next((e for e in room[total] if e[0] == entry[0]), None)
    if same:
        same[1] += entry[1]
    else:
        room[total].append(entry)


def _intervals(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset): rank r of the length goes to sequence first + r - first rank."""
    out, used, sequence = [], {}, 0
    for pattern, packs in sorted(patterns, reverse=True):
        offset = 0
        for length in pattern:
            at = used.get(length, 0)
            out.append((length, at, at + packs, sequence, offset))
            used[length] = at + packs
            offset += length
        sequence += packs
    return out


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each piece with its place: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null text is an empty one: a single piece with `end_id`. Repeated rows and null ids are documents of
    their own. An empty table gives no rows. Columns beside the id and text are not read.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "pack")
    cut = scratch.table(pieces(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces")
    histogram = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}
    intervals = _intervals(pack_histogram(histogram, capacity))
    blocks = max(1, math.ceil(sum(histogram.values()) / BLOCK_ROWS))
    # rows that agree in all these columns are interchangeable
    order = ["doc_id", "start", "ids_crc32", "doc_tokens"]
    placed = cut.withColumn("block", F.pmod(F.xxhash64("doc_id", "start"), F.lit(blocks)))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("length", "block").agg(F.count("*").alias("n"))
    starts = counts.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "block").orderBy(*order)
    ranked = placed.withColumn("nth", F.row_number().over(within) - 1).join(starts, ["length", "block"])
    ranked = ranked.withColumn("rank", F.col("first") + F.col("nth"))
    table = spark.createDataFrame(intervals, "l long, lo long, hi long, seq long, offset long")
    near = (F.col("length") == F.col("l")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    # one row for each pattern and place: set by `capacity`, not by the number of documents
    return ranked.join(F.broadcast(table), near).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("seq") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset"
    )
