"""Substring dedup: sliding runs of consecutive sentences, hashed, counted globally, removed where repeated.

A sentence of over 12 words is split: in each 12 words of it in a row the word of the least key (clause
marks first, then by hash) ends a piece. These ends depend on the words around them alone, so of a passage
of over 50 words at most 12 words at its start and 11 at its end lie in pieces that reach beyond it or differ;
the other 28 are whole pieces of at most 12 words: a run, wherever the passage starts and with or without
stops. Each Chinese, Japanese, Thai, Lao, Burmese or Khmer character counts as a word. Below, a sentence
is also such a piece.

A run starts at each sentence and takes the fewest sentences that make it long enough: three with at
least 15 words, or two with at least 30. Runs are written once as (hash, document, first and last
sentence). A hash is counted with map-side sums; only runs whose hash occurs more than once are joined
back. The occurrence in the smallest document id, the first one inside it, stays; every sentence under
another occurrence goes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh, join_counted, replaced
from .lines import bitmap, marked

#: (sentences, words) that make a run long enough.
ENOUGH = ((3, 15), (2, 30))
#: A sentence with the white space behind it: up to stops that white space follows, or a line's end.
_SENTENCE = re.compile(r"[^.!?\n]*(?:[.!?]+(?![.!?\s])[^.!?\n]*)*(?:[.!?]+|\n|\Z)\s*")
#: Stops that end a sentence whatever follows, with closing marks and white space.
_WIDE_STOP = re.compile(r"(?<=[。！？｡।॥։۔؟။។])(?![。！？｡।॥։۔؟။។」』”’）)\s])")
#: Words of scripts that are written without spaces are single characters.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_ANY_UNSPACED = re.compile(f"[{_UNSPACED}]")
_SPACED_WORD, _WORD = re.compile(r"\S+\s*"), re.compile(f"[{_UNSPACED}](?:[^\\w\\s]|_)*\\s*|[^\\s{_UNSPACED}]+\\s*")
#: Words that a piece has at most.
PIECE_WORDS = 12
#: Of a map of the repeated hashes that keeps most other runs out of the join.
BITMAP_BITS = 1 << 27
_CLAUSE = (",", ";", ":", "，", "、", "；", "：", "،", "؛")


def _words(part: str) -> list[str]:
    """The words of `part`, each with the white space behind it."""
    return (_WORD if not part.isascii() and _ANY_UNSPACED.search(part) else _SPACED_WORD).findall(part)


def _pieces(part: str) -> list[str]:
    """A sentence, split if it has over PIECE_WORDS words."""
    if len(part) < 2 * PIECE_WORDS and part.isascii():
        return [part]
    words = _words(part)
    if len(words) <= PIECE_WORDS:
        return [part]
    keys = []
    for w in words:
        w = w.rstrip()
        keys.append(xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) >> 1 | (not w.endswith(_CLAUSE)) << 63)
    ends, best = [], -1
    for i in range(PIECE_WORDS - 1, len(words)):
        if best <= i - PIECE_WORDS:
            own = keys[i - PIECE_WORDS + 1 : i + 1]
            best = i - own[::-1].index(min(own))  # of equal keys the last
        elif keys[i] <= keys[best]:
            best = i
        else:
            continue
        ends.append(best + 1)
    lead = part[: len(part) - sum(map(len, words))]
    edges = [0, *(e for e in ends if e < len(words)), len(words)]
    out = ["".join(words[a:b]) for a, b in zip(edges, edges[1:])]
    return [lead + out[0], *out[1:]]


def sentences(text: str | None) -> list[str]:
    """Pieces that make up `text` again, each a sentence or a piece of one with what white space follows it."""
    parts = [s for s in _SENTENCE.findall(text) if s] if text else []
    if parts and not text.isascii() and _WIDE_STOP.search(text):
        parts = [x for s in parts for x in _WIDE_STOP.split(s) if x]
    return [x for s in parts for x in _pieces(s)]


def runs(text: str | None) -> list[tuple[int, int, bytes]]:
    """(first, last, digest) of the run from each sentence, white space counting as one space."""
    parts = [" ".join(s.split()) for s in sentences(text)]
    words = [0 if not s else s.count(" ") + 1 if s.isascii() else len(_words(s)) for s in parts]
    real = [i for i, n in enumerate(words) if n]
    out, digest, least = [], xxhash.xxh3_128_digest, min(w for _, w in ENOUGH)
    for at in range(len(real)):
        total = 0
        for n in range(at, len(real)):
            total += words[real[n]]
            if total >= least and any(n - at + 1 >= s and total >= w for s, w in ENOUGH):
                out.append((real[at], real[n], digest("\n".join([parts[i] for i in real[at : n + 1]]).encode("utf-8", "surrogatepass"))))
                break
    return out


def _spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, lo, hi, again, digests = [], [], [], [], []
            for i, text in enumerate(batch.column(2)):
                seen = set()
                for first, last, digest in runs(text.as_py()):
                    at.append(i)
                    lo.append(first)
                    hi.append(last)
                    again.append(digest in seen)
                    seen.add(digest)
                    digests.append(digest)
            whole = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            arrays = [
                pa.array(whole[:, 0].copy()),
                pa.array((whole[:, 1] & 0x7FFFFFFF).astype(np.int32)),
                batch.column(0).take(pa.array(at, pa.int64())),
                batch.column(1).take(pa.array(at, pa.int64())),
                pa.array(lo, pa.int32()),
                pa.array(hi, pa.int32()),
                pa.array(again, pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["h", "g", "doc_id", "tk", "lo", "hi", "again"])

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("tk"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"h long, g int, doc_id {kind}, tk long, lo int, hi int, again boolean")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tk, spans): the sentence runs (lo, hi) of a document that occur earlier; tk: its text's hash."""
    scratch = Scratch(docs.sparkSession, "spans")
    spans = scratch.table(_spans(docs, id_col, text_col), "spans")
    counted = spans.groupBy("h", "g").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")
    counted = scratch.table(counted, "counted")
    wanted = bitmap(counted, BITMAP_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column(0).to_numpy() % BITMAP_BITS
            yield batch.filter(pa.array((wanted[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1))

    later = join_counted(spans.mapInArrow(run, spans.schema), counted, ["h", "g"]).where("again OR NOT (doc_id <=> first)")
    return later.groupBy("doc_id", "tk").agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("spans"))


def _cut(text: str | None, spans: list[dict] | None) -> tuple[str | None, int]:
    """The text without the sentences under `spans`, and how many those are."""
    if not spans:
        return text, 0
    gone = {i for s in spans for i in range(s["lo"], s["hi"] + 1)}
    return "".join([p for i, p in enumerate(sentences(text)) if i not in gone]), len(gone)


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with repeated sentence runs cut out of its text, and a column n_removed (sentences).

    Of the rows that share a run those with the smallest id keep it; rows equal in id and text count as
    one document. Null ids come after all others. Null and empty texts stay as they are. Other columns
    are passed through; the new column gets a trailing underscore if its name is taken.
    """
    found = repeated_spans(docs, id_col, text_col)
    tk, i, t, spans, n_removed = fresh(docs, "tk", "found_id", "found_tk", "spans", "n_removed")
    keyed, found = docs.withColumn(tk, F.xxhash64(text_col)), found.toDF(i, t, spans)
    joined = keyed.join(found, F.col(id_col).eqNullSafe(F.col(i)) & (F.col(tk) == F.col(t)), "left").select(*docs.columns, spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [_cut(x.as_py(), s.as_py()) for x, s in zip(batch.column(text_col), batch.column(spans))]
            texts, gone = zip(*cut) if cut else ((), ())
            out = replaced(batch, text_col, texts).drop_columns([spans])
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(gone, pa.int64())], names=[*out.schema.names, n_removed])

    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema)
    return joined.mapInArrow(run, f"{schema}, `{n_removed}` long")
