"""Alignment of two tokenizers over a corpus, each distinct text being encoded once.

Rows meet by their full text; a distinct text is encoded by both tokenizers and cut where tokens of both end.
Links of tokens that end together are counted over the corpus, each text by its number of copies, and the
measures of a text go back to its documents by the text's SHA-256.

Of two tokens that end together, one's bytes end the other's. So the pairs that can be linked are bounded by the
two vocabularies (at most the sum of all tokens' lengths in bytes), however large the corpus is: their counts are
what the driver gathers and each task holds.
"""

from __future__ import annotations

import hashlib
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_counted
from .packing import Encoder

#: Chunks of text whose alignment a worker remembers.
MEMO = 400_000
#: The mark that pieces hold for a space.
MARK = "▁"

_MEASURES = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


class Aligner:
    """Tokens of both tokenizers over space+text, cut into groups where both end.

    A text whose white space is single spaces and line ends between visible characters is cut in front of spaces
    and around line ends, where neither tokenizer joins characters: the byte-level pattern by its form, the pieces
    if none holds a mark or a line end behind another character. Each distinct chunk is then encoded once. Other
    texts are encoded whole.
    """

    def __init__(self, byte_path: str, piece_path: str):
        import sentencepiece

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a, self.b = Encoder(byte_path), sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.a.tokenizer.encode_special_tokens, self.a.special = True, []  # their strings are plain text
        back = {letter: byte for byte, letter in self.a.letters.items()}
        vocabulary = self.a.tokenizer.get_vocab()
        tokens = {i: bytes(back[c] for c in token) for token, i in vocabulary.items() if all(c in back for c in token)}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_a, self.lengths_a, self.texts_a = self._tables([tokens.get(i, b"") for i in range(max(vocabulary.values()) + 1)], "|")
        self.bytes_b, self.lengths_b, self.texts_b = self._tables([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)], ";")
        whole = not any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces)
        self.cuts = self.a.cuts and whole and b"identity" in self.b.serialized_model_proto()[-4096:]
        self.memo: dict[str, tuple[bytes, bytes]] = {}

    @staticmethod
    def _tables(tokens: list[bytes], last: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each id's bytes, their number, and its decimal form inside a group and as the group's last."""
        texts = np.array([[f"{i},", f"{i}{last}"] for i in range(len(tokens))], object)
        return np.array(tokens, object), np.array([len(t) for t in tokens]), texts

    def align(self, text: str) -> tuple[int, int, str, np.ndarray] | None:
        """(tokens of a, tokens of b, groups as text, links as a << 32 | b); None for a text without tokens."""
        if not text:
            return None
        plain = self.cuts and text[0] not in " \n" and text[-1] != " " and self.a._plain(text)
        a, b = (np.frombuffer(x, "<u4") for x in (self._by_chunks if plain else self._whole)(text))
        data = (" " + text).encode()
        if b"".join(self.bytes_a[a].tolist()) != data or b"".join(self.bytes_b[b].tolist()) != data:
            return None
        ends_a, ends_b = np.cumsum(self.lengths_a[a]), np.cumsum(self.lengths_b[b])
        last_a, last_b = np.isin(ends_a, ends_b, assume_unique=True), np.isin(ends_b, ends_a, assume_unique=True)
        # tokens of a group's a stand before those of its b
        group = np.concatenate([np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b])
        texts = np.concatenate([self.texts_a[a, last_a.astype(int)], self.texts_b[b, last_b.astype(int)]])
        groups = "".join(texts[np.argsort(group, kind="stable")].tolist())[:-1]
        return len(a), len(b), groups, a[last_a].astype(np.int64) << 32 | b[last_b].astype(np.int64)

    def _whole(self, text: str) -> tuple[bytes, bytes]:
        return self.a.whole(" " + text), array("I", self.b.encode(text)).tobytes()

    def _by_chunks(self, text: str) -> tuple[bytes, bytes]:
        memo = self.memo
        chunks = [c for c in (" " + text).replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0") if c]
        found = list(map(memo.get, chunks))
        if None in found:
            if len(memo) > MEMO:
                memo.clear()
                self.a.memo.clear()
            new = list({c for c in chunks if c not in memo})
            a = [self.a.memo.get(c) or self.a._learn(c) for c in new]
            # pieces get a space in front; behind a line end they don't, and it is a piece of its own
            b = self.b.encode([c[1:] if c[0] == " " else "\n" + c for c in new], num_threads=1)
            for chunk, x, y in zip(new, a, b):
                memo[chunk] = x, array("I", y if chunk[0] == " " else y[2:]).tobytes()
            found = list(map(memo.get, chunks))
        a, b = zip(*found)
        return b"".join(a), b"".join(b)


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def _arrays(found: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found) if found else np.empty(0, np.int64), kind))


def aligned_texts(texts: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """(digest, copies, measures, pairs, times): each text's distinct links and how often it has each.

    `texts` has text, digest and copies; a text is read once and not kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = byte_path, piece_path
        aligner = _ALIGNERS.get(key) or _ALIGNERS.setdefault(key, Aligner(*key))
        none = np.empty(0, np.int64)
        for batch in batches:
            rows, pairs, times = [], [], []
            for text in batch.column(0):
                found = aligner.align(text.as_py())
                if found is None:
                    rows.append((0, 0, 0, 0, ""))
                    pairs.append(none)
                    times.append(none)
                    continue
                n_a, n_b, groups, links = found
                rows.append((n_a, n_b, groups.count(";") + 1, len(links), hashlib.sha256(groups.encode()).hexdigest()))
                distinct, n = np.unique(links, return_counts=True)
                pairs.append(distinct)
                times.append(n)
            columns = list(zip(*rows)) if rows else [[]] * 5
            arrays = [batch.column(1), batch.column(2), *(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.string()), _arrays(pairs, pa.int64()), _arrays(times, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["digest", "copies", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    return texts.select("text", "digest", "copies").mapInArrow(run, f"digest string, copies long, {_MEASURES}, pairs array<long>, times array<long>")


def pair_counts(texts: DataFrame) -> DataFrame:
    """(pair, n): how many links of the corpus hold each pair; summed in each batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, times = batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy()
            copies = np.repeat(batch.column(0).to_numpy(), np.diff(batch.column(1).offsets.to_numpy()))
            pairs, at = np.unique(keys, return_inverse=True)
            sums = np.zeros(len(pairs), np.int64)
            np.add.at(sums, at, times * copies)
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(sums)], names=["pair", "n"])

    return texts.select("copies", "pairs", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _best(pairs: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether each pair's count is the highest of its second id."""
    second = pairs & 0xFFFFFFFF
    ids, at = np.unique(second, return_inverse=True)
    most = np.zeros(len(ids), np.int64)
    np.maximum.at(most, at, n)
    return n == most[at]


def _measured(texts: DataFrame, pairs: np.ndarray, n: np.ndarray) -> DataFrame:
    """Each text's measures, with those that need the corpus' counts."""
    best = _best(pairs, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, times = batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy()
            at = np.searchsorted(pairs, keys)
            ends = batch.column(1).offsets.to_numpy()
            ends = ends - ends[0]
            sums = [np.concatenate([[0], np.cumsum(x)])[ends] for x in (times * best[at], times * n[at])]
            arrays = [batch.column(0), *batch.columns[3:], *(pa.array(np.diff(s), pa.int64()) for s in sums)]
            yield pa.RecordBatch.from_arrays(arrays, names=["digest", "copies", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"])

    columns = ["digest", "pairs", "times", "copies", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    return texts.select(*columns).mapInArrow(run, f"digest string, copies long, {_MEASURES}, n_best long, count_sum long")


def align_tokenizers(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """How the tokens of two vocabularies align in each document: a byte-level one and one of pieces.

    One row a row of `docs`: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256. Texts that are
    null or empty, or that a tokenizer doesn't give back, have zeros and ''. Repeated rows count as copies; null ids
    stay; an empty table gives no rows. Other columns aren't read.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "alignment")
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    there = own.where("text != ''")
    distinct = there.groupBy("text").agg(F.count("*").alias("copies")).withColumn("digest", F.sha2("text", 256))
    texts = scratch.table(aligned_texts(distinct, byte_path, piece_path), "texts")
    # bounded by the vocabularies, see above
    counts = pair_counts(texts).orderBy("pair").toArrow()
    pairs, n = (counts.column(c).to_numpy() for c in ("pair", "n"))
    measured = scratch.table(_measured(texts, pairs, n).withColumnRenamed("copies", "n"), "measures")
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    found = join_counted(there.select("doc_id", F.sha2("text", 256).alias("digest")), measured, ["digest"])
    rest = own.where("text IS NULL OR text = ''").select("doc_id", *(F.lit(0).cast("long").alias(c) for c in names[:-1]), F.lit("").alias(names[-1]))
    return found.select("doc_id", *names).unionByName(rest)
