"""Toxicity: maximum-scoring segments over token log-odds, calibrated by extreme-value statistics.

1. The documents that use a word are counted, all of them and the labelled ones by class and fold. A word's
   share of toxic use gets a Dirichlet prior: its mean is the share of its prefix of six bytes (theirs that of
   five, of four, then the overall share), its weight grows with the word's count in the whole corpus. A
   token's score is the log-odds of its word's share against the overall share, less DRIFT; a word with under
   two labelled uses takes the score of its longest known prefix, or -DRIFT; one with under two toxic uses
   scores no higher than its prefix.
2. A linear scan (Ruzzo-Tompa) over all tokens gives every maximal segment of a text. lambda solves
   sum p(s) exp(lambda s) = 1 over the tokens of clean texts; K follows from the mean of the largest segments of
   clean texts (theirs is a Gumbel distribution around ln(K n) / lambda). A segment of score S in n words is
   expected K n exp(-lambda S) times by chance; a document's evidence is the sum of -log of these, where positive.
3. A logistic curve over the evidence gives the score.

lambda, K and the curve are fitted out of fold: each labelled text is scored by counts that leave its third of
the labelled rows out.

Labels are read of at most `max_labelled` rows, those with the smallest hash of their id; that bound is
also the bound of what is broadcast (ids with a label) and of the word table that goes to the executors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

MAX_LABELLED = 200_000
DRIFT, FOLDS = 1.0, 3
#: Prior weight of any word, and of all words together by their share of the corpus.
WEIGHT, CORPUS_WEIGHT = 1.0, 1000.0
#: Toxic uses under which a word scores no higher than its prefix.
LEAST_TOXIC = 2
CLASSES_OF_EVIDENCE = 400
THRESHOLD = 0.7
_TABLE = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_MEMO = 400_000
#: Lengths in bytes of the prefixes that words fall back to.
LEVELS = (6, 5, 4)
#: Classes of token scores for the sum over clean tokens.
_STEP, _FROM, _CLASSES = 0.05, -8.0, 400
_EULER = 0.5772156649


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def keys_of(words: list[bytes], kind: int = 0) -> np.ndarray:
    """Hashes of the words (0) or of their prefixes of `kind` bytes."""
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(w[:kind] if kind else w, kind) for w in words], np.uint64).view(np.int64)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) of a sequence, in linear time (each candidate is merged at most once)."""
    sums = np.cumsum(scores)
    places = np.flatnonzero(scores > 0)
    found: list[list] = []  # first, last, sum before it, sum up to its end, the nearest earlier one with a smaller sum before
    for place, before, total in zip(places.tolist(), (sums[places] - scores[places]).tolist(), sums[places].tolist()):
        new = [place, place, before, total, -1]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= new[3]:
                new[4] = j
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3], found[j][4]]
            del found[j:]
    return [(a, b, r - l) for a, b, l, r, _ in found]


@dataclass
class Words:
    """Log-odds of words and prefixes by their sorted hashes: a column of all counts, and one for each fold left out."""

    keys: np.ndarray
    odds: np.ndarray
    drift: float
    memo: list[dict[bytes, float]] = field(default_factory=lambda: [{} for _ in range(FOLDS + 1)])

    def __getstate__(self) -> dict:
        return {"keys": self.keys, "odds": self.odds, "drift": self.drift, "memo": [{} for _ in range(FOLDS + 1)]}

    def _looked_up(self, words: list[bytes], column: int) -> np.ndarray:
        out = np.zeros(len(words))
        left = np.arange(len(words))
        for kind in (0, *LEVELS):
            left = left[[len(words[i]) > kind for i in left.tolist()]] if kind else left
            if not len(left) or not len(self.keys):
                break
            keys = keys_of([words[i] for i in left.tolist()], kind)
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = self.keys[at] == keys
            out[left[hit]] = self.odds[at[hit], column]
            left = left[~hit]
        return out - self.drift

    def scores(self, words: list[bytes], column: int = 0) -> np.ndarray:
        """The score of each token."""
        memo = self.memo[column]
        found = list(map(memo.get, words))
        if None in found:
            if len(memo) > _MEMO:
                memo.clear()
                found = [None] * len(words)
            new = list({w for w, x in zip(words, found) if x is None})
            memo.update(zip(new, self._looked_up(new, column).tolist()))
            found = list(map(memo.get, words))
        return np.array(found)


@dataclass
class Model:
    """Word scores; lam, k and the logistic curve calibrate a text's segments."""

    words: Words
    lam: float = 1.0
    k: float = 0.1
    curve: tuple[float, float] = (0.0, 1.0)

    def passages(self, text: str | None) -> list[tuple[int, int, float]]:
        """(first word, last word, significance) of each significant passage."""
        words = words_of(text)
        if not words:
            return []
        scores, chance = self.words.scores(words), math.log(self.k * max(10, len(words)))
        if self.lam * scores[scores > 0].sum() <= chance:
            return []
        out = ((a, b, self.lam * s - chance) for a, b, s in segments(scores))
        return [x for x in out if x[2] > 0]

    def score(self, evidence: float) -> float:
        x = self.curve[0] + self.curve[1] * math.log1p(evidence)
        return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def held_out(id_col: str = "doc_id"):
    """Rows whose labels are never learnt from."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _labelled(docs: DataFrame, labels: DataFrame, max_labelled: int) -> DataFrame:
    """(class, text) of every document: twice the fold and 1 if toxic; null where it isn't learnt from."""
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)  # its size is bounded, so it may be broadcast
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int")
    known = known.select("doc_id", (fold * 2 + F.col("toxic")).alias("class"))
    return docs.join(F.broadcast(known), "doc_id", "left").select("class", "text")


_COUNTS = [f"c{i}" for i in range(2 * FOLDS)]


def _counted(rows: DataFrame) -> DataFrame:
    """(kind, key, up, n, c0 to c5): documents that use a word (0) or prefix (LEVELS), all and by class; up: the key one level up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index: dict[bytes, int] = {}
            ids, sizes = [], []
            for text in batch.column(1):
                own = [index.setdefault(w, len(index)) for w in set(words_of(text.as_py()))]
                ids.append(np.array(own, np.int64))
                sizes.append(len(own))
            at = np.concatenate(ids) if ids else np.empty(0, np.int64)
            kind_of = np.repeat(np.array([-1 if c is None else c for c in batch.column(0).to_pylist()], np.int64), sizes)
            words = list(index)
            counts = np.empty((1 + 2 * FOLDS, len(words)), np.int64)
            counts[0] = np.bincount(at, minlength=len(words))
            for c in range(2 * FOLDS):
                counts[c + 1] = np.bincount(at[kind_of == c], minlength=len(words))
            up = np.zeros(len(words), np.int64)
            parts = []
            for kind in reversed(LEVELS):
                own = np.array([i for i, w in enumerate(words) if len(w) > kind], np.int64)
                keys = keys_of([words[i] for i in own.tolist()], kind)
                distinct, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
                sums = np.stack([np.bincount(inverse, row[own], len(distinct)) for row in counts]).astype(np.int64)
                parts.append((np.full(len(distinct), kind, np.int32), distinct, up[own[first]], sums))
                up[own] = keys
            parts.append((np.zeros(len(words), np.int32), keys_of(words), up, counts))
            for kind, key, above, sums in parts:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (kind, key, above, *sums)], names=["kind", "key", "up", "n", *_COUNTS])

    made = rows.mapInArrow(run, "kind int, key long, up long, n long, " + ", ".join(f"{c} long" for c in _COUNTS))
    return made.groupBy("kind", "key", "up").agg(*(F.sum(c).alias(c) for c in ("n", *_COUNTS)))


def _word_table(counted: DataFrame, total: list[int]) -> Words:
    """Log-odds with all labelled rows, and with all but a fold."""
    uses, shares = [], []
    for left_out in (None, *range(FOLDS)):
        kept = [f for f in range(FOLDS) if f != left_out]
        toxic, clean = sum(total[2 + 2 * f] for f in kept), sum(total[1 + 2 * f] for f in kept)
        shares.append(min(max(toxic / max(1, toxic + clean), 1e-6), 1 - 1e-6))
        uses.append((sum(F.col(f"c{2 * f + 1}") for f in kept), sum(F.col(f"c{2 * f}") for f in kept)))
    weight = F.lit(WEIGHT) + F.lit(CORPUS_WEIGHT) * F.col("n") / F.lit(float(total[0]))
    table = None
    for kind in (*reversed(LEVELS), 0):
        own = counted.where((F.col("kind") == kind) & (uses[0][0] + uses[0][1] > 1))
        means = [F.lit(x) for x in shares]
        if table is not None:
            own = own.join(table.select(F.col("key").alias("up"), *(F.col(f"s{v}").alias(f"m{v}") for v in range(FOLDS + 1))), "up", "left")
            means = [F.coalesce(f"m{v}", F.lit(x)) for v, x in enumerate(shares)]
        made = [((t + weight * m) / (t + c + weight), t, m) for (t, c), m in zip(uses, means)]
        own = own.select("key", *(F.when(t < LEAST_TOXIC, F.least(s, m)).otherwise(s).alias(f"s{v}") for v, (s, t, m) in enumerate(made)))
        table = own if table is None else table.union(own)
    odds = [(F.log(F.col(f"s{v}") / (1 - F.col(f"s{v}"))) - math.log(x / (1 - x))).cast("float").alias(f"s{v}") for v, x in enumerate(shares)]
    found = table.select("key", *odds).toArrow()
    keys = found.column(0).to_numpy()
    order = np.argsort(keys, kind="stable")
    return Words(keys[order], np.stack([found.column(v + 1).to_numpy() for v in range(FOLDS + 1)], 1)[order], DRIFT)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, scratch: Scratch | None = None) -> Model:
    """A model from the documents (doc_id, text) and their labels (doc_id, toxic).

    Labels that are null or not 0 or 1 are left out, repeated ones count as toxic if any is. Without
    labels of both classes every score is the neutral one, below the threshold.
    """
    scratch = scratch or Scratch(docs.sparkSession, "toxicity")
    rows = _labelled(docs, labels, max_labelled)
    labelled = F.greatest(*_COUNTS) > 0
    counted = scratch.table(_counted(rows).where(labelled), "counts")
    # n counts all documents, of the words that a labelled one uses
    total = counted.where("kind = 0").agg(F.sum("n"), *(F.sum(c) for c in _COUNTS)).first()
    if not total[0] or not sum(total[1::2]) or not sum(total[2::2]):
        return Model(Words(np.empty(0, np.int64), np.empty((0, FOLDS + 1)), DRIFT), curve=(-1.0, 0.0))
    model = Model(_word_table(counted, total))
    _calibrate(model, rows, scratch)
    return model


def _calibrate(model: Model, rows: DataFrame, scratch: Scratch) -> None:
    """lambda and K of clean texts, then the curve; each text is scored without its own fold."""
    shared = rows.sparkSession.sparkContext.broadcast(model.words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, sizes, found, seen = [], [], [], np.zeros(_CLASSES)
            for kind, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                scores = shared.value.scores(words_of(text.as_py()), kind // 2 + 1)
                if kind % 2 == 0:
                    seen += np.bincount(np.clip(np.rint((scores - _FROM) / _STEP), 0, _CLASSES - 1).astype(int), minlength=_CLASSES)
                kinds.append(kind % 2)
                sizes.append(len(scores))
                found.append([s for *_, s in segments(scores)] if len(scores) else [])
            arrays = [pa.array([*kinds, -1], pa.int32()), pa.array([*sizes, 0], pa.int64()), pa.array([*found, seen.tolist()], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["toxic", "n", "found"])

    scored = scratch.table(rows.where("class IS NOT NULL").mapInArrow(run, "toxic int, n long, found array<double>"), "scored")
    # one row of classes for each batch of the labelled sample
    classes = scored.where("toxic < 0").select(F.posexplode("found").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
    seen = np.zeros(_CLASSES)
    for r in classes:
        seen[r["i"]] = r["x"]
    values = _FROM + _STEP * np.arange(_CLASSES)
    low, high = 1e-3, 8.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (seen * np.exp(np.minimum(600, mid * values))).sum() < seen.sum() else (low, mid)
    model.lam = low
    size = F.greatest(F.col("n"), F.lit(10))
    largest = F.lit(model.lam) * F.coalesce(F.array_max("found"), F.lit(0.0)) - F.log(size)
    mean = scored.where("toxic = 0 AND n > 0").agg(F.avg(largest)).first()[0]
    model.k = math.exp(min(5.0, max(-9.0, (mean if mean is not None else -2.0) - _EULER)))
    over = F.aggregate("found", F.lit(0.0), lambda t, x: t + F.greatest(F.lit(0.0), F.lit(model.lam) * x - F.log(F.lit(model.k) * size)))
    kind = F.least(F.lit(CLASSES_OF_EVIDENCE), F.round(20 * F.log1p(over))).cast("int").alias("e")
    counts = scored.where("toxic >= 0").groupBy(kind, "toxic").count().collect()  # at most two rows for each class
    model.curve = _logistic([(r["e"] / 20, r["toxic"], r["count"]) for r in counts])


def _logistic(rows: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Intercept and slope by Newton steps, the slope held by a weak normal prior."""
    a, b = 0.0, 1.0
    for _ in range(50):
        ga, gb, haa, hab, hbb = 0.0, -0.05 * b, 1e-6, 0.0, 0.05
        for x, y, n in rows:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x))))
            w = n * max(1e-9, p * (1 - p))
            ga, gb = ga + n * (y - p), gb + n * (y - p) * x
            haa, hab, hbb = haa + w, hab + w * x, hbb + w * x * x
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        size = max(1.0, abs(da), abs(db))
        a, b = a + da / size, b + db / size
        if abs(da) + abs(db) < 1e-9:
            break
    return a, max(0.0, b)


def score_documents(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, n_passages, passages (first:last word).

    A null or empty text has no evidence and gets the score of that. Repeated rows and null ids keep
    their rows. An empty table gives no rows. Only the text enters a score.
    """
    docs = docs.select("doc_id", "text")
    model = fit(docs, labels, max_labelled)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.passages(t.as_py()) for t in batch.column(2)]
            scores = [shared.value.score(sum(x[2] for x in f)) for f in found]
            arrays = [
                pa.array(scores, pa.float64()),
                pa.array([int(s >= THRESHOLD) for s in scores], pa.int32()),
                pa.array([len(f) for f in found], pa.int64()),
                pa.array([",".join(f"{a}:{b}" for a, b, _ in f) for f in found], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=["doc_id", "held_out", "score", "predicted", "n_passages", "passages"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, score double, predicted int, n_passages long, passages string"
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The rows of `docs`, all their columns, whose score is under the threshold; null and empty texts stay, repeated rows too."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs.select("doc_id", "text"), labels, max_labelled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model = shared.value
            keep = [model.score(sum(x[2] for x in model.passages(t.as_py()))) < THRESHOLD for t in batch.column("text")]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
