"""Parts of near-equal strings: banded candidates, exact Jaccard similarity, every candidate pair accounted for.

A measure gives each string its sorted distinct shingle hashes and a key for each MinHash band; two strings
that share a key are a candidate pair.

1. Strings of one batch that share a key are known to meet; of them one stands for the key. Standing strings
   are sorted by key, and those that aren't alone join the members, so a frequent key sends one row a batch.
2. Of several keys with the same members one is compared. A key with more strings than a task holds is split
   by hash, and its least string goes to each piece, so that a family of copies is joined across pieces by
   linear work.
3. Where such a key still holds several parts, the strings outside its largest part are compared with all
   strings of the key, piece by piece. No pair of strings is left out, and none is emitted that isn't similar.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .components import components

#: Strings and characters that one task compares at once.
PIECE_ROWS, PIECE_CHARS = 1000, 16_000_000
#: Characters of candidates in one partition of the comparison, and of small groups whose sets are made together.
DEALT_CHARS, HELD_CHARS = 2_000_000, 1_000_000


@dataclass(frozen=True)
class Measure:
    """`sets`: sorted distinct shingle hashes of each string; `keys`: a row of band keys for each set."""

    sets: Callable[[list[str]], list[np.ndarray]]
    keys: Callable[[list[np.ndarray]], np.ndarray]
    similarity: float = 0.8

    def similar(self, a: np.ndarray, b: np.ndarray) -> bool:
        least, most = sorted((len(a), len(b)))
        if least < self.similarity * most:
            return False
        both = np.concatenate((a, b))
        both.sort(kind="stable")
        common = np.count_nonzero(both[1:] == both[:-1])
        return bool(common >= self.similarity * (least + most - common))

    def join(self, sets: list[np.ndarray], keys: np.ndarray, part: np.ndarray, old: int = 0) -> np.ndarray:
        """`part` after all similar candidate pairs are joined.

        With `old`, only pairs of one of the first `old` strings and one of the others count.
        """
        size = np.array([len(s) for s in sets])
        for i in range(old or 1, len(sets)):
            to = old or i
            near = np.flatnonzero((keys[:to] == keys[i]).any(1))
            near = near[(part[near] != part[i]) & (size[near] >= self.similarity * size[i]) & (size[i] >= self.similarity * size[near])]
            if len(near) > 1:
                near = near[np.argsort(-(keys[near] == keys[i]).sum(1), kind="stable")]
            while len(near):
                j, near = int(near[0]), near[1:]
                if self.similar(sets[i], sets[j]):
                    part[part == part[i]] = part[j]
                    near = near[part[near] != part[i]]
        return part


def standing(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each string and band of a batch: whether it is the first with its key; whether others have it too."""
    first, several = np.zeros(keys.shape, bool), np.zeros(keys.shape, bool)
    for b in range(keys.shape[1]):
        _, at, inverse, n = np.unique(keys[:, b], return_index=True, return_inverse=True, return_counts=True)
        first[at, b] = True
        several[:, b] = n[inverse] > 1
    return first, several


def nested(values: np.ndarray, chosen: np.ndarray) -> pa.ListArray:
    """The chosen values of each row."""
    offsets = np.r_[0, np.cumsum(chosen.sum(1))].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[chosen]))


def _members(strings: DataFrame) -> DataFrame:
    """(key, h, chars) of each string that shares a key."""
    dealt = strings.select(F.explode("stands").alias("key"), "h", "chars").repartition("key").sortWithinPartitions("key", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row, and whether its key has several strings
        for batch in batches:
            if not batch.num_rows:
                continue
            key, h, chars = (c.to_numpy() for c in batch.columns)
            late = held is not None
            if late:
                key, h, chars = np.r_[held[0], key], np.r_[held[1], h], np.r_[held[2], chars]
            same, new = key[1:] == key[:-1], h[1:] != h[:-1]
            distinct = np.r_[True, ~same | new]  # of equal rows the first
            starts = np.r_[True, ~same]
            group = np.cumsum(starts) - 1
            n = np.bincount(group, distinct)
            several = n[group] > 1
            if late and held[3]:
                several[group == 0] = True
                distinct[0] = False  # it was sent
            last = group[-1]
            send = distinct & several
            open_ = bool(n[last] > 1 or (late and held[3] and last == 0))
            held = (key[-1:], h[-1:], chars[-1:], open_)
            yield pa.RecordBatch.from_arrays([pa.array(c[send]) for c in (key, h, chars)], names=["key", "h", "chars"])

    met = strings.where(F.size("shares") > 0).select(F.explode("shares").alias("key"), "h", "chars")
    return dealt.mapInArrow(run, "key long, h long, chars long").union(met).distinct()


def _compared(rows: DataFrame, chars: int, measure: Measure) -> DataFrame:
    """Links (a, b) between parts among the rows (k, asks, h, part, text) of equal k, stars around the least.

    `chars`: of all their texts. With rows that ask, only pairs of one of these and one of the others count.
    """
    dealt = rows.repartition(max(1, math.ceil(chars / DEALT_CHARS)), "k").sortWithinPartitions("k", "asks", "h")

    def links(groups: list[list[tuple]]) -> list[tuple[int, int]]:
        groups = [own for own in groups if len(own) > 1]
        sets = measure.sets([x[4] or "" for own in groups for x in own])
        at, out = 0, []
        many = np.repeat([len(own) > 2 for own in groups], [len(own) for own in groups])
        keys = np.zeros((len(sets), 1), np.int64)  # two strings are each other's only candidates; keys of more rank theirs
        if many.any():
            found = measure.keys([s for s, m in zip(sets, many) if m])
            keys = np.zeros((len(sets), found.shape[1]), np.int64)
            keys[many] = found
        for own in groups:
            mine = slice(at, at := at + len(own))
            names = sorted({x[3] for x in own})
            place = {p: n for n, p in enumerate(names)}
            before = np.array([place[x[3]] for x in own])
            old = sum(not x[1] for x in own) if own[-1][1] else 0
            after = measure.join(sets[mine], keys[mine], before.copy(), old)
            least: dict[int, int] = {}
            for p, q in sorted(set(zip(before.tolist(), after.tolist()))):
                if least.setdefault(q, p) != p:
                    out.append((names[least[q]], names[p]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[tuple] = []
        for batch in batches:
            out, held, size = [], [], 0
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if own and row[0] != own[0][0]:
                    held.append(own)
                    own = []
                    if size > HELD_CHARS:
                        out += links(held)
                        held, size = [], 0
                own.append(row)
                size += len(row[4] or "")
            yield _pairs(out + links(held))
        yield _pairs(links([own]))

    return dealt.select("k", "asks", "h", "part", "text").mapInArrow(run, "a long, b long")


def _pairs(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["a", "b"])


def _pieces() -> Column:
    """Tasks that the grouped rows (with `chars`) need."""
    return F.greatest(F.ceil(F.count("*") / PIECE_ROWS), F.ceil(F.sum("chars") / PIECE_CHARS), F.lit(1)).cast("int")


def _asked(members: DataFrame, parts: DataFrame, texts: DataFrame, measure: Measure, scratch: Scratch) -> DataFrame:
    """Links (a, b) between the parts inside keys of several pieces; `members`: their (key, h, chars, pieces)."""
    placed = members.join(parts.toDF("h", "component"), "h", "left").select("key", "pieces", "h", "chars", F.coalesce("component", "h").alias("part"))
    placed = scratch.table(placed, "placed")
    main = placed.groupBy("key", "part").agg(F.count("*").alias("n")).groupBy("key").agg(F.count("*").alias("parts"), F.max(F.struct("n", "part"))["part"].alias("main"))
    placed = scratch.table(placed.join(main.where("parts > 1"), "key"), "mixed")
    asking = placed.where("part != main").groupBy("key").agg(_pieces().alias("asking"))
    both = placed.join(asking, "key")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    at = lambda n: F.pmod(F.xxhash64("h", "key"), F.col(n)).cast("int")
    all_of = both.select("key", at("pieces").alias("y"), spread("asking").alias("x"), F.lit(False).alias("asks"), "h", "part")
    ask = both.where("part != main").select("key", spread("pieces").alias("y"), at("asking").alias("x"), F.lit(True).alias("asks"), "h", "part")
    rows = all_of.union(ask).join(texts, "h").select(F.xxhash64("key", "x", "y").alias("k"), "asks", "h", "part", "text")
    rows = scratch.table(rows, "asked")
    chars = rows.agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) + 1)).first()[0] or 0
    return scratch.table(_compared(rows, chars, measure), "links")


def similar_parts(strings: DataFrame, find: Callable[[DataFrame], DataFrame], measure: Measure, scratch: Scratch) -> DataFrame:
    """(node, component) of each string that is similar to another, by all candidate pairs.

    `strings` has h, chars, stands and shares (the keys that `standing` tells), a string any number of times.
    `find` gives (h, text) of at least the strings whose h it is shown, repeated or not.
    """
    members = scratch.table(_members(strings), "members")
    keys = members.groupBy("key").agg(F.count("*").alias("n"), F.min("h").alias("least"), F.min_by("chars", "h").alias("chars"), F.sum(F.xxhash64("h").cast("decimal(38,0)")).alias("all"), _pieces().alias("pieces"))
    keys = keys.where("n > 1").groupBy("n", "least", "all").agg(F.min("key").alias("key"), *(F.first(c).alias(c) for c in ("pieces", "chars")))
    keys = scratch.table(keys.select("key", "least", "pieces", F.col("chars").alias("least_chars")), "keys")
    members = scratch.table(members.join(keys.select("key", "pieces"), "key").select("key", "h", "chars", "pieces"), "compared")
    texts = scratch.table(find(members.select("h").distinct()).groupBy("h").agg(F.min("text").alias("text")), "texts")
    own = members.select("key", F.pmod(F.xxhash64("h", "key"), F.col("pieces")).cast("int").alias("piece"), "h")
    wide = keys.where("pieces > 1")
    least = wide.select("key", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.col("least").alias("h"))
    rows = own.union(least)
    rows = rows.join(texts, "h").select(F.xxhash64("key", "piece").alias("k"), F.lit(False).alias("asks"), "h", F.col("h").alias("part"), "text")
    chars = (members.agg(F.sum(F.col("chars") + 1)).first()[0] or 0) + (wide.agg(F.sum(F.col("pieces") * (F.col("least_chars") + 1))).first()[0] or 0)
    parts = components(scratch.table(_compared(rows, chars, measure), "links"), scratch)
    if wide.isEmpty():
        return parts
    parts = scratch.table(parts, "parts")
    top = components(_asked(members.where("pieces > 1"), parts, texts, measure, scratch), scratch).toDF("part", "top")
    joined = parts.join(top, parts["component"] == top["part"], "left").select("node", F.coalesce("top", "component").alias("component"))
    return joined.union(top.join(parts, top["part"] == parts["node"], "left_anti").select("part", "top"))
