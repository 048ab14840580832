"""Sharding: a minimax contiguous partition of ordered groups of equal texts.

Groups (equal texts, never split) stand in the order of a 64-bit hash of their text. The smallest
capacity at which `n_shards` contiguous runs hold them all is found by binary search, each probe
checked greedily; then the runs are cut. Only a histogram of key ranges reaches the driver: 4,096
ranges first, then the few ranges that a cut falls into, opened 256-fold until each such range is
one group. Its size depends on the number of shards, not on the number of documents.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

FIRST_SHIFT, OPEN_BITS = 52, 8
#: Rows of one shard that one task numbers.
BLOCK_ROWS = 2048


class _Ranges:
    """Ordered key ranges with their bytes; a range of several groups is still closed."""

    def __init__(self, rows: list[tuple[int, int, int, int, int]]):
        self.rows = sorted(rows, key=lambda r: r[2])  # shift, prefix, least key, greatest key, bytes
        self.ends = [0, *accumulate(r[4] for r in self.rows)]
        self.closed = [r[2] != r[3] for r in self.rows]

    def feasible(self, capacity: int, shards: int, inside: set[int]) -> bool:
        """Greedy check. A closed range counts as one block; those that a cut falls into go to `inside`."""
        at, last = 0, len(self.rows)
        for _ in range(shards):
            to = bisect_right(self.ends, self.ends[at] + capacity) - 1
            if to == last:
                return True
            if self.closed[to]:
                inside.add(to)
            at = to
        return False

    def capacity(self, shards: int) -> int:
        low, high = -(-self.ends[-1] // shards), self.ends[-1]
        while low < high:
            mid = (low + high) // 2
            if self.feasible(mid, shards, set()):
                high = mid
            else:
                low = mid + 1
        return low

    def cuts(self, capacity: int, shards: int, inside: set[int]) -> list[int]:
        """Positions of the cuts: each as near an even share of the rest as the capacity allows."""
        back = [len(self.rows)]  # back[j]: the first position from which j shards can hold the rest
        for _ in range(shards - 1):
            back.append(bisect_left(self.ends, self.ends[back[-1]] - capacity))
        out, at = [], 0
        for k in range(shards - 1):
            left = shards - k
            most = bisect_right(self.ends, self.ends[at] + capacity) - 1
            share = self.ends[at] + (self.ends[-1] - self.ends[at]) / left
            to = bisect_right(self.ends, share) - 1
            if to < len(self.rows):
                if self.closed[to]:
                    inside.add(to)
                if self.ends[to + 1] - share < share - self.ends[to]:
                    to += 1
            for bound in (back[left - 1] - 1, most):
                if 0 <= bound < len(self.rows) and self.closed[bound] and not back[left - 1] <= to <= most:
                    inside.add(bound)
            at = max(at, min(max(to, back[left - 1]), most))
            out.append(at)
        return out


def _histogram(keyed: DataFrame, shift: int) -> list[tuple[int, int, int, int, int]]:
    prefix = F.shiftright("key", shift)
    found = keyed.groupBy(prefix.alias("p")).agg(F.min("key"), F.max("key"), F.sum("size")).collect()
    return [(shift, r[0], r[1], r[2], r[3]) for r in found]


def minimax_bounds(keyed: DataFrame, shards: int) -> tuple[int, list[int | None]]:
    """The smallest capacity, and the first key of each shard but the first (None: no rows from there on).

    `keyed` has `key` (long: the group and its place in the order) and `size` (long).
    """
    rows = _histogram(keyed, FIRST_SHIFT)
    while True:
        ranges, inside = _Ranges(rows), set()
        capacity = ranges.capacity(shards)
        if capacity:
            ranges.feasible(capacity - 1, shards, inside)
        if not inside:
            cuts = ranges.cuts(capacity, shards, inside)
        if not inside:
            return capacity, [ranges.rows[c][2] if c < len(ranges.rows) else None for c in cuts]
        opened = [ranges.rows[i] for i in inside]
        rows = [r for i, r in enumerate(ranges.rows) if i not in inside]
        for shift in {r[0] for r in opened}:
            mine = keyed.where(F.shiftright("key", shift).isin([r[1] for r in opened if r[0] == shift]))
            rows += _histogram(mine, max(0, shift - OPEN_BITS))


def shard_by_bytes(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Puts each row into a shard of near equal bytes, equal texts together.

    Returns doc_id, size (UTF-8 bytes + 1), text_crc32, law ('bytes'), shard, slot (gapless from 0 in
    each shard), grown_shard (null: this law does not keep rows in place when a shard is added).
    A null text counts as an empty one. Null and repeated ids keep their rows, each with a slot of its
    own. An empty table gives no rows. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "shard")
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = scratch.table(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.xxhash64(text).alias("key"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
        ),
        "keyed",
    )
    _, bounds = minimax_bounds(keyed, n_shards)
    shard = F.lit(0)
    for bound in bounds:
        if bound is not None:
            shard = shard + (F.col("key") >= F.lit(bound).cast("long")).cast("int")
    blocks = max(1, math.ceil(keyed.count() / (n_shards * BLOCK_ROWS)))
    placed = keyed.withColumns({"shard": shard.cast("int"), "block": F.pmod(F.xxhash64("doc_id", "key"), F.lit(blocks))})
    counts = placed.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "block").orderBy("doc_id", "key")
    return (
        placed.withColumn("nth", F.row_number().over(within) - 1)
        .join(starts, ["shard", "block"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("start") + F.col("nth")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
