"""Divergence audit of sources: which terms a (lang, source) group uses more than its lang, and how far groups differ.

Terms are counted once for each group, and all else works on those counts. A group's terms fall into cells of
(count in the group, count in the lang); what a term is worth depends on its cell alone. So values are worked out by
cell, equal values are merged, ranked by the number of terms before them, and only the cells that reach the ranks
asked for are opened again into terms, in UTF-8 order.

Groups are compared in tiles of sources by blocks of terms, each a matrix of shares in one task. A tile's rows are
repeated for each tile it meets: once up to TILE sources in a lang, and beyond that the result itself, one row a pair
of sources, is larger.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: A term's bytes in UTF-8: a-z (A-Z as a-z) and all over 0x7F; every other byte separates.
_TABLE = bytes(c if 97 <= c <= 122 or c > 127 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
#: Terms of groups that a task counts at once.
HELD_TERMS = 400_000
LEAST_DOCS, TOP = 30, 50
#: Shares are whole multiples of 1 / UNIT, with so much added to each count.
UNIT, ADDED = 1_000_000_000, 5
#: Sources and terms that meet in one task, on average.
TILE, BLOCK_TERMS = 128, 2048
#: Counts up to this keep UNIT * (count + ADDED) within 64 bits.
SMALL = 9_000_000_000


def share(count: str, total: str, terms: str) -> Column:
    """1 + floor(UNIT * (count + ADDED) / (total + ADDED * terms)) of columns, exact at any size; null without terms."""
    over = f"({total} + {ADDED} * {terms})"
    small = f"({UNIT}L * ({count} + {ADDED})) div {over}"
    large = f"(cast({UNIT} AS decimal(10, 0)) * (cast({count} AS decimal(20, 0)) + {ADDED})) div cast({over} AS decimal(20, 0))"
    return F.expr(f"CASE WHEN {terms} > 0 THEN 1L + CASE WHEN {count} <= {SMALL} THEN {small} ELSE {large} END END")


def _groups(docs: DataFrame, lang_col: str, source_col: str, text_col: str) -> DataFrame:
    """(lang, source, text), null as ''."""
    named = ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(to) for c, to in named))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in a group, and the group's documents that hold it.

    Tasks count what they read, up to HELD_TERMS at a time, before rows are shuffled.
    """

    def counted(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, in_docs) in held.items():
            terms = list(n)
            arrays = [pa.array([x] * len(terms), pa.string()) for x in (lang, source)] + [pa.array(terms, pa.binary()).cast(pa.string())]
            arrays += [pa.array(n.values(), pa.int64()), pa.array(map(in_docs.__getitem__, terms), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = defaultdict(lambda: (Counter(), Counter())), 0
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                n, in_docs = held[lang, source]
                words, before = text.encode().translate(_TABLE).split(), len(n)
                n.update(words)
                in_docs.update(set(words))
                size += len(n) - before
                if size > HELD_TERMS:
                    yield from counted(held)
                    held.clear()
                    size = 0
        yield from counted(held)

    parts = docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _top_terms(used: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """(lang, source, part, item, value, rank): the terms whose share in the group is above that in the lang."""
    group, cell = ["lang", "source"], ["lang", "source", "n", "lang_n"]
    cells = used.groupBy(*cell).agg(F.count("*").alias("many")).join(groups, group)
    cells = cells.select(*cell, "many", (share("n", "total", "terms") - share("lang_n", "lang_total", "terms")).alias("value")).where("value > 0")
    falling = Window.partitionBy(*group).orderBy(F.desc("value"))
    values = cells.groupBy(*group, "value").agg(F.sum("many").alias("many")).withColumn("nth", F.row_number().over(falling)).where(F.col("nth") <= top)
    before = F.coalesce(F.sum("many").over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    values = values.select(*group, "value", before.alias("before")).where(F.col("before") < top)
    opened = used.join(cells.select(*cell, "value").join(values, [*group, "value"]), cell)
    named = opened.withColumn("nth", F.row_number().over(Window.partitionBy(*group, "value").orderBy("term"))).where(F.col("nth") <= top)
    named = named.withColumn("rank", (F.col("before") + F.col("nth")).cast("int")).where(F.col("rank") <= top)
    return named.select(*group, F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")


_PARTIAL = "lang string, one string, two string, total long, seen long, apart long, terms long"


def _compared(t: pa.Table) -> pa.Table:
    """Partial distances of the pairs of sources of two tiles over one block of terms."""
    is_group = t.column("term").is_null().to_numpy()
    sources = t.column("source").to_numpy()
    share_ = t.column("share").to_numpy()
    names = sources[is_group]
    order = np.argsort(names)
    names, base, tile = names[order], share_[is_group][order], t.column("tile").to_numpy()[is_group][order]
    terms = t.column("term").combine_chunks().filter(pa.array(~is_group)).dictionary_encode()
    shares = np.repeat(base[:, None], len(terms.dictionary), axis=1)
    shares[np.searchsorted(names, sources[~is_group]), terms.indices.to_numpy()] = share_[~is_group]
    lo, hi = (t.column(c)[0].as_py() for c in ("lo", "hi"))
    one, two, total = [], [], []
    for i in np.flatnonzero(tile == lo):
        others = np.arange(i + 1, len(names)) if lo == hi else np.flatnonzero(tile == hi)
        one.append(np.full(len(others), i))
        two.append(others)
        total.append(np.abs(shares[others] - shares[i]).sum(axis=1))
    one, two, total = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (one, two, total))
    n, first = len(one), lambda c: t.column(c)[0].as_py()
    columns = [pa.array([first("lang")] * n, pa.string()), pa.array(names[one], pa.string()), pa.array(names[two], pa.string()), pa.array(total.astype(np.int64))]
    columns += [pa.array(np.full(n, len(terms.dictionary), np.int64)), pa.array(np.abs(base[one] - base[two])), pa.array(np.full(n, first("terms"), np.int64))]
    return pa.table(columns, names=["lang", "one", "two", "total", "seen", "apart", "terms"])


def _pairs(used: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each other source of the lang is."""
    sizes = groups.groupBy("lang").agg(F.ceil(F.count("*") / TILE).alias("tiles"), F.greatest(F.lit(1), F.ceil(F.max("terms") / BLOCK_TERMS)).alias("blocks"))
    own = groups.join(sizes, "lang").withColumn("tile", F.pmod(F.xxhash64("source"), "tiles"))
    base = own.select("lang", "source", "tile", "tiles", "terms", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(None).cast("string").alias("term"), F.coalesce(share("0L", "total", "terms"), F.lit(0)).alias("share"))
    counted = used.select("lang", "source", "term", "n").join(own, ["lang", "source"])
    counted = counted.select("lang", "source", "tile", "tiles", "terms", F.pmod(F.xxhash64("term"), "blocks").alias("block"), "term", share("n", "total", "terms").alias("share"))
    met = base.unionByName(counted).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    met = met.select("lang", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"), "block", "source", "tile", "term", "share", "terms")
    parts = met.groupBy("lang", "lo", "hi", "block").applyInArrow(_compared, _PARTIAL)
    # terms that neither group of a pair was seen with differ by what a count of 0 gives
    whole = parts.groupBy("lang", "one", "two").agg((F.sum("total") + (F.max("terms") - F.sum("seen")) * F.max("apart")).alias("value"))
    both = whole.select("lang", F.explode(F.array(F.struct(F.col("one").alias("source"), F.col("two").alias("item")), F.struct(F.col("two").alias("source"), F.col("one").alias("item")))).alias("p"), "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return both.select("lang", "p.source", F.lit("pair").alias("part"), "p.item", "value").withColumn("rank", rank)


def audit_sources(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): `pair` for each other source of the lang, `term` for the leading terms.

    A null lang, source or text is ''. Each row is a document, repeated rows too. Langs without a kept term have pairs
    of value 0, and langs of one source none. Equal values rank by their items' bytes. An empty table gives no rows;
    other columns aren't read.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    own = _groups(docs, lang_col, source_col, text_col)
    counts = scratch.table(term_counts(own), "counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs")
    used = scratch.table(counts.drop("docs").join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "used")
    # a kept term's counts in groups add up to its count in the lang
    langs = used.groupBy("lang", "term").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_total"))
    totals = used.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = own.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = scratch.table(groups.na.fill(0, ["total", "terms", "lang_total"]), "groups")
    return _pairs(used, groups).unionByName(_top_terms(used, groups, top))
