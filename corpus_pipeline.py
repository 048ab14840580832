"""A corpus pipeline of the training-data operators.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. All but the
last return the columns of `docs`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from convolens.llm.common import Scratch, read
from convolens.llm.copies import drop_near_copies
from convolens.llm.decontaminate import drop_contaminated
from convolens.llm.lines import dedup_lines
from convolens.llm.packing import pack
from convolens.llm.queries import tokenizer_path
from convolens.llm.simhash import text_links
from convolens.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches the threshold go."""
    return drop_toxic(docs, read(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-equal lines the first stays; a document that loses every line goes."""
    return dedup_lines(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: linked by SimHash (prints at most 3 bits apart), or near copies, five-word shingles at a Jaccard similarity of 0.8."""
    return drop_near_copies(docs, more=text_links(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that are left, with their places in sequences."""
    return pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL can't express the trained scores, the signatures and the packing; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to the documents; each result is written to the shared folder and read again."""
    scratch, docs = Scratch(spark, "pipeline"), read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
