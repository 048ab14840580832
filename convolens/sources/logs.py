"""The tail of a log and the files that have changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_LINES, MOST_LINES = 240, 2000


def tail(spark: SparkSession, path: str, lines: int = DEFAULT_LINES) -> tuple[DataFrame, int]:
    """The last lines in order, and how many the log has. Each task sends its last `lines` at most."""
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("n"), F.rtrim(F.regexp_replace("value", "\r$", "")).alias("line"))
    kept = rows.orderBy(F.desc("n")).limit(min(max(1, lines), MOST_LINES))
    return kept.orderBy("n").select("line"), rows.count()


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, mtime) of the files under `path`; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime"))
