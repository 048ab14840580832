"""Files that grow, as a stream: a micro-batch starts when a file is new, has grown or was written again.

Spark's own file source takes each name once; here the offset tells a folder's state by its files' sizes and times. The
rows are the files written since the batch before, as a hint: the engine looks for itself what has changed.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

NAME = "growing_files"


def listed(root: str) -> list[tuple[str, int, int]]:
    """(path, size, mtime in nanoseconds) of the files under a folder, sorted; one that goes meanwhile is left out."""
    out = []
    for folder, _, names in os.walk(root):
        for name in names:
            path = os.path.join(folder, name)
            try:
                found = os.stat(path)
            except OSError:
                continue
            out.append((path, found.st_size, found.st_mtime_ns))
    return sorted(out)


class _Span(InputPartition):
    def __init__(self, after: int):
        self.after = after


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.root = re.sub("^file:/+", "/", options["path"])

    def initialOffset(self) -> dict:
        return {"state": "", "newest": 0}

    def latestOffset(self) -> dict:
        files = listed(self.root)
        return {"state": hashlib.sha256(repr(files).encode()).hexdigest() if files else "", "newest": max((f[2] for f in files), default=0)}

    def partitions(self, start: dict, end: dict) -> list[_Span]:
        return [_Span(start["newest"])]

    def read(self, partition: _Span) -> Iterator[tuple]:
        for path, size, mtime in listed(self.root):
            if mtime >= partition.after:
                yield path, size, mtime // 1_000_000

    def commit(self, end: dict) -> None:
        pass


class GrowingFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "path string, size long, mtime long"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Reader(self.options)


def growing_files(spark: SparkSession, path: str) -> DataFrame:
    """A stream over a folder that the driver and the executors see under one name."""
    spark.dataSource.register(GrowingFiles)
    return spark.readStream.format(NAME).option("path", path).load()
