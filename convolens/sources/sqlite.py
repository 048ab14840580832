"""SQLite files as a Spark data source: files are read where their partitions run.

read_sqlite gives the rows of the first of `tables` that a file has, columns that it lacks as null, all as text.
Small files share partitions. The files must lie in a folder that every executor sees.
"""

from __future__ import annotations

import glob
import json
import os
import re
import sqlite3
import urllib.parse
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions import scalar as S
from ..operators import rollup as R
from .transcripts import _MESSAGE, _conversations, iso_or, role_of

NAME = "sqlite_rows"


#: Files are dealt to partitions up to so many bytes and files together; a larger file is a partition of its own.
PARTITION_BYTES, PARTITION_FILES = 32 << 20, 256
#: A name in `columns` that stands for the file's time in epoch milliseconds.
MODIFIED = "_modified"


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.given, self.tables, self.columns = json.loads(options["path"]), options["tables"].split(","), options["columns"].split(",")
        self.hexed = set(options.get("hexed", "").split(","))

    def partitions(self) -> list[_Files]:
        found: list[str] = []
        for path in (re.sub("^file:/+", "/", p) for p in self.given):
            found += glob.glob(os.path.join(path, "**", "*"), recursive=True) if os.path.isdir(path) else glob.glob(path)
        out, held, size = [], [], 0
        for path in sorted({p for p in found if os.path.isfile(p)}):
            own = os.path.getsize(path)
            if held and (size + own > PARTITION_BYTES or len(held) == PARTITION_FILES):
                out.append(_Files(held))
                held, size = [], 0
            held.append(path)
            size += own
        return [*out, _Files(held)]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for path in partition.paths:
            try:
                yield from self._rows(path)
            except sqlite3.DatabaseError:  # not a database: such files are no source
                continue

    def _rows(self, path: str) -> Iterator[tuple]:
        db = sqlite3.connect(f"file:{urllib.parse.quote(path)}?mode=ro", uri=True)
        try:
            there = {r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type IN ('table', 'view')")}
            table = next((t for t in self.tables if t in there), None)
            if table is None:
                return
            quote = lambda name: '"' + name.replace('"', '""') + '"'
            have = {r[1] for r in db.execute(f"PRAGMA table_info({quote(table)})")}
            cell = lambda c: f"hex({quote(c)})" if c in self.hexed else f"CAST({quote(c)} AS TEXT)"
            cells = ", ".join(f"'{round(os.path.getmtime(path) * 1000)}'" if c == MODIFIED else cell(c) if c in have else "NULL" for c in self.columns)
            for n, row in enumerate(db.execute(f"SELECT {cells} FROM {quote(table)}")):
                yield (path, table, n, *row)
        finally:
            db.close()


class SqliteRows(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "path string, source_table string, n int, " + ", ".join(f"`{c}` string" for c in self.options["columns"].split(","))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)


def read_sqlite(spark: SparkSession, path: str | list[str], tables: list[str], columns: list[str], hexed: list[str] | None = None) -> DataFrame:
    """(path, source_table, n, *columns) of a folder, pattern or file, or of several; `hexed` columns as hexadecimal digits of their bytes."""
    spark.dataSource.register(SqliteRows)
    given = json.dumps([path] if isinstance(path, str) else list(path))
    options = {"path": given, "tables": ",".join(tables), "columns": ",".join(columns), "hexed": ",".join(hexed or [])}
    return spark.read.format(NAME).options(**options).load()


class _Probe(_Reader):
    """(path, problem): why a file can't be read as a database, or null."""

    def read(self, partition: _Files) -> Iterator[tuple]:
        for path in partition.paths:
            try:
                db = sqlite3.connect(f"file:{urllib.parse.quote(path)}?mode=ro", uri=True, timeout=1)
                try:
                    db.execute("SELECT count(*) FROM sqlite_master").fetchone()
                    yield path, None
                finally:
                    db.close()
            except sqlite3.Error as problem:
                yield path, str(problem)


class SqliteProbe(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_probe"

    def schema(self) -> str:
        return "path string, problem string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Probe({"tables": "", "columns": "", **self.options})


def probe_sqlite(spark: SparkSession, paths: list[str]) -> DataFrame:
    spark.dataSource.register(SqliteProbe)
    return spark.read.format("sqlite_probe").option("path", json.dumps(paths)).load()


# Names of tables that the tools use, the first there counting.
SESSION_TABLES = ["conversations", "sessions", "chats"]
MESSAGE_TABLES = ["messages", "conversation_messages", "chat_messages"]


def _messages(rows: DataFrame) -> DataFrame:
    """Rows of (conversation_id, order, role, content, model, time, path, cwd) as messages."""
    w = Window.partitionBy("conversation_id").orderBy("order")
    zero = F.lit(0).cast("long")
    out = rows.where("role IS NOT NULL AND trim(content) != ''").withColumn("sequence", (F.row_number().over(w) - 1).cast("int"))
    return out.select(
        "*", S.stable_id(F.col("conversation_id"), F.col("sequence").cast("string")).alias("id"), F.col("role").alias("record_type"), R.running_turn(F.col("role")).alias("turn"),
        F.lit(False).alias("is_sidechain"), F.lit("").alias("parent_message_id"), zero.alias("input_tokens"), zero.alias("output_tokens"), zero.alias("cache_read"), zero.alias("cache_write"),
        F.lit("").alias("thinking_content"), zero.alias("thinking_tokens"), iso_or(F.coalesce("time", F.lit("")), F.lit(None).cast("timestamp")).alias("timestamp"),
    )


def read_kiro(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Conversations and messages of a tool with session and message tables of changing names."""
    heads = read_sqlite(spark, path, SESSION_TABLES, ["id", "title", "cwd", "model"]).select("path", F.col("id").alias("sid"), "title", "cwd", F.col("model").alias("session_model"))
    rows = read_sqlite(spark, path, MESSAGE_TABLES, ["id", "conversation_id", "role", "content", "created_at", "model"]).withColumnRenamed("id", "given")
    joined = rows.join(heads, (rows["path"] == heads["path"]) & (rows["conversation_id"] == heads["sid"])).drop(heads["path"])
    messages = _messages(
        joined.select("path", "conversation_id", F.struct("created_at", "n").alias("order"), role_of(F.col("role")).alias("role"), "content", F.coalesce("model", "session_model", F.lit("")).alias("model"), F.col("created_at").alias("time"), F.coalesce("cwd", F.lit("")).alias("cwd"), "title")
    )
    titles = messages.groupBy(F.col("conversation_id").alias("id")).agg(F.max("title").alias("t"))
    conversations = _conversations(messages, "kiro", "sqlite").join(titles, "id").withColumn("name", F.coalesce(F.nullif("t", F.lit("")), "name")).drop("t")
    return conversations, messages.select(*_MESSAGE)


def read_warp(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """One conversation for each working directory; a query and its response are two messages."""
    rows = read_sqlite(spark, path, ["ai_queries"], ["working_directory", "query", "response", "created_at", "model"])
    cwd = F.coalesce("working_directory", F.lit(""))
    two = F.explode(F.array(F.struct(F.lit(0).alias("k"), F.lit("user").alias("role"), F.col("query").alias("content")), F.struct(F.lit(1).alias("k"), F.lit("assistant").alias("role"), S.strip_ansi(F.col("response")).alias("content"))))
    each = rows.select("path", cwd.alias("cwd"), F.concat(F.lit("warp-"), S.project_id(cwd)).alias("conversation_id"), "created_at", "n", F.coalesce("model", F.lit("")).alias("m"), two.alias("x"))
    messages = _messages(
        each.select("path", "cwd", "conversation_id", F.struct("created_at", "n", "x.k").alias("order"), "x.role", F.coalesce("x.content", F.lit("")).alias("content"), F.when(F.col("x.role") == "assistant", F.col("m")).otherwise("").alias("model"), F.col("created_at").alias("time"))
    )
    return _conversations(messages, "warp", "sqlite"), messages.select(*_MESSAGE)
