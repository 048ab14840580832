"""Shared helpers: scratch tables in the cluster's shared folder, column names, Arrow results."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Maps A-Z to a-z and leaves every other character as it is.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys that can each hold over one in so many of the rows: what `join_counted` sends to every task.
HOT_KEYS = 4096


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset, one of our own.

    In local mode that is a temporary folder (driver and executors are one process), elsewhere a
    folder beside the warehouse, which every executor sees.
    """
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        own = tempfile.mkdtemp(prefix="convolens-")
    else:
        own = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_convolens_scratch"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


class Scratch:
    """Intermediate tables of one operator call, written as Parquet to the shared folder.

    A written table cuts the lineage: when an executor is lost its tasks read the files again.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self.count = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}", 0

    def table(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Writes `df` and returns it as read back."""
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Deletes a table that `table` made and nothing reads any more."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def join_counted(rows: DataFrame, counted: DataFrame, keys: list[str]) -> DataFrame:
    """The inner join of `rows` with `counted`, a written table of one row a key; its n counts the key's rows.

    Keys with over 1 / HOT_KEYS of all counted rows, so fewer than HOT_KEYS keys, are sent to every task; the rows
    they meet are dealt by all their columns, so that none of the hot keys lies whole in one task. `rows` has
    none of the columns of `counted` but the keys, which aren't null.
    """
    total = counted.agg(F.sum("n")).first()[0] or 0
    hot, values = F.col("n") > total / HOT_KEYS, F.struct(*(c for c in counted.columns if c not in keys))
    few = counted.where(hot).select(*(F.col(k).alias(f"hot_{k}") for k in keys), values.alias("hot"))
    rest = counted.where(~hot).select(*(F.col(k).alias(f"cold_{k}") for k in keys), F.xxhash64(*keys).alias("cold_deal"), values.alias("cold"))
    met = rows.join(F.broadcast(few), [F.col(k) == F.col(f"hot_{k}") for k in keys], "left")
    met = met.withColumn("deal", F.when(F.col("hot").isNull(), F.xxhash64(*keys)).otherwise(F.xxhash64(*rows.columns)))
    same = [F.col(k) == F.col(f"cold_{k}") for k in keys]
    met = met.join(rest, [*same, F.col("deal") == F.col("cold_deal")], "left").withColumn("found", F.coalesce("hot", "cold"))
    return met.where("found IS NOT NULL").select(*rows.columns, *(F.col(f"found.{c}") for c in counted.columns if c not in keys))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that `df` doesn't have in any case, made from `names`."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def replaced(batch: pa.RecordBatch, name: str, values: Iterable) -> pa.RecordBatch:
    """`batch` with the column `name` holding `values`."""
    at = batch.schema.get_field_index(name)
    arrays = list(batch.columns)
    arrays[at] = pa.array(values, type=batch.schema.field(at).type)
    return pa.RecordBatch.from_arrays(arrays, schema=batch.schema)
