"""The engine's tables on disk: Parquet folders by bucket of a key's hash, and one pointer for all tables.

A commit writes only the buckets of the keys that changed, into new folders, and then creates the next pointer, a
small file that names each table's folder for each bucket. Readers follow a pointer, so they see all tables as of one
commit; a failed or lost writer leaves the last pointer in place.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def scratch_path(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; where that is unset, under a temporary one in local mode, else beside the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        local = spark.sparkContext.master.startswith("local")
        root = tempfile.mkdtemp(prefix="convolens-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_convolens_scratch"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/saved-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """`df` written as Parquet to the shared folder and read back: its lineage ends there."""
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Buckets of a table: a conversation that changed rewrites one of so many parts. A store keeps the number it began with.
BUCKETS = 32


@dataclass(frozen=True)
class Snapshot:
    """What a pointer names: of each table the folder of each bucket that has rows."""

    version: int = 0
    buckets: int = BUCKETS
    folders: dict[str, dict[int, str]] = field(default_factory=dict)


class Buckets:
    """Tables under one root; `kinds` gives each table's schema and key column.

    `layouts` gives a column by which a table's buckets are parted further, and one by which the rows of a part are sorted.
    """

    def __init__(self, spark: SparkSession, root: str, kinds: dict[str, tuple[StructType, str]], buckets: int = BUCKETS, layouts: dict[str, tuple[str, str]] | None = None):
        self.spark, self.root, self.kinds, self.buckets, self.layouts = spark, root.rstrip("/"), kinds, buckets, layouts or {}
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _names(self, folder: str) -> list[str]:
        path = self._path(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def _pointer(self, name: str) -> Snapshot | None:
        """None while its writer hasn't closed it."""
        stream = self._fs.open(self._path(f"{self.root}/versions/{name}"))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        if not text:
            return None
        found = json.loads(text)
        return Snapshot(int(name), found["buckets"], {t: {int(b): f for b, f in folders.items()} for t, folders in found["folders"].items()})

    def snapshot(self) -> Snapshot:
        """The newest commit; version 0 before the first."""
        for name in reversed(self._names("versions")):
            if found := self._pointer(name):
                return found
        return Snapshot(buckets=self.buckets)

    def bucket(self, key: Column | str, snapshot: Snapshot) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(snapshot.buckets)).cast("int")

    def read(self, name: str, snapshot: Snapshot | None = None, only: set[int] | None = None) -> DataFrame:
        """A table as of `snapshot`, or its buckets `only`."""
        folders = (snapshot or self.snapshot()).folders.get(name, {})
        paths = [f"{self.root}/{f}" for b, f in sorted(folders.items()) if only is None or b in only]
        schema = self.kinds[name][0]
        if not paths:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema)
        if name in self.layouts:  # parts of buckets are told by folders between this one and the files
            reader = reader.option("basePath", f"{self.root}/data/{name}")
        return reader.parquet(*paths).select(schema.fieldNames())

    def touched(self, name: str, keys: DataFrame, snapshot: Snapshot) -> set[int]:
        """The buckets of `keys`, a table with the key column: at most as many as there are."""
        return {r[0] for r in keys.select(self.bucket(self.kinds[name][1], snapshot).alias("b")).distinct().collect()}

    def _written(self, snapshot: Snapshot, name: str, rows: DataFrame, keys: DataFrame) -> tuple[set[int], dict[int, str]]:
        """Writes the buckets of `keys` anew: these buckets, and the folders of those that have rows."""
        schema, key = self.kinds[name]
        ids = keys.select(key).distinct()
        buckets = self.touched(name, ids, snapshot)
        if not buckets:
            return buckets, {}
        old = self.read(name, snapshot, buckets).join(ids, key, "left_anti")
        folder = f"data/{name}/commit={snapshot.version + 1:010d}-{uuid.uuid4().hex}"
        new = old.select(schema.fieldNames()).unionByName(rows.select(schema.fieldNames())).withColumn("bucket", self.bucket(key, snapshot))
        part, order = self.layouts.get(name, (None, None))
        by = ["bucket", part] if part else ["bucket"]
        dealt = new.hint("rebalance", *by)
        dealt = dealt.sortWithinPartitions(*by, order) if order else dealt
        dealt.write.partitionBy(*by).parquet(f"{self.root}/{folder}")
        return buckets, {int(n.split("=")[1]): f"{folder}/{n}" for n in self._names(folder) if n.startswith("bucket=")}

    def commit(self, snapshot: Snapshot, changes: dict[str, tuple[DataFrame, DataFrame]]) -> Snapshot:
        """The commit after `snapshot`, in which each table of `changes` has new rows in place of those of some keys.

        A change is (rows, keys): rows whose key is among `keys` go and `rows`, which have only such keys, come. The pointer is named by its version
        alone and created only where there is none, so of two writers of one version the second fails.
        """
        folders = {t: dict(f) for t, f in snapshot.folders.items()}
        with ThreadPoolExecutor(len(changes)) as pool:  # tables are written side by side
            for name, (buckets, there) in zip(changes, pool.map(lambda c: self._written(snapshot, c, *changes[c]), changes)):
                folders[name] = {b: f for b, f in folders.get(name, {}).items() if b not in buckets} | there
        version = snapshot.version + 1
        if self.snapshot().version != snapshot.version:
            raise RuntimeError(f"version {version} was committed after {snapshot.version} was read")
        try:
            stream = self._fs.create(self._path(f"{self.root}/versions/{version:010d}"), False)
        except Exception as taken:
            raise RuntimeError(f"another writer committed version {version}") from taken
        stream.write(bytearray(json.dumps({"buckets": snapshot.buckets, "folders": folders}).encode()))
        stream.close()
        return Snapshot(version, snapshot.buckets, folders)

    def vacuum(self, keep: int = 2) -> None:
        """Deletes all pointers but the last `keep`, and what only they named. Folders of a later writer stay."""
        names = self._names("versions")
        kept = [s for s in map(self._pointer, names[-keep:]) if s]
        for name in names[:-keep]:
            self._fs.delete(self._path(f"{self.root}/versions/{name}"), False)
        used = {f for s in kept for folders in s.folders.values() for f in folders.values()}
        for table in self.kinds:
            for version in self._names(f"data/{table}"):
                if kept and int(version.split("=")[-1].split("-")[0]) <= kept[-1].version:
                    for bucket in self._names(f"data/{table}/{version}"):
                        if f"data/{table}/{version}/{bucket}" not in used and bucket.startswith("bucket="):
                            self._fs.delete(self._path(f"{self.root}/data/{table}/{version}/{bucket}"), True)
