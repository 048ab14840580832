"""Incremental ingest and push: changed files, hash-gated revisions, dirty sets, sinks.

A file that grew is read again whole, since a message may complete what stood before it; which files changed is told
by their size and time. A batch is one commit of all tables, which rewrites the buckets of the conversations that
changed; a batch that failed is done again and one that was done twice changes nothing. A file that can't be read is
put down with its problem and tried again next time, while the others of its batch go on.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..model import CONVERSATION, MESSAGE, PUSH_STATE, SYNC, TOOL_CALL, Store
from ..operators import graph as G
from ..operators import rollup as R
from ..operators import routing as P
from ..operators import search as FT
from ..operators import sync as Y
from ..operators.upkeep import config_fingerprint
from ..sources import discovery as D
from ..sources import logs
from ..sources.readers import READERS, WHOLE
from ..sources.sqlite import probe_sqlite
from ..sources.transcripts import fork_points
from .growing import growing_files
from .state import BUCKETS, Buckets, Snapshot, saved

_FILE = [T.StructField("adapter_id", T.StringType()), T.StructField("path", T.StringType()), T.StructField("size", T.LongType()), T.StructField("mtime", T.LongType())]
SOURCE_STATE = T.StructType([*_FILE, T.StructField("fingerprint", T.StringType())])
FAILURE = T.StructType([*_FILE, T.StructField("problem", T.StringType()), T.StructField("failed_at", T.StringType())])
POSTING = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("word", "conversation_id", "id")]
    + [T.StructField(n, T.IntegerType()) for n in ("sequence", "dl")]
    + [T.StructField("places", T.ArrayType(T.IntegerType())), T.StructField("part", T.IntegerType())]
)
#: What of a conversation is in the index: the hash of its content then, its messages and their words.
INDEXED = T.StructType([T.StructField(n, T.StringType()) for n in ("conversation_id", "content_hash")] + [T.StructField(n, T.LongType()) for n in ("messages", "words")])
KINDS = {
    "conversations": (CONVERSATION, "id"), "messages": (MESSAGE, "conversation_id"), "tool_calls": (TOOL_CALL, "conversation_id"),
    "sync": (SYNC, "conversation_id"), "push_state": (PUSH_STATE, "conversation_id"), "sources": (SOURCE_STATE, "path"), "failures": (FAILURE, "path"),
    "postings": (POSTING, "conversation_id"), "indexed": (INDEXED, "conversation_id"),
}
#: Adapters whose traces follow parent links, those whose fork points are calls of the parent, and those that read databases.
BY_LINKS, BY_CALLS, DATABASES = ("codex", "cursor"), ("claude-code",), ("cursor", "kiro", "warp")
#: Version of what readers make of a file; another one, as other settings, has all files read again.
PAYLOAD_VERSION, CONTRACT_VERSION = 1, 1
#: Conversations that are sent and recorded at a time; those due are numbered in parts of so many.
PUSH_BATCH, PUSH_PART = 20, 100_000


def _now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"


def plain_path(path: Column | str) -> Column:
    """A local file's path without its scheme, as listings, readers and databases may or may not write it."""
    return F.url_decode(F.regexp_replace(F.regexp_replace(path, "^file:/+", "/"), r"\+", "%2B"))


class Engine:
    """The tables under one root folder, and what changes them."""

    def __init__(self, spark: SparkSession, root: str, clock: Callable[[], str] = _now, buckets: int = BUCKETS):
        self.spark, self.clock, self.root = spark, clock, root
        self.tables = Buckets(spark, root, KINDS, buckets, {"postings": ("part", "word")})

    def store(self) -> Store:
        """All tables as of one commit."""
        now = self.tables.snapshot()
        return Store(*(self.tables.read(n, now) for n in ("conversations", "messages", "tool_calls", "sync", "push_state")))

    def failures(self) -> DataFrame:
        """Files that couldn't be read when last tried."""
        return self.tables.read("failures")

    def changed_sources(self, adapter: str, listed: DataFrame, snapshot: Snapshot | None = None, fingerprint: str | None = None) -> DataFrame:
        """(path, change) of files that are new, changed or gone; of those read under other settings too, where a `fingerprint` is given.

        A store without conversations takes all files as new.
        """
        now = snapshot or self.tables.snapshot()
        known = self.tables.read("sources", now).where(F.col("adapter_id") == adapter)
        known = known.where(F.col("fingerprint") == fingerprint) if fingerprint else known
        return Y.source_diff(known if now.folders.get("conversations") else known.limit(0), listed)

    def ingest(self, adapter: str, path: str, allow_protected: bool = False) -> int:
        """Reads the files of `path` that changed; returns how many conversations changed. The engine's own files are left out.

        What is known of a file holds for the settings it was read under: others have it read again.
        """
        fingerprint = f"{PAYLOAD_VERSION}:{config_fingerprint(adapter, CONTRACT_VERSION, data_dir=path, allow_protected=allow_protected)}"
        now = self.tables.snapshot()
        # names, sizes and times as of one moment: a later change shows next time
        listed = saved(logs.listing(self.spark, path).where(D.not_own(plain_path("path"), re.sub("^file:/+", "/", self.root))))
        changes = self.changed_sources(adapter, listed, now, fingerprint).where("change != 'removed'").select("path")
        files = saved(listed.join(changes, "path", "left_semi").withColumn("adapter_id", F.lit(adapter)))
        paths = [r["path"] for r in files.select("path").collect()]  # Spark's readers take names
        if not paths:
            return 0
        conversations, messages, tool_calls = READERS[adapter](self.spark, paths)
        conversations = saved(conversations)
        failed = self._failed(adapter, files, conversations)
        done = files.join(failed.select("path"), "path", "left_anti").withColumn("fingerprint", F.lit(fingerprint))
        more = {"sources": (done, done), "failures": (failed.withColumn("failed_at", F.lit(self.clock())), files)}
        return self.write(conversations, messages, tool_calls, more, now)

    def _failed(self, adapter: str, files: DataFrame, conversations: DataFrame) -> DataFrame:
        """`files` that gave no conversation and can't be read, with their problem. Only files without a conversation are looked at again."""
        read = conversations.select(plain_path("source_path").alias("plain")).distinct()
        silent = saved(files.where("size > 0").withColumn("plain", plain_path("path")).join(read, "plain", "left_anti"))
        paths = [r["path"] for r in silent.select("path").collect()]
        if not paths:
            return silent.drop("plain").withColumn("problem", F.lit(""))
        if adapter in DATABASES:
            found = probe_sqlite(self.spark, paths).where("problem IS NOT NULL")
        else:
            text = self.spark.read.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).option("wholetext", adapter in WHOLE).text(paths)
            rows = text.select(F.col("_metadata")["file_path"].alias("path"), F.try_parse_json("value").isNotNull().alias("good"), (F.trim("value") != "").alias("said"))
            seen = rows.groupBy("path").agg(F.count_if("said").alias("lines"), F.count_if("good").alias("good"))
            found = seen.where("lines > 0 AND good = 0").select("path", F.format_string("none of %d lines is JSON", "lines").alias("problem"))
        found = found.select(plain_path("path").alias("plain"), "problem")
        return saved(silent.join(found, "plain").drop("plain"))

    def write(self, conversations: DataFrame, messages: DataFrame, tool_calls: DataFrame, more: dict | None = None, snapshot: Snapshot | None = None) -> int:
        """Takes in whole conversations in one commit, with the changes `more` of other tables; returns how many changed.

        Those whose content hash is known only get a new time. Traces and fork points are worked out over what is
        stored too, so that a parent that comes later moves its descendants as if all had come at once.
        """
        now = snapshot or self.tables.snapshot()
        conversations, messages, tool_calls = conversations.cache(), messages.cache(), tool_calls.cache()
        came = conversations.select(F.col("id").alias("conversation_id"))
        hashes = Y.bundle_hash(conversations, messages, tool_calls)
        before = self._of("sync", came, now)
        state = Y.revise(before, hashes, self.clock()).cache()
        ids = state.where("changed").select("conversation_id").cache()
        changed = ids.count()
        keys = ids.withColumnRenamed("conversation_id", "id")
        m, t = (df.join(ids, "conversation_id", "left_semi") for df in (messages, tool_calls))
        own, moved = self._linked(conversations.join(keys, "id", "left_semi"), keys, m, t, now)
        moved_ids = moved.select(F.col("id").alias("conversation_id"))
        touched = came.unionByName(moved_ids).distinct()
        known = self._of("sync", moved_ids, now).join(came, "conversation_id", "left_anti")
        sync = Y.raised(state.drop("changed").unionByName(known), moved_ids)
        changes = {"messages": (m, ids), "tool_calls": (t, ids), "conversations": (R.conversation_rollup(own, m, t).unionByName(moved), keys.unionByName(moved.select("id"))), "sync": (sync, touched)}
        self.tables.commit(now, changes | (more or {}))
        for df in (conversations, messages, tool_calls, state, ids):
            df.unpersist()
        return changed

    def _of(self, name: str, ids: DataFrame, snapshot: Snapshot) -> DataFrame:
        """The rows of a table that have a conversation of `ids`, read from their buckets alone."""
        key = KINDS[name][1]
        wanted = ids.select(F.col("conversation_id").alias(key)).distinct()
        return self.tables.read(name, snapshot, self.tables.touched(name, wanted, snapshot)).join(wanted, key, "left_semi")

    def _linked(self, own: DataFrame, keys: DataFrame, messages: DataFrame, tool_calls: DataFrame, now: Snapshot) -> tuple[DataFrame, DataFrame]:
        """`own`, the conversations that changed, with traces and fork points over all; and stored ones that get others."""
        kinds = {r[0] for r in own.select("adapter_id").distinct().collect()}
        stored = self.tables.read("conversations", now).join(keys, "id", "left_anti")
        moved = stored.limit(0)
        if kinds & set(BY_LINKS):
            link = ["id", "parent_id", "trace_id"]
            traced = F.col("adapter_id").isin(*BY_LINKS)
            found = saved(G.top_traces(saved(own.where(traced).select(link).unionByName(stored.where(traced).select(link)))))
            own = own.join(found, "id", "left").withColumn("trace_id", F.coalesce("trace", "trace_id")).drop("trace")
            moved = saved(stored.join(found, "id").where("trace != trace_id").withColumn("trace_id", F.col("trace")).drop("trace"))
        if kinds & set(BY_CALLS):
            lost = (F.col("relationship") == "spawned") & (F.col("fork_point") == -1) & F.col("adapter_id").isin(*BY_CALLS)
            late = stored.where(lost).join(keys.select(F.col("id").alias("parent_id")), "parent_id", "left_semi")
            waiting = saved(own.where(lost).select("id", "parent_id", "relationship", "fork_point").unionByName(late.select("id", "parent_id", "relationship", "fork_point")))
            parents = waiting.select(F.col("parent_id").alias("conversation_id")).distinct()
            away = parents.join(keys, parents["conversation_id"] == keys["id"], "left_anti")
            m, t = (df.join(parents, "conversation_id", "left_semi").unionByName(self._of(n, away, now).select(df.columns)) for df, n in ((messages, "messages"), (tool_calls, "tool_calls")))
            found = saved(fork_points(waiting, m, t).where("fork_point != -1").select("id", F.col("fork_point").alias("found")))
            own = own.join(found, "id", "left").withColumn("fork_point", F.coalesce("found", "fork_point")).drop("found")
            moved = moved.unionByName(late.join(found, "id").withColumn("fork_point", F.col("found")).select(moved.columns))
        return own.cache(), moved.cache()

    def index(self) -> int:
        """Brings the postings up to the stored conversations in one commit; returns how many were tokenised.

        A conversation is indexed again when its content hash is another; the words of the others aren't touched.
        """
        now = self.tables.snapshot()
        seen = self.tables.read("indexed", now).select("conversation_id", F.col("content_hash").alias("old"))
        due = self.tables.read("sync", now).join(seen, "conversation_id", "left").where("NOT (old <=> content_hash)")
        due = saved(due.select("conversation_id", "content_hash"))
        n = due.count()
        if not n:
            return 0
        messages = self._of("messages", due, now)
        sizes = messages.groupBy("conversation_id").agg(F.count("*").alias("messages"), F.sum(F.size(FT.tokens(F.col("content")))).cast("long").alias("words"))
        zero = F.lit(0).cast("long")
        state = due.join(sizes, "conversation_id", "left").select("conversation_id", "content_hash", F.coalesce("messages", zero).alias("messages"), F.coalesce("words", zero).alias("words"))
        self.tables.commit(now, {"postings": (FT.placed_postings(messages), due), "indexed": (state, due)})
        return n

    def search(self, terms: FT.Terms, adapter: str | None = None, since: str | None = None, limit: int | None = 20) -> DataFrame:
        """Hits by rank from the postings as they are; `index` brings them up to date. Files of other words aren't read."""
        now = self.tables.snapshot()
        messages, words = self.tables.read("indexed", now).agg(F.sum("messages"), F.sum("words")).first()
        mean = words / messages if messages else None
        return FT.search_postings(self.tables.read("postings", now), messages or 0, mean, self.tables.read("conversations", now), terms, adapter, since, limit)

    def watch(self, adapter: str, path: str, checkpoint: str, seconds: int = 60, once: bool = False) -> StreamingQuery:
        """A stream that ingests `path` again at each trigger that sees a new, grown or rewritten file; `once`: what there is now, then stop.

        A folder of a store that only Spark reaches is watched by Spark's file source, which sees new names alone.
        """
        local = path.startswith(("/", "file:"))
        seen = growing_files(self.spark, path) if local else self.spark.readStream.option("recursiveFileLookup", True).text(path)
        trigger = {"availableNow": True} if once else {"processingTime": f"{seconds} seconds"}
        return seen.writeStream.foreachBatch(lambda _df, _n: self.ingest(adapter, path)).option("checkpointLocation", checkpoint).trigger(**trigger).start()

    def payloads(self, sink: str, routes: list[P.Route]) -> DataFrame:
        """The conversations that the sink needs and rules send there, each with its messages and calls, as JSON."""
        s = self.store()
        due = Y.needs_push(s.sync, s.push_state, sink).select(F.col("conversation_id").alias("id"), F.col("local_revision").alias("revision"))
        mine = P.routed(s.conversations.join(due, "id"), routes).where(F.array_contains("sinks", sink)).drop("sinks")
        m = s.messages.join(mine.select(F.col("id").alias("conversation_id")), "conversation_id", "left_semi")
        t = s.tool_calls.join(mine.select(F.col("id").alias("conversation_id")), "conversation_id", "left_semi")
        messages = m.groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct("sequence", *(c for c in m.columns if c != "sequence")))).alias("messages"))
        calls = t.groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct("id", *(c for c in t.columns if c != "id")))).alias("tool_calls"))
        joined = mine.join(messages, mine["id"] == messages["conversation_id"], "left").drop("conversation_id").join(calls, mine["id"] == calls["conversation_id"], "left").drop("conversation_id")
        body = F.to_json(F.struct(F.struct(*mine.columns).alias("conversation"), "messages", "tool_calls"))
        return joined.select("id", "adapter_id", "revision", F.concat_ws(":r", "id", F.col("revision").cast("string")).alias("idempotency_key"), body.alias("body"))

    def push(self, sink: str, routes: list[P.Route], send: Callable[[DataFrame], DataFrame], batch: int = PUSH_BATCH) -> int:
        """Sends what is due, `batch` conversations at a time, and records each batch before the next; returns how many were sent.

        `send` gives (id, ok, error). When it fails, the batches before it stay recorded; what isn't recorded is sent
        again with the same key. A revision that came meanwhile stays due, since the one that was sent is recorded.
        """
        due = saved(self.payloads(sink, routes))
        n = due.count()
        part = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n // PUSH_PART))))
        nth = F.row_number().over(Window.partitionBy("part").orderBy("id")) - 1
        dealt = saved(due.withColumn("part", part).withColumn("batch", F.floor(nth / batch)))
        for key in sorted(map(tuple, dealt.select("part", "batch").distinct().collect())):
            rows = dealt.where((F.col("part") == key[0]) & (F.col("batch") == key[1])).drop("part", "batch")
            self._record(sink, saved(send(rows).join(rows.select("id", "revision"), "id")))
        return n

    def _record(self, sink: str, results: DataFrame) -> None:
        now = self.tables.snapshot()
        rows = results.select(F.col("id").alias("conversation_id"), F.lit(sink).alias("sink_id"), "revision", "ok", "error")
        ids = rows.select("conversation_id")
        self.tables.commit(now, {"push_state": (Y.record_push(self._of("push_state", ids, now), rows, self.clock()), ids)})

    def repush(self, sink: str) -> dict:
        """Forgets what the sink has taken; the counts of rows cleared and of conversations due before and after."""
        now = self.tables.snapshot()
        state = self.tables.read("push_state", now)
        kept, counts = Y.reset_push(self.tables.read("sync", now), state, sink)
        out = counts.first().asDict()
        ids = state.where(F.col("sink_id") == sink).select("conversation_id")
        self.tables.commit(now, {"push_state": (kept.join(ids, "conversation_id", "left_semi"), ids)})
        return out
