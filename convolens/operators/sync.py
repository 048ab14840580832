"""Incremental state: content hashes and revisions, the dirty set, what was pushed, and which sources changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import CONVERSATION, MESSAGE, TOOL_CALL

#: What a rollup or the rows of other conversations decide.
_DERIVED = {"trace_id", "fork_point", "duration_ms", "message_count", "tool_count", "turn_count", "input_tokens", "output_tokens", "cache_read", "cache_write", "est_cost"}


def bundle_hash(conversations: DataFrame, messages: DataFrame, tool_calls: DataFrame) -> DataFrame:
    """(conversation_id, content_hash): of what adapters gave, messages by sequence, calls by id."""
    body = F.sha2(F.to_json(F.struct(*(c for c in MESSAGE.fieldNames() if c in messages.columns))), 256)
    calls = F.sha2(F.to_json(F.struct(*(c for c in TOOL_CALL.fieldNames() if c in tool_calls.columns))), 256)
    m = messages.groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct("sequence", "id", body.alias("b")))).alias("m"))
    t = tool_calls.groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct("message_id", "id", calls.alias("b")))).alias("t"))
    own = [c for c in CONVERSATION.fieldNames() if c in conversations.columns and c not in _DERIVED]
    rows = conversations.select(F.col("id").alias("conversation_id"), F.to_json(F.struct(*own)).alias("c"))
    joined = rows.join(m, "conversation_id", "left").join(t, "conversation_id", "left")
    return joined.select("conversation_id", F.sha2(F.to_json(F.struct("c", "m", "t")), 256).alias("content_hash"))


def raised(sync: DataFrame, moved: DataFrame) -> DataFrame:
    """`sync` with one revision more for the conversations in `moved` (conversation_id): what links decide has changed."""
    up = moved.select("conversation_id", F.lit(1).cast("long").alias("more"))
    joined = sync.join(up, "conversation_id", "left")
    return joined.withColumn("local_revision", F.col("local_revision") + F.coalesce("more", F.lit(0))).drop("more")


def revise(sync: DataFrame, hashes: DataFrame, now: str) -> DataFrame:
    """The next state and whether each conversation changed: a new hash raises the revision, an equal one
    only touches the time; conversations not in `hashes` stay."""
    new = hashes.select("conversation_id", F.col("content_hash").alias("new_hash"))
    joined = sync.join(new, "conversation_id", "full")
    changed = F.col("new_hash").isNotNull() & ~F.col("new_hash").eqNullSafe(F.col("content_hash"))
    seen = F.col("new_hash").isNotNull()
    return joined.select(
        "conversation_id",
        F.coalesce("new_hash", "content_hash").alias("content_hash"),
        (F.coalesce("local_revision", F.lit(0).cast("long")) + changed.cast("long")).alias("local_revision"),
        F.when(seen, F.lit(now)).otherwise(F.col("ingested_at")).alias("ingested_at"),
        changed.alias("changed"),
    )


def needs_push(sync: DataFrame, push_state: DataFrame, sink: str) -> DataFrame:
    """Conversations whose revision the sink hasn't taken; the sink's rows are picked before the join."""
    own = push_state.where(F.col("sink_id") == sink).select("conversation_id", "last_successful_revision")
    joined = sync.join(own, "conversation_id", "left")
    return joined.where(F.coalesce("last_successful_revision", F.lit(0)) < F.col("local_revision")).select("conversation_id", "local_revision").orderBy("conversation_id")


def missing_sync(conversations: DataFrame, sync: DataFrame) -> DataFrame:
    return conversations.select("id").join(sync.select(F.col("conversation_id").alias("id")), "id", "left_anti").orderBy("id")


def record_push(push_state: DataFrame, results: DataFrame, now: str) -> DataFrame:
    """The next state: `results` has conversation_id, sink_id, revision, ok, error. A failure keeps the last success."""
    key = ["conversation_id", "sink_id"]
    joined = push_state.join(results, key, "full")
    tried, ok = F.col("revision").isNotNull(), F.coalesce("ok", F.lit(False))

    def pick(success: Column, failure: Column, old: Column) -> Column:
        return F.when(~tried, old).when(ok, success).otherwise(failure)

    c = F.col
    revision, zero, empty, at = c("revision"), F.lit(0).cast("long"), F.lit(""), F.lit(now)
    return joined.select(
        *key,
        pick(revision, revision, c("last_attempted_revision")).alias("last_attempted_revision"),
        pick(revision, F.coalesce("last_successful_revision", zero), c("last_successful_revision")).alias("last_successful_revision"),
        pick(at, at, c("last_attempted_at")).alias("last_attempted_at"),
        pick(at, F.coalesce("last_successful_at", empty), c("last_successful_at")).alias("last_successful_at"),
        pick(empty, F.coalesce("error", empty), c("last_error")).alias("last_error"),
    )


def reset_push(sync: DataFrame, push_state: DataFrame, sink: str) -> tuple[DataFrame, DataFrame]:
    """The state without the sink's rows; one row of cleared_rows, dirty_before, dirty_after."""
    kept = push_state.where(F.col("sink_id") != sink)
    cleared = push_state.where(F.col("sink_id") == sink).agg(F.count("*").alias("cleared_rows"))
    before = needs_push(sync, push_state, sink).agg(F.count("*").alias("dirty_before"))
    after = needs_push(sync, kept, sink).agg(F.count("*").alias("dirty_after"))
    return kept, cleared.join(before).join(after)  # one row each


def source_diff(known: DataFrame, listed: DataFrame) -> DataFrame:
    """(path, change): fresh, changed (size or time differ) or removed; both have path, size, mtime."""
    old = known.select("path", F.col("size").alias("old_size"), F.col("mtime").alias("old_mtime"))
    joined = listed.join(old, "path", "full")
    change = (
        F.when(F.col("old_size").isNull(), "fresh")
        .when(F.col("size").isNull(), "removed")
        .when((F.col("size") != F.col("old_size")) | (F.col("mtime") != F.col("old_mtime")), "changed")
    )
    return joined.select("path", change.alias("change")).where("change IS NOT NULL")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """`old` with the rows of the keys in `new` replaced by those of `new`."""
    return old.join(new.select(keys).distinct(), keys, "left_anti").unionByName(new)
