"""Filters, lists and lookups over conversations."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..model import RELATIONSHIPS

SEARCHED = ("id", "trace_id", "parent_id", "relationship", "adapter_id", "name", "cwd", "git_remote", "branch", "model", "source_path")


@dataclass(frozen=True)
class Filters:
    """Optional conditions; None or an empty text leaves one out."""

    adapter: str | None = None
    since: str | None = None
    remote: str | None = None
    relationship: str | None = None
    search: str | None = None

    def condition(self) -> Column:
        parts = [F.lit(True)]
        for column, value in (("adapter_id", self.adapter), ("git_remote", self.remote), ("relationship", self.relationship)):
            if value:
                parts.append(F.col(column) == value)
        if self.since:
            parts.append(S.activity() >= self.since)
        if (text := (self.search or "").strip().lower()):  # % and _ stay wildcards
            parts.append(reduce(lambda a, b: a | b, (F.lower(F.coalesce(F.col(c), F.lit(""))).like(f"%{text}%") for c in SEARCHED)))
        return reduce(lambda a, b: a & b, parts)


def newest_first() -> list[Column]:
    return [S.activity().desc(), F.col("started_at").desc(), F.col("id").asc()]


def list_conversations(conversations: DataFrame, filters: Filters = Filters(), limit: int | None = None, offset: int = 0) -> DataFrame:
    """Newest first; an offset counts only with a limit."""
    out = conversations.where(filters.condition()).orderBy(*newest_first())
    if limit and limit > 0:
        out = (out.offset(offset) if offset > 0 else out).limit(limit)
    return out


def page(conversations: DataFrame, filters: Filters, limit: int, offset: int) -> DataFrame:
    """One row: total_count (adapter and time only), filtered_count, has_more, next_offset, by one aggregation."""
    wide = Filters(adapter=filters.adapter, since=filters.since).condition()
    counts = conversations.agg(F.count_if(wide).alias("total_count"), F.count_if(filters.condition()).alias("filtered_count"))
    more = F.col("filtered_count") > offset + limit
    return counts.withColumns({"has_more": more, "next_offset": F.when(more, F.lit(offset + limit))})


def count_conversations(conversations: DataFrame, filters: Filters = Filters()) -> DataFrame:
    return conversations.where(filters.condition()).agg(F.count("*").alias("conversations"))


def distinct_values(conversations: DataFrame, column: str, filters: Filters = Filters()) -> DataFrame:
    return conversations.where(filters.condition() & (F.col(column) != "")).select(column).distinct().orderBy(column)


def relationship_mix(conversations: DataFrame, filters: Filters = Filters()) -> DataFrame:
    out = conversations.where(filters.condition()).groupBy("relationship").agg(F.count("*").alias("conversations"))
    return out.orderBy(F.desc("conversations"), "relationship")


def match_id(conversations: DataFrame, text: str, limit: int = 10) -> DataFrame:
    """The exact id first, then ids that start with `text` in any case, newest first."""
    text = text.strip()
    if not text:
        return conversations.limit(0)
    found = conversations.where((F.col("id") == text) | F.lower("id").like(text.lower() + "%"))
    return found.orderBy(F.when(F.col("id") == text, 0).otherwise(1), S.activity().desc(), "id").limit(limit)


def resolve_id(conversations: DataFrame, text: str) -> tuple[str, list[str]]:
    """('found' | 'ambiguous' | 'missing', ids)."""
    ids = [r["id"] for r in match_id(conversations, text).select("id").collect()]
    if text.strip() in ids:
        return "found", [text.strip()]
    return ("missing", []) if not ids else ("found", ids) if len(ids) == 1 else ("ambiguous", ids)


def session_shape(conversations: DataFrame) -> DataFrame:
    """The short form that lists show; total_tokens are input and output only."""
    return conversations.select(
        "id",
        "name",
        F.col("adapter_id").alias("adapter"),
        F.col("relationship").isin("spawned", "forked").alias("is_sub_agent"),
        (F.col("relationship") == "compacted").alias("is_compacted"),
        (F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"),
        "message_count",
    )


def message_shape(messages: DataFrame) -> DataFrame:
    """Messages with their thinking as an array of none or one block."""
    block = F.struct(F.col("thinking_content").alias("content"), F.col("thinking_tokens").alias("tokens"))
    blocks = F.when(F.col("thinking_content") != "", F.array(block)).otherwise(F.array_remove(F.array(block), block))
    return messages.select("id", "conversation_id", "role", "content", "sequence", "turn", blocks.alias("thinking_blocks"))


def ordered_messages(messages: DataFrame) -> DataFrame:
    return messages.orderBy("conversation_id", "sequence", "id")


def ordered_tool_calls(tool_calls: DataFrame, messages: DataFrame) -> DataFrame:
    """Tool calls with their message's sequence, 0 where the message is missing."""
    order = messages.select("conversation_id", F.col("id").alias("message_id"), F.col("sequence").alias("message_sequence"))
    joined = tool_calls.join(order, ["conversation_id", "message_id"], "left")
    return joined.withColumn("message_sequence", F.coalesce("message_sequence", F.lit(0))).orderBy("conversation_id", "message_sequence", "id")


def messages_with_tools(messages: DataFrame, tool_calls: DataFrame) -> DataFrame:
    """Each message with its calls nested in the order of their ids; calls are gathered per message before the join."""
    calls = tool_calls.groupBy("conversation_id", "message_id").agg(F.array_sort(F.collect_list(F.struct("id", "name", "is_error"))).alias("tool_uses"))
    joined = messages.join(calls, (messages["conversation_id"] == calls["conversation_id"]) & (messages["id"] == calls["message_id"]), "left")
    return joined.drop(calls["conversation_id"]).drop("message_id")


def first_hit_each(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def clamp(value: int | None, default: int, most: int, least: int = 0) -> int:
    """Of request values: missing or wrong ones become the default."""
    return default if value is None or value < least else min(value, most)


def known_relationship(text: str | None) -> str | None:
    return text if text in RELATIONSHIPS else None
