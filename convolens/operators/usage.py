"""Usage aggregates and the chart model over them. Money is rounded at the end, past what any price can give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..model import TOKENS

MONEY_DIGITS = 10


def _tokens() -> Column:
    return sum((F.col(t) for t in TOKENS[1:]), F.col(TOKENS[0]))


def _sum(column: Column, name: str) -> Column:
    return F.coalesce(F.sum(column), F.lit(0)).cast("long").alias(name)


def _cost(name: str = "cost") -> Column:
    return F.round(F.coalesce(F.sum("est_cost"), F.lit(0.0)), MONEY_DIGITS).alias(name)


def overview(conversations: DataFrame) -> DataFrame:
    return conversations.agg(
        F.count("*").alias("conversations"),
        _sum(F.col("message_count"), "messages"),
        _sum(F.col("tool_count"), "tool_calls"),
        _sum(_tokens(), "tokens"),
        _sum(F.col("input_tokens") + F.col("output_tokens"), "display_tokens"),
        _sum(F.col("cache_read") + F.col("cache_write"), "cache_tokens"),
        _cost(),
        F.countDistinct("trace_id").alias("traces"),
        F.countDistinct(F.when(F.col("git_remote") != "", F.col("git_remote"))).alias("projects"),
    )


def by_adapter(conversations: DataFrame) -> DataFrame:
    out = conversations.groupBy("adapter_id").agg(
        F.count("*").alias("conversations"),
        _sum(F.col("message_count"), "messages"),
        _sum(_tokens(), "tokens"),
        _sum(F.col("input_tokens") + F.col("output_tokens"), "display_tokens"),
        _sum(F.col("cache_read") + F.col("cache_write"), "cache_tokens"),
        _cost(),
    )
    return out.orderBy(F.desc("conversations"), "adapter_id")


def by_model(messages: DataFrame) -> DataFrame:
    out = messages.where("model != ''").groupBy("model").agg(F.count("*").alias("messages"), *(_sum(F.col(t), t) for t in TOKENS))
    return out.orderBy(F.desc("messages"), "model")


def by_tool(tool_calls: DataFrame) -> DataFrame:
    out = tool_calls.groupBy("name").agg(F.count("*").alias("calls"), F.countDistinct("conversation_id").alias("conversations"))
    return out.orderBy(F.desc("calls"), "name")


def by_role(messages: DataFrame) -> DataFrame:
    return messages.groupBy("role").agg(F.count("*").alias("messages")).orderBy("role")


def _timeline(conversations: DataFrame, since: str | None, keys: dict[str, Column]) -> DataFrame:
    rows = conversations.where(S.activity() >= since) if since else conversations
    rows = rows.withColumns(keys)
    out = rows.groupBy(*keys, "adapter_id").agg(F.count("*").alias("sessions"), _sum(_tokens(), "tokens"), _cost())
    return out.orderBy(*keys, "adapter_id")


def timeline_by_day(conversations: DataFrame, since: str | None = None) -> DataFrame:
    return _timeline(conversations, since, {"day": F.substring(S.activity(), 1, 10)})


def timeline_by_week(conversations: DataFrame, since: str | None = None) -> DataFrame:
    """Weeks start on Monday."""
    start = S.week_start(F.substring(S.activity(), 1, 10))
    return _timeline(conversations, since, {"week_start": start, "week_end": F.date_format(F.date_add(start.cast("date"), 6), "yyyy-MM-dd")})


def projects(conversations: DataFrame) -> DataFrame:
    out = conversations.where("git_remote != ''").groupBy("git_remote").agg(
        F.count("*").alias("conversations"),
        _sum(_tokens(), "tokens"),
        _cost(),
        F.max(S.activity()).alias("last_seen"),
        F.array_join(F.array_sort(F.collect_set("adapter_id")), ",").alias("adapters"),
    )
    return out.withColumn("id", S.uri_component(F.col("git_remote"))).orderBy(F.desc("last_seen"), "git_remote")


def projects_by_harness(conversations: DataFrame, limit: int = 7) -> DataFrame:
    """The `limit` projects seen last, with what each adapter used, largest first."""
    each = conversations.where("git_remote != ''").groupBy("git_remote", "adapter_id").agg(
        F.count("*").alias("conversations"), _sum(_tokens(), "tokens"), F.sum("est_cost").alias("est_cost"), F.max(S.activity()).alias("last_seen")
    )
    part = F.struct(
        (-F.col("tokens")).alias("by_tokens"),
        (-F.col("conversations")).alias("by_conversations"),
        F.when(F.col("adapter_id") == "", "unknown").otherwise(F.col("adapter_id")).alias("adapter_id"),
        F.round("est_cost", MONEY_DIGITS).alias("cost"),
    )
    out = each.groupBy("git_remote").agg(
        F.sum("conversations").alias("conversation_count"),
        F.sum("tokens").alias("total_tokens"),
        F.round(F.sum("est_cost"), MONEY_DIGITS).alias("total_cost"),
        F.max("last_seen").alias("last_seen"),
        F.array_sort(F.collect_list(part)).alias("parts"),
    )
    return out.orderBy(F.desc("last_seen"), F.desc("conversation_count"), "git_remote").limit(limit)


def harness_rows(projects: DataFrame) -> DataFrame:
    """A row for each project and adapter with the adapter's place."""
    out = projects.select("git_remote", "conversation_count", "total_tokens", "total_cost", "last_seen", F.posexplode("parts").alias("place", "p"))
    return out.select(
        "git_remote", "conversation_count", "total_tokens", "total_cost", "last_seen", "place", "p.adapter_id",
        (-F.col("p.by_conversations")).alias("conversations"), (-F.col("p.by_tokens")).alias("tokens"), "p.cost",
    )


# The chart model: rows of (day, adapter_id, sessions, tokens, cost).


def daily_usage(timeline: DataFrame) -> DataFrame:
    """Rows of one day and adapter merged, rows of zeros left out."""
    out = timeline.groupBy("day", "adapter_id").agg(F.sum("sessions").alias("sessions"), F.sum("tokens").alias("tokens"), F.round(F.sum("cost"), MONEY_DIGITS).alias("cost"))
    return out.where("sessions > 0 OR tokens > 0 OR cost > 0")


def last_buckets(rows: DataFrame, bucket: str, size: int, offset: int = 0) -> DataFrame:
    """Rows of the `offset`-th window of `size` buckets, counted from the latest bucket back.

    Only the distinct buckets (days or weeks) are ranked.
    """
    ranked = rows.select(bucket).distinct().withColumn("n", F.row_number().over(Window.orderBy(F.desc(bucket))))
    kept = ranked.where(F.floor((F.col("n") - 1) / size) == offset).select(bucket)
    return rows.join(F.broadcast(kept), bucket, "left_semi")  # at most `size` rows


def usage_pivot(rows: DataFrame, adapters: list[str], metric: str = "tokens") -> DataFrame:
    """A row for each day, a column for each adapter, 0 where it has nothing."""
    out = rows.groupBy("day").pivot("adapter_id", adapters).agg(F.sum(metric))
    return out.fillna(0).select("day", *(F.col(f"`{a}`").alias(a.replace("-", "_")) for a in adapters)).orderBy("day")


def adapter_rank(rows: DataFrame) -> DataFrame:
    out = rows.groupBy("adapter_id").agg(F.sum("tokens").alias("tokens"), F.sum("sessions").alias("sessions"), F.round(F.sum("cost"), MONEY_DIGITS).alias("cost"))
    return out.orderBy(F.desc(F.col("tokens") + F.col("sessions")), "adapter_id")


def adapter_mix(rows: DataFrame, size: int = 14) -> DataFrame:
    """Sessions of each adapter in the latest window of days, with their share."""
    out = last_buckets(rows, "day", size).groupBy("adapter_id").agg(F.sum("sessions").alias("sessions"))
    share = F.col("sessions") / F.sum("sessions").over(Window.partitionBy())
    return out.withColumn("share", F.round(share, 6)).orderBy(F.desc("sessions"), "adapter_id")


def top(rows: DataFrame, limit: int, *order: Column | str) -> DataFrame:
    return rows.orderBy(*order).limit(limit)


def tool_preview(tool_calls: DataFrame, messages: DataFrame, n: int = 3) -> DataFrame:
    """(conversation_id, tools): the first `n` distinct tool names by where they first occur."""
    order = messages.select("conversation_id", F.col("id").alias("message_id"), "sequence")
    seen = tool_calls.join(order, ["conversation_id", "message_id"], "left").groupBy("conversation_id", "name").agg(F.min(F.struct(F.coalesce("sequence", F.lit(0)).alias("s"), "id")).alias("at"))
    w = Window.partitionBy("conversation_id").orderBy("at", "name")
    kept = seen.withColumn("n", F.row_number().over(w)).where(F.col("n") <= n)
    return kept.groupBy("conversation_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "name"))), lambda x: x["name"]), ",").alias("tools"))


def agentic_loops(messages: DataFrame, tool_calls: DataFrame, least: int = 3) -> DataFrame:
    """Assistant turns with at least `least` tool calls."""
    own = messages.where("role = 'assistant'").select("conversation_id", F.col("id").alias("message_id"), "turn")
    out = tool_calls.join(own, ["conversation_id", "message_id"]).groupBy("conversation_id", "turn").agg(F.count("*").alias("calls"))
    return out.where(F.col("calls") >= least)


def used_tool(conversations: DataFrame, tool_calls: DataFrame, tool: str) -> DataFrame:
    calls = tool_calls.where(F.col("name") == tool).select(F.col("conversation_id").alias("id"))
    return conversations.join(calls, "id", "left_semi").select("id", "adapter_id")


def cost_by(conversations: DataFrame, key: str) -> DataFrame:
    return conversations.groupBy(key).agg(F.count("*").alias("conversations"), _cost())
