"""The older surface: sessions with projects, tags and tool usage, pushed by time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from .usage import MONEY_DIGITS

_ENDINGS = "|".join(S.LANGUAGES)
_FILES = rf"""["\s/][\w\-./]+\.({_ENDINGS})"""
HIGH_COST = 1.0


def tool_chars(tool_calls: DataFrame) -> DataFrame:
    name = F.when(F.coalesce("name", F.lit("")) == "", "unknown").otherwise(F.col("name"))
    chars = lambda c: F.sum(F.length(F.coalesce(c, F.lit("")))).cast("long")
    return tool_calls.groupBy("conversation_id", name.alias("tool")).agg(F.count("*").alias("calls"), chars("input").alias("input_chars"), chars("output").alias("output_chars"))


def languages(tool_calls: DataFrame) -> DataFrame:
    """(conversation_id, language): of the file ending named most in tool inputs; ties by ending."""
    found = tool_calls.select("conversation_id", F.explode(F.regexp_extract_all("input", F.lit(_FILES), F.lit(1))).alias("ending"))
    counts = found.groupBy("conversation_id", "ending").agg(F.count("*").alias("n"))
    w = Window.partitionBy("conversation_id").orderBy(F.desc("n"), "ending")
    names = F.create_map(*(F.lit(x) for pair in S.LANGUAGES.items() for x in pair))
    best = counts.withColumn("r", F.row_number().over(w)).where("r = 1")
    return best.select("conversation_id", F.coalesce(names[F.col("ending")], F.col("ending")).alias("language"))


def tags(conversations: DataFrame, messages: DataFrame, tool_calls: DataFrame) -> DataFrame:
    """(conversation_id, tag, category), each once."""
    c = conversations.withColumn("conversation_id", F.col("id"))
    pick = lambda df, tag, category: df.select("conversation_id", tag.alias("tag"), F.lit(category).alias("category"))
    parts = [
        pick(c.where("cwd != ''"), S.project_name(F.col("cwd")), "project"),
        pick(c, F.col("adapter_id"), "tool"),
        pick(messages.where("model != ''"), S.model_family(F.col("model")), "model"),
        pick(languages(tool_calls), F.col("language"), "language"),
        pick(c.where(F.col("relationship").isin("spawned", "forked")), F.lit("sub-agent"), "status"),
        pick(c.where("relationship = 'compacted'"), F.lit("compacted"), "status"),
        pick(c.where(F.col("est_cost") > HIGH_COST), F.lit("high-cost"), "status"),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def tag_counts(tag_rows: DataFrame) -> DataFrame:
    return tag_rows.groupBy("category", "tag").agg(F.countDistinct("conversation_id").alias("sessions")).orderBy(F.desc("sessions"), "category", "tag")


def session_tags(tag_rows: DataFrame, sessions: list[str]) -> DataFrame:
    """The tags of the given sessions, by category and name."""
    return tag_rows.where(F.col("conversation_id").isin(sessions)).select("conversation_id", "category", "tag").orderBy("category", "tag")


def projects(conversations: DataFrame) -> DataFrame:
    """(project_id, name, sessions, messages, cost, last_seen) by working directory."""
    rows = conversations.where("cwd != ''").withColumns({"project_id": S.project_id(F.col("cwd")), "project": S.project_name(F.col("cwd"))})
    return rows.groupBy("project_id", "project").agg(
        F.count("*").alias("sessions"), F.sum("message_count").alias("messages"), F.round(F.sum("est_cost"), MONEY_DIGITS).alias("cost"), F.max(S.activity()).alias("last_seen")
    )


def cost_by_project_and_tool(conversations: DataFrame) -> DataFrame:
    rows = conversations.where("cwd != ''").withColumn("project", S.project_name(F.col("cwd")))
    return rows.groupBy("project", "adapter_id").agg(F.count("*").alias("sessions"), F.round(F.sum("est_cost"), MONEY_DIGITS).alias("cost"))


def enriched(conversations: DataFrame, tag_rows: DataFrame) -> DataFrame:
    """Sessions with their tags and project in one row; tags are joined as one text before the join."""
    joined = tag_rows.groupBy("conversation_id").agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"))
    rows = conversations.select("id", "adapter_id", S.project_name(F.col("cwd")).alias("project"), "message_count")
    return rows.join(joined, rows["id"] == joined["conversation_id"], "left").select("id", "adapter_id", "project", "message_count", F.coalesce("tags", F.lit("")).alias("tags"))


def never_pushed(ingested: DataFrame, pushes: DataFrame) -> DataFrame:
    return ingested.join(pushes.select("conversation_id").distinct(), "conversation_id", "left_anti").select("conversation_id")


def changed_since_push(ingested: DataFrame, pushes: DataFrame, sink: str) -> DataFrame:
    """Sessions without a push to the sink at or after their ingest: the latest push decides, so no range join."""
    latest = pushes.where(F.col("sink_id") == sink).groupBy("conversation_id").agg(F.max("pushed_at").alias("pushed_at"))
    joined = ingested.join(latest, "conversation_id", "left")
    return joined.where("pushed_at IS NULL OR pushed_at < ingested_at").select("conversation_id")


def family_of(conversations: DataFrame, parent: str) -> DataFrame:
    """A session and its children."""
    return conversations.where((F.col("id") == parent) | (F.col("parent_id") == parent))
