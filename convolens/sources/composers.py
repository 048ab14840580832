"""An editor's key-value store: composers (conversations), their bubbles (messages), sub-composers (children)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import rollup as R
from .rollouts import trace_roots
from .sqlite import read_sqlite
from .transcripts import _MESSAGE, blocks, iso_or, number_at, text_at

TABLES = ["cursorDiskKV"]
UNNAMED = "New Agent"
#: A name may start with wrapped context, which isn't the user's text.
WRAPPED = r"^(?:\s*<([A-Za-z_-]+)>[\s\S]*?</\1>\s*)+"


def read_composers(spark: SparkSession, path: str | list[str], adapter: str = "cursor") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Conversations, messages and tool calls; a child's fork point is the place of the bubble that started it.

    Headers give the order of bubbles; a bubble without a row is left out. A trace is named by the top of
    the parent links, circles keep their own id.
    """
    rows = read_sqlite(spark, path, TABLES, ["key", "value"])
    heads = rows.where("key LIKE 'composerData:%' AND try_parse_json(value) IS NOT NULL").select("path", F.substring("key", 14, 200).alias("conversation_id"), F.col("value").alias("head"))
    bubbles = rows.where("key LIKE 'bubbleId:%' AND try_parse_json(value) IS NOT NULL").select("path", F.split("key", ":")[1].alias("conversation_id"), F.split("key", ":")[2].alias("bubble"), "value")
    order = heads.select("path", "conversation_id", "head", F.posexplode(blocks(F.get_json_object("head", "$.fullConversationHeadersOnly"))).alias("place", "h"))
    order = order.select("path", "conversation_id", "head", "place", text_at("h", "$.bubbleId").alias("bubble"), text_at("h", "$.type").alias("kind"))
    joined = order.join(bubbles, ["path", "conversation_id", "bubble"])
    kind = F.coalesce(F.nullif(text_at("value", "$.type"), F.lit("")), F.col("kind"))
    thinking = text_at("value", "$.thinking.text", "$.thinking")
    tool = F.get_json_object("value", "$.toolFormerData")
    text = F.coalesce(F.nullif(text_at("value", "$.text"), F.lit("")), F.nullif(thinking, F.lit("")), F.when(tool.isNotNull(), F.concat(F.lit("[tool:"), text_at(tool, "$.name"), F.lit("]"))), F.lit(""))
    w = Window.partitionBy("conversation_id").orderBy("place")
    model = text_at("head", "$.modelConfig.modelName")
    role = F.when(kind == "1", "user").otherwise("assistant")
    zero = F.lit(0).cast("long")
    messages = joined.withColumns({"role": role, "content": text, "tool": tool}).where("content != ''").select(
        "*",
        F.concat_ws(":", "conversation_id", "bubble").alias("id"),
        F.when(F.col("role") == "assistant", model).otherwise("").alias("model"),
        F.lit("bubble").alias("record_type"),
        (F.row_number().over(w) - 1).cast("int").alias("sequence"),
        F.lit(False).alias("is_sidechain"),
        number_at("value", "$.tokenCount.inputTokens").alias("input_tokens"),
        number_at("value", "$.tokenCount.outputTokens").alias("output_tokens"),
        zero.alias("cache_read"),
        zero.alias("cache_write"),
        thinking.alias("thinking_content"),
        F.when(thinking == "", zero).otherwise(S.estimated_tokens(thinking)).alias("thinking_tokens"),
        iso_or(text_at("value", "$.createdAt"), S.iso_time(iso_or(text_at("head", "$.createdAt"), F.lit(None).cast("timestamp")))).alias("timestamp"),
    )
    messages = messages.withColumns({"turn": R.running_turn(F.col("role")), "parent_message_id": F.coalesce(F.lag("id").over(w), F.lit(""))})
    calls = messages.where("tool IS NOT NULL").select(
        F.coalesce(F.nullif(text_at("tool", "$.toolCallId"), F.lit("")), F.col("bubble")).alias("id"), "conversation_id", F.col("id").alias("message_id"), text_at("tool", "$.name").alias("name"),
        text_at("tool", "$.rawArgs", "$.params").alias("input"), text_at("tool", "$.result").alias("output"), (text_at("tool", "$.status") == "error").alias("is_error"), F.lit(-1).cast("long").alias("duration_ms"),
    )
    return _conversations(heads, messages, adapter), messages.select(*_MESSAGE), calls


def _conversations(heads: DataFrame, messages: DataFrame, adapter: str) -> DataFrame:
    none = F.lit(None).cast("timestamp")
    started = iso_or(text_at("head", "$.createdAt"), none)
    ended = F.coalesce(iso_or(text_at("head", "$.lastUpdatedAt", "$.updatedAt"), none), started)
    links = heads.select(F.col("conversation_id").alias("up"), F.explode(blocks(F.get_json_object("head", "$.subagentComposerIds"))).alias("id")).groupBy("id").agg(F.min("up").alias("up"))
    forks = links.join(messages.select(F.col("conversation_id").alias("up"), "place", "value"), "up").where(F.col("value").contains(F.col("id"))).groupBy("id").agg(F.min("place").alias("fork"))
    firsts = messages.where("role = 'user'").groupBy("conversation_id").agg(F.min_by(S.first_line_name(F.regexp_replace("content", WRAPPED, ""), 80), "sequence").alias("first"))
    name = text_at("head", "$.name")
    out = heads.join(firsts, "conversation_id", "left").withColumn("id", F.col("conversation_id")).join(links, "id", "left").join(forks, "id", "left")
    out = out.select(
        "id", F.col("id").alias("trace_id"), F.coalesce("up", F.lit("")).alias("parent_id"), F.when(F.col("up").isNull(), "root").otherwise("spawned").alias("relationship"),
        F.coalesce("fork", F.lit(-1)).cast("int").alias("fork_point"), F.lit(adapter).alias("adapter_id"),
        F.coalesce(F.nullif(F.nullif(name, F.lit(UNNAMED)), F.lit("")), F.nullif("first", F.lit("")), F.substring("id", 1, 8)).alias("name"),
        F.url_decode(F.regexp_replace(text_at("head", "$.workspaceUri", "$.context.folderUri"), "^file://", "")).alias("cwd"), F.lit("").alias("git_remote"), F.lit("").alias("branch"),
        text_at("head", "$.modelConfig.modelName").alias("model"), F.coalesce(started, F.lit("")).alias("started_at"), F.coalesce(ended, F.lit("")).alias("ended_at"), F.col("path").alias("source_path"), F.lit("sqlite").alias("source_format"),
    )
    return trace_roots(out)


