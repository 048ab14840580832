"""Rollout files: envelopes {timestamp, type, payload} of a tool that logs turns, calls and usage as separate records.

Calls, thinking and usage that stand before an assistant message belong to it. Before any other message,
a compaction or the end of the file they get an assistant row of their own ("Tool call output").
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..model import TOKENS
from ..operators import rollup as R
from ..operators.graph import top_traces
from .transcripts import SEPARATOR, _MESSAGE, _segment_conversations, blocks, flat_text, number_at, role_of, text_at

FLUSHED = "Tool call output"


def _records(source: DataFrame) -> DataFrame:
    """Rows of the file with the session they belong to, compaction histories as message rows of the new segment."""
    whole = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = source.select("path", "modified", "line", text_at("value", "$.timestamp").alias("timestamp"), text_at("value", "$.type").alias("kind"), F.get_json_object("value", "$.payload").alias("p"))
    meta = lambda path: F.first(F.when(F.col("kind") == "session_meta", F.nullif(text_at("p", path), F.lit(""))), ignorenulls=True).over(whole)
    rows = rows.withColumns(
        {
            "session": F.coalesce(meta("$.id"), F.regexp_extract("path", r"([^/]+?)\.[^./]*$", 1)),
            "spawner": F.coalesce(meta("$.source.subagent.thread_spawn.parent_thread_id"), meta("$.forked_from_id"), F.lit("")),
            "cwd": F.coalesce(meta("$.cwd"), F.lit("")),
            "branch": F.coalesce(meta("$.git.branch"), F.lit("")),
            "remote": F.coalesce(meta("$.git.repository_url"), F.lit("")),
            "model": F.coalesce(
                F.last(F.when(F.col("kind") == "turn_context", F.nullif(text_at("p", "$.model"), F.lit(""))), ignorenulls=True).over(Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)), F.lit("")
            ),
        }
    )
    rows = rows.withColumn("turn", R.context_turn(F.col("kind"), "path", "line")).withColumn("sub", F.lit(0))
    past = rows.where("kind = 'compacted'").select(*(c for c in rows.columns if c not in ("p", "kind", "turn", "sub")), F.posexplode(blocks(F.get_json_object("p", "$.replacement_history"))).alias("n", "p"))
    past = past.select("*", F.lit("response_item").alias("kind"), F.lit(-1).alias("turn"), (F.col("n") + 1).alias("sub")).drop("n")
    return rows.unionByName(past)




def read_rollouts(source: DataFrame, adapter: str = "codex") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Conversations, messages and tool calls of rollout lines; a `compacted` record opens a segment."""
    rows = _records(source).withColumn("place", F.col("line") * 100_000 + F.col("sub"))
    rows = R.segments(rows, "session", "place", F.col("kind") == "compacted").withColumnRenamed("segment_id", "conversation_id")
    item = F.when(F.col("kind") == "response_item", text_at("p", "$.type"))
    role = F.when(item == "message", role_of(text_at("p", "$.role")))
    content = flat_text(F.coalesce(F.get_json_object("p", "$.content"), F.lit("")))
    rows = rows.withColumns({"item": item, "role": role, "content": content})
    rows = rows.withColumn("message", F.col("role").isNotNull() & (F.col("content") != ""))
    # the next message of the segment takes what is pending, if an assistant wrote it
    ahead = Window.partitionBy("conversation_id").orderBy("place").rowsBetween(0, Window.unboundedFollowing)
    stop = F.when(F.col("message"), F.struct("place", "role"))
    rows = rows.withColumn("stop", F.first(stop, ignorenulls=True).over(ahead))
    owner = F.when(F.col("stop")["role"] == "assistant", F.concat(F.lit("a"), F.col("stop")["place"])).otherwise(F.concat(F.lit("f"), F.coalesce(F.col("stop")["place"].cast("string"), F.lit("end"))))
    rows = rows.withColumn("owner", F.when(~F.col("message") | (F.col("role") == "assistant"), owner))
    usage = lambda name, *more: number_at("p", f"$.info.last_token_usage.{name}", f"$.usage.{name}", *more)
    counted = ((F.col("kind") == "event_msg") & (text_at("p", "$.type") == "token_count")) | (F.get_json_object("p", "$.usage").isNotNull())
    calls, thinking = F.col("item").isin("function_call", "custom_tool_call", "web_search_call"), F.col("item") == "reasoning"
    deep = F.array_join(F.filter(F.transform(blocks(F.get_json_object("p", "$.summary")), lambda x: text_at(x, "$.text")), lambda t: t != ""), SEPARATOR)
    pending = rows.where(F.col("owner").isNotNull()).groupBy("conversation_id", "owner").agg(
        F.count_if(calls | thinking | counted).alias("pending"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(thinking, F.struct("place", F.coalesce(F.nullif(deep, F.lit("")), flat_text(F.coalesce(F.get_json_object("p", "$.content"), F.lit("")))).alias("t"))))), lambda x: x["t"]), SEPARATOR).alias("thinking_content"),
        F.max_by(F.when(counted, F.struct(usage("input_tokens").alias("input_tokens"), usage("output_tokens").alias("output_tokens"), usage("cached_input_tokens").alias("cache_read"), usage("reasoning_output_tokens").alias("reasoning"))), F.when(counted, F.col("place"))).alias("usage"),
        F.max("place").alias("last_place"), F.max_by("timestamp", "place").alias("last_time"), F.max_by("turn", "place").alias("last_turn"),
    )
    about = ["path", "session", "spawner", "cwd", "branch", "remote", "relationship", "parent_segment_id", "segment"]
    facts = rows.groupBy("conversation_id").agg(*(F.min(c).alias(c) for c in about), F.max_by("model", "place").alias("last_model"))
    own = rows.where("message").select("conversation_id", "place", F.col("owner").alias("takes"), "role", "content", "turn", "timestamp", "model", *about, text_at("p", "$.id").alias("given"))
    told = own.join(pending.select("conversation_id", F.col("owner").alias("takes"), "thinking_content", "usage"), ["conversation_id", "takes"], "left")
    flushed = pending.where("owner LIKE 'f%' AND pending > 0").join(facts, "conversation_id")
    extra = flushed.select(
        "conversation_id", F.col("owner").alias("takes"), F.col("last_place").alias("place"), F.lit("assistant").alias("role"), F.lit(FLUSHED).alias("content"), F.col("last_turn").alias("turn"),
        F.col("last_time").alias("timestamp"), F.col("last_model").alias("model"), *about, F.lit("").alias("given"), "thinking_content", "usage",
    )
    messages = told.unionByName(extra)
    w = Window.partitionBy("conversation_id").orderBy("place")
    zero = F.lit(0).cast("long")
    messages = messages.withColumns(
        {
            "id": S.stable_id_sha1(F.col("conversation_id"), F.col("place").cast("string")),
            "sequence": (F.row_number().over(w) - 1).cast("int"),
            "model": F.when(F.col("role") == "assistant", F.col("model")).otherwise(""),
            "record_type": F.lit("response_item"),
            "is_sidechain": F.lit(False),
            "parent_message_id": F.lit(""),
            "thinking_content": F.coalesce("thinking_content", F.lit("")),
            "thinking_tokens": F.coalesce(F.col("usage")["reasoning"], zero),
            **{t: F.coalesce(F.col("usage")[t], zero) if t != "cache_write" else zero for t in TOKENS},
        }
    ).withColumn("line", F.col("place"))
    conversations = _segment_conversations(messages, adapter)
    remotes = messages.groupBy(F.col("conversation_id").alias("id")).agg(F.max("remote").alias("r"))
    conversations = conversations.join(remotes, "id").withColumn("git_remote", F.col("r")).drop("r")
    return conversations, messages.select(*_MESSAGE), _calls(rows, messages)


def _calls(rows: DataFrame, messages: DataFrame) -> DataFrame:
    """Calls with the output of their id that stands before the message that takes them."""
    keyed = rows.where("owner IS NOT NULL").select("conversation_id", "owner", "place", "item", "p")
    made = keyed.where(F.col("item").isin("function_call", "custom_tool_call", "web_search_call")).select(
        "conversation_id", "owner", "place",
        F.coalesce(F.nullif(text_at("p", "$.call_id", "$.id"), F.lit("")), F.col("place").cast("string")).alias("id"),
        F.coalesce(F.nullif(text_at("p", "$.name"), F.lit("")), F.lit("web_search")).alias("name"),
        text_at("p", "$.arguments", "$.input", "$.action").alias("input"),
    )
    outs = keyed.where(F.col("item").isin("function_call_output", "custom_tool_call_output")).groupBy("conversation_id", "owner", text_at("p", "$.call_id").alias("id")).agg(F.max_by(text_at("p", "$.output.content", "$.output"), "place").alias("output"))
    joined = made.join(outs, ["conversation_id", "owner", "id"], "left")
    taken = messages.select("conversation_id", F.col("takes").alias("owner"), F.col("id").alias("message_id")).where("owner IS NOT NULL")
    return joined.join(taken, ["conversation_id", "owner"]).select(
        "id", "conversation_id", "message_id", "name", "input", F.coalesce("output", F.lit("")).alias("output"), F.lit(False).alias("is_error"), F.lit(-1).cast("long").alias("duration_ms")
    )


def trace_roots(conversations: DataFrame) -> DataFrame:
    """`conversations` whose trace_id is the top of their parent links, or the parent that the top names if it isn't there; a circle keeps what it has."""
    found = top_traces(conversations.select("id", "parent_id", "trace_id"))
    return conversations.join(found, "id", "left").withColumn("trace_id", F.col("trace")).drop("trace")
