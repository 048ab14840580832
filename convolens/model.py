"""The data model: conversations, messages, tool calls, and the tables of incremental state."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import types as T

RELATIONSHIPS = ("root", "compacted", "spawned", "forked")
ROLES = ("user", "assistant", "system")
FORMATS = ("jsonl", "sqlite", "json")
TOKENS = ("input_tokens", "output_tokens", "cache_read", "cache_write")


def _struct(**kinds: str) -> T.StructType:
    names = {"s": T.StringType(), "i": T.IntegerType(), "l": T.LongType(), "d": T.DoubleType(), "b": T.BooleanType()}
    return T.StructType([T.StructField(k, names[v]) for k, v in kinds.items()])


#: An empty string means absent in the text columns; -1 an unknown turn, fork point or duration.
CONVERSATION = _struct(
    id="s", trace_id="s", parent_id="s", relationship="s", fork_point="i", adapter_id="s", name="s", cwd="s", git_remote="s", branch="s", model="s",
    started_at="s", ended_at="s", source_path="s", source_format="s", duration_ms="l", message_count="l", tool_count="l", turn_count="l",
    input_tokens="l", output_tokens="l", cache_read="l", cache_write="l", est_cost="d",
)
MESSAGE = _struct(
    id="s", conversation_id="s", role="s", content="s", record_type="s", model="s", sequence="i", turn="i", is_sidechain="b", parent_message_id="s",
    input_tokens="l", output_tokens="l", cache_read="l", cache_write="l", thinking_content="s", thinking_tokens="l", timestamp="s",
)
TOOL_CALL = _struct(id="s", conversation_id="s", message_id="s", name="s", input="s", output="s", is_error="b", duration_ms="l")
SYNC = _struct(conversation_id="s", content_hash="s", local_revision="l", ingested_at="s")
PUSH_STATE = _struct(
    conversation_id="s", sink_id="s", last_attempted_revision="l", last_successful_revision="l", last_attempted_at="s", last_successful_at="s", last_error="s"
)


@dataclass(frozen=True)
class Store:
    """The tables that queries read. State tables are None where nothing was synchronised yet."""

    conversations: DataFrame
    messages: DataFrame
    tool_calls: DataFrame
    sync: DataFrame | None = None
    push_state: DataFrame | None = None

    def with_conversations(self, conversations: DataFrame) -> Store:
        return replace(self, conversations=conversations)
