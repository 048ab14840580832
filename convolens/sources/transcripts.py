"""Transcript files of AI tools as rows of the model: lines are parsed by column functions, one pass per file set.

A reader takes paths and gives (conversations, messages, tool_calls). Lines that aren't JSON are skipped. A
file's size or number doesn't matter to the plan: lines are numbered within their file by a window, and
everything else is grouped by conversation.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar as S
from ..model import TOKENS
from ..operators import rollup as R
from ..streaming.state import saved

SEPARATOR = "\n\n"


def read_lines(spark: SparkSession, path: str | list[str], suffix: str = "*.jsonl") -> DataFrame:
    """(path, modified, line, value): the lines of all files under `path` that are JSON objects, numbered from 0."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", suffix).text(path)
    meta = F.col("_metadata")
    rows = raw.select(
        meta["file_path"].alias("path"), meta["file_modification_time"].alias("modified"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("n"), "value"
    )
    w = Window.partitionBy("path").orderBy("block", "n")
    rows = rows.withColumn("line", (F.row_number().over(w) - 1).cast("int")).drop("block", "n")
    return rows.where(F.col("value").rlike(r"^\s*\{") & F.try_parse_json("value").isNotNull())


def read_documents(spark: SparkSession, path: str | list[str], suffix: str = "*.json") -> DataFrame:
    """(path, modified, value): each file as one JSON value."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", suffix).option("wholetext", True).text(path)
    rows = raw.select(F.col("_metadata")["file_path"].alias("path"), F.col("_metadata")["file_modification_time"].alias("modified"), "value")
    return rows.where(F.try_parse_json("value").isNotNull())


def packed_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """What `read_lines` gives, from a pack: Parquet files with the (path, modified, line, value) of many transcripts."""
    rows = spark.read.parquet(*([path] if isinstance(path, str) else path)).select("path", "modified", "line", "value")
    return rows.where(F.col("value").rlike(r"^\s*\{") & F.try_parse_json("value").isNotNull())


def packed_documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """What `read_documents` gives, from a pack with the (path, modified, value) of many documents."""
    rows = spark.read.parquet(*([path] if isinstance(path, str) else path)).select("path", "modified", "value")
    return rows.where(F.try_parse_json("value").isNotNull())


def text_at(value: Column | str, *paths: str) -> Column:
    """The first of the JSON paths that holds a text or number that isn't blank; else ''."""
    value = F.col(value) if isinstance(value, str) else value
    found = [F.nullif(F.trim(F.get_json_object(value, p)), F.lit("")) for p in paths]
    return F.coalesce(*found, F.lit(""))


def number(text: Column) -> Column:
    """A whole number of at least 0; 0 if the text is none that fits, or null. A null costs less than a blank text, whose cast throws and catches."""
    return F.greatest(F.lit(0), F.coalesce(text.try_cast("double").try_cast("long"), F.lit(0)))


def number_at(value: Column | str, *paths: str) -> Column:
    return number(text_at(value, *paths))


def iso_or(value: Column, fallback: Column) -> Column:
    """ISO text of a time in ISO text or epoch milliseconds; of others the fallback, a timestamp."""
    millis = F.when(value.rlike(r"^\d{11,}$"), F.timestamp_millis(value.try_cast("long")))
    when = F.coalesce(millis, S.iso_time(value), fallback)
    return F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


_BLOCKS = "array<string>"


def blocks(value: Column) -> Column:
    """A JSON array's elements as JSON texts; null if it isn't an array."""
    return F.when(F.ltrim(value).startswith("["), F.from_json(value, _BLOCKS))


def flat_text(content: Column) -> Column:
    """Text of a content value: a plain text, or the texts of an array of parts, also one level further down.

    Each part's fields are kept beside it, as a lambda's columns are worked out anew wherever they are named.
    """
    holds = lambda p: F.ltrim(p["own"]).startswith("{")

    def deeper(p: Column) -> Column:
        return p.withField("inner", F.when(holds(p) & (F.coalesce(p["text"], F.lit("")) == ""), F.get_json_object(p["own"], "$.content")))

    def part(p: Column) -> Column:
        plain = F.when(~holds(p), F.trim(p["own"]))
        deep = F.array_join(F.filter(F.transform(blocks(p["inner"]), lambda y: F.trim(F.get_json_object(y, "$.text"))), lambda t: t != ""), SEPARATOR)
        return F.coalesce(F.nullif(plain, F.lit("")), F.nullif(p["text"], F.lit("")), deep, F.nullif(F.trim(p["inner"]), F.lit("")), F.lit(""))

    found = F.transform(blocks(content), lambda x: F.struct(x.alias("own"), F.when(F.ltrim(x).startswith("{"), F.trim(F.get_json_object(x, "$.text"))).alias("text")))
    parts = F.array_join(F.filter(F.transform(F.transform(found, deeper), part), lambda t: t != ""), SEPARATOR)
    holder = F.when(F.ltrim(content).startswith("{"), text_at(content, "$.text", "$.content"))
    return F.coalesce(parts, holder, F.trim(content), F.lit(""))


ROLES = {"user": "user", "assistant": "assistant", "system": "system", "human": "user", "model": "assistant", "ai": "assistant", "developer": "system"}


def role_of(text: Column) -> Column:
    """user, assistant or system; other roles become null and their rows go. The text is worked out once, for one look-up."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair)), F.lower(F.trim(text)))


@dataclass(frozen=True)
class Simple:
    """Where a simple tool keeps things, as JSON paths of a row; `items` is the array of rows in a whole document."""

    adapter: str
    session: tuple[str, ...]
    role: tuple[str, ...] = ("$.role", "$.type")
    content: tuple[str, ...] = ("$.content", "$.message.content", "$.parts", "$.text")
    time: tuple[str, ...] = ("$.timestamp", "$.createTime", "$.createdAt")
    model: tuple[str, ...] = ("$.model", "$.message.model")
    items: tuple[str, ...] = ()
    last: bool = False  # of lines, whether the last that names a session counts


AMP = Simple("amp", ("$.thread_id", "$.threadId"))
PI = Simple("pi", ("$.session_id", "$.sessionId"))
PIAGENT = Simple("piagent", ("$.session_id", "$.sessionId"))
GEMINI = Simple("gemini-cli", ("$.sessionId", "$.id"), role=("$.role", "$.type"), items=("$.turns", "$.messages", "$.conversation"))
OPENCODE = Simple("opencode", ("$.id", "$.sessionId"), items=("$.messages", "$.turns", "$.conversation"))
OPENCODE_LINES = Simple("opencode", ("$.session_id", "$.thread_id", "$.id"), last=True)

_USAGE = {
    "input_tokens": ("$.usage.input_tokens", "$.usage.inputTokens", "$.usage.input"),
    "output_tokens": ("$.usage.output_tokens", "$.usage.outputTokens", "$.usage.output"),
    "cache_read": ("$.usage.cache_read_input_tokens", "$.usage.cacheRead"),
    "cache_write": ("$.usage.cache_creation_input_tokens", "$.usage.cacheWrite"),
}


def _stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)\.[^./]*$", 1)


def _paths(spec: Simple) -> set[str]:
    """All that is read of a row."""
    own = ("$.cwd", "$.id", "$.uuid", "$.type", "$.role", "$.thinking", "$.tool_calls")
    return {*own, *spec.session, *spec.role, *spec.content, *spec.time, *spec.model, *(p for paths in _USAGE.values() for p in paths)}


def _shape(paths: set[str]) -> T.StructType:
    """A struct with a text, of whatever JSON stands there, at each path."""
    below: dict[str, set[str]] = {}
    for path in sorted(paths):
        head, _, rest = path.removeprefix("$.").partition(".")
        below.setdefault(head, set()).update({rest} - {""})
    return T.StructType([T.StructField(name, _shape(rest) if rest else T.StringType()) for name, rest in below.items()])


def _raw(*paths: str) -> Column:
    """The first of the paths that is there, in the column `row`."""
    return F.coalesce(*(F.col(p.replace("$", "row", 1)) for p in paths))


def _found(*paths: str) -> Column:
    """The first of the paths that isn't blank, in the column `row`; else null."""
    return F.coalesce(*(F.nullif(F.trim(_raw(p)), F.lit("")) for p in paths))


def _text(*paths: str) -> Column:
    """As `text_at`, in the column `row`."""
    return F.coalesce(_found(*paths), F.lit(""))


def _rows(source: DataFrame, spec: Simple) -> DataFrame:
    """(path, modified, line, row, session, cwd) of each message row; `row`: what is read of its JSON, which is parsed once.

    `session` and `cwd` are null where a line, or the document that holds the row, names none.
    """
    row = F.from_json("value", _shape(_paths(spec)))
    own = (_found(*spec.session).alias("session"), _found("$.cwd").alias("cwd"))
    if not spec.items:
        return source.select("path", "modified", "line", row.alias("row")).select("*", *own)
    # a document is taken apart before its rows are laid out, or each row would do it again
    whole = F.when(F.col("value").rlike(r"^\s*\{"), F.from_json("value", _shape({*spec.items, *spec.session, "$.cwd"})))
    documents = source.select("path", "modified", whole.alias("row")).select("path", "modified", "row", *own)
    each = documents.select("path", "modified", "session", "cwd", F.posexplode(F.coalesce(*(blocks(_raw(p)) for p in spec.items))).alias("line", "value"))
    return each.withColumn("row", F.when(F.ltrim("value").startswith("{"), row)).drop("value")


def _tool_calls(messages: DataFrame) -> DataFrame:
    calls = blocks(F.col("tool_calls"))
    each = messages.select("conversation_id", F.col("id").alias("message_id"), F.posexplode(calls).alias("n", "call"))
    name = text_at("call", "$.function.name", "$.name")
    return each.where(name != "").select(
        F.coalesce(F.nullif(text_at("call", "$.id"), F.lit("")), S.stable_id(F.col("message_id"), F.col("n").cast("string"))).alias("id"),
        "conversation_id",
        "message_id",
        name.alias("name"),
        text_at("call", "$.function.arguments", "$.input", "$.arguments").alias("input"),
        text_at("call", "$.output", "$.result").alias("output"),
        (text_at("call", "$.is_error") == "true").alias("is_error"),
        F.coalesce(text_at("call", "$.duration_ms").try_cast("long"), F.lit(-1).cast("long")).alias("duration_ms"),
    )


def read_simple(source: DataFrame, spec: Simple) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Conversations, messages and tool calls of a simple tool's rows.

    The files are read and their JSON is taken apart once: the messages are written to the shared folder, and the other
    two tables come from what was written.
    """
    rows = _rows(source, spec).withColumns({"told": F.coalesce(_raw(*spec.content), F.lit("")), "said_at": _text(*spec.time)})
    rows = rows.select(
        "path", "line", "session", "cwd", "row.tool_calls",
        role_of(_text(*spec.role)).alias("role"),
        flat_text(F.col("told")).alias("content"),
        _text("$.id", "$.uuid").alias("given"),
        _text("$.type", "$.role").alias("record_type"),
        _text(*spec.model).alias("model"),
        iso_or(F.col("said_at"), F.col("modified")).alias("timestamp"),
        _text("$.thinking").alias("thinking_content"),
        *(number(_found(*paths)).alias(name) for name, paths in _USAGE.items()),
    )
    if not spec.items:
        whole, pick = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), F.last if spec.last else F.first
        rows = rows.withColumns({name: pick(name, ignorenulls=True).over(whole) for name in ("session", "cwd")})
    rows = rows.withColumns({"conversation_id": F.coalesce("session", _stem(F.col("path"))), "cwd": F.coalesce("cwd", F.lit(""))})
    # rows that don't count are numbered past and go behind the window: a filter before it would work out each content twice
    counts = F.col("role").isNotNull() & ((F.col("content") != "") | F.col("tool_calls").isNotNull())
    before = Window.partitionBy("conversation_id").orderBy("path", "line").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns(
        {
            "counts": counts,
            "sequence": (F.sum(counts.cast("int")).over(before) - 1).cast("int"),
            "turn": R.running_turn(F.when(counts, F.col("role")), order=("path", "line"), skip_null=True),
        }
    )
    messages = rows.where("counts").withColumns(
        {
            "id": F.when(F.col("given") != "", F.col("given")).otherwise(S.stable_id(F.col("conversation_id"), F.col("sequence").cast("string"))),
            "is_sidechain": F.lit(False),
            "parent_message_id": F.lit(""),
            "thinking_tokens": F.when(F.col("thinking_content") == "", 0).otherwise(S.estimated_tokens(F.col("thinking_content"))).cast("long"),
        }
    )
    messages = saved(messages.select(*_MESSAGE, "path", "cwd", "tool_calls"))
    return _conversations(messages, spec.adapter, "json" if spec.items else "jsonl"), messages.select(*_MESSAGE), _tool_calls(messages)


_MESSAGE = (
    "id", "conversation_id", "role", "content", "record_type", "model", "sequence", "turn", "is_sidechain", "parent_message_id", *TOKENS, "thinking_content", "thinking_tokens", "timestamp",
)


def _conversations(messages: DataFrame, adapter: str, kind: str) -> DataFrame:
    """One root conversation for each session."""
    base = messages.groupBy("conversation_id").agg(
        F.min("timestamp").alias("started_at"), F.max("timestamp").alias("ended_at"), F.min("path").alias("source_path"), F.max("cwd").alias("cwd")
    )
    names, models = R.conversation_names(messages), R.primary_model(messages, first_seen=True).drop("uses")
    out = base.join(names, "conversation_id", "left").join(models, "conversation_id", "left")
    return out.select(
        F.col("conversation_id").alias("id"),
        F.col("conversation_id").alias("trace_id"),
        F.lit("").alias("parent_id"),
        F.lit("root").alias("relationship"),
        F.lit(-1).alias("fork_point"),
        F.lit(adapter).alias("adapter_id"),
        F.coalesce("name", _stem(F.col("source_path"))).alias("name"),
        "cwd",
        F.lit("").alias("git_remote"),
        F.lit("").alias("branch"),
        F.coalesce("model", F.lit("")).alias("model"),
        "started_at",
        "ended_at",
        "source_path",
        F.lit(kind).alias("source_format"),
    )


# Session files with side chains, compaction and replayed usage.

_SESSION_USAGE = dict(zip(TOKENS, (f"$.message.usage.{name}" for name in ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens"))))
_SESSION_PATHS = {
    "$.sessionId", "$.type", "$.subtype", "$.message.content", "$.summary", "$.content", "$.message.model", "$.isSidechain", "$.uuid", "$.parentUuid",
    "$.requestId", "$.message.id", "$.timestamp", "$.cwd", "$.gitBranch", *_SESSION_USAGE.values(),
}


def read_sessions(source: DataFrame, adapter: str = "claude-code") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Conversations, messages and tool calls of block-structured session lines.

    A compact_boundary row opens a new segment, a conversation of its own whose parent is the one before it.
    Usage that a request repeats counts once, at its first assistant row. Results meet their calls by id. The lines are
    taken apart once: their rows are written to the shared folder, and all three tables come from what was written.
    """
    subagent = F.regexp_extract("path", r"([^/]+)/subagents/[^/]+$", 1)
    rows = source.select("path", "line", F.from_json("value", _shape(_SESSION_PATHS)).alias("row"))
    rows = rows.select("*", F.col("row.message.content").alias("content_json"), subagent.alias("spawner"))
    rows = rows.withColumn("parts", blocks(F.col("content_json")))
    joined = lambda what, path: F.array_join(F.filter(F.transform("parts", lambda x: F.when(text_at(x, "$.type") == what, text_at(x, path)).otherwise("")), lambda t: t != ""), SEPARATOR)
    text = F.coalesce(joined("text", "$.text"), F.trim("content_json"), _text("$.summary", "$.content"))
    thinking = F.coalesce(joined("thinking", "$.thinking"), F.lit(""))
    tools = F.coalesce(F.array_join(F.filter(F.transform("parts", lambda x: F.when(text_at(x, "$.type") == "tool_use", F.concat(F.lit("[tool:"), text_at(x, "$.name"), F.lit("]"))).otherwise("")), lambda t: t != ""), SEPARATOR), F.lit(""))
    results = F.coalesce(F.array_join(F.filter(F.transform("parts", lambda x: F.when(text_at(x, "$.type") == "tool_result", flat_text(F.get_json_object(x, "$.content"))).otherwise("")), lambda t: t != ""), SEPARATOR), F.lit(""))
    pick = F.coalesce(*(F.nullif(c, F.lit("")) for c in (text, results, thinking, tools)), F.lit(""))
    session = F.coalesce(F.nullif(_text("$.sessionId"), F.lit("")), _stem(F.col("path")))
    kind = _text("$.type")
    rows = rows.select(
        "path", "line", "spawner", "parts",
        F.when(F.col("spawner") != "", _stem(F.col("path"))).otherwise(session).alias("session"),
        kind.alias("record_type"),
        ((kind == "system") & (_text("$.subtype") == "compact_boundary") & (F.col("line") > 0)).alias("boundary"),
        F.when(kind.isin("user", "assistant"), kind).otherwise("system").alias("role"),
        pick.alias("content"), thinking.alias("thinking_content"),
        _text("$.message.model").alias("model"),
        (_text("$.isSidechain") == "true").alias("is_sidechain"),
        _text("$.uuid").alias("uuid"), _text("$.parentUuid").alias("parent_uuid"),
        _text("$.requestId").alias("request"), _text("$.message.id").alias("message_key"),
        F.coalesce(F.nullif(iso_or(_text("$.timestamp"), F.lit(None).cast("timestamp")), F.lit("")), _text("$.timestamp")).alias("timestamp"),
        _text("$.cwd").alias("cwd"), _text("$.gitBranch").alias("branch"),
        *(number(_found(path)).alias(name) for name, path in _SESSION_USAGE.items()),
    )
    # rows that don't count go behind the window: a filter before it would work out each content twice
    rows = R.segments(rows, "session", "line", F.col("boundary")).withColumnRenamed("segment_id", "conversation_id")
    rows = rows.where("record_type IN ('user', 'assistant', 'system', 'summary') AND content != ''")
    # the windows below all lie within a conversation, so its rows move once
    rows = rows.repartition("conversation_id")
    rows = rows.withColumn("counters", F.when((F.col("request") != "") | (F.col("message_key") != ""), F.concat_ws("|", *TOKENS)).otherwise(""))
    rows = R.dedup_usage(rows, ["request", "message_key", "counters"], "conversation_id", "line")
    rows = rows.withColumn("seed", F.when(F.col("uuid") != "", F.col("uuid")).otherwise(F.concat_ws(":", "record_type", "timestamp")))
    rows = R.occurrence_ids(rows, "conversation_id", "seed", "line").withColumnRenamed("stable_id", "id")
    w = Window.partitionBy("conversation_id").orderBy("line")
    rows = rows.withColumns(
        {
            "sequence": (F.row_number().over(w) - 1).cast("int"),
            "turn": R.sidechain_turn(F.col("role"), F.col("is_sidechain"), "conversation_id", "line"),
            "thinking_tokens": F.when(F.col("thinking_content") == "", 0).otherwise(S.estimated_tokens(F.col("thinking_content"))).cast("long"),
        }
    )
    rows = saved(rows.drop("boundary", "counters", "is_replay", "seed", "occurrence", "request", "message_key"))
    messages = R.latest_before(rows, "conversation_id", "uuid", "parent_uuid", "line", "id").withColumn("parent_message_id", F.coalesce("parent_value", F.lit("")))
    return _segment_conversations(rows, adapter), messages.select(*_MESSAGE), _stitched(rows)


def _stitched(rows: DataFrame) -> DataFrame:
    """Calls of assistant rows with the last result of their id in the segment."""
    parts = rows.select("conversation_id", F.col("id").alias("message_id"), "line", F.posexplode("parts").alias("pos", "part"))
    calls = parts.where(text_at("part", "$.type") == "tool_use").select(
        text_at("part", "$.id").alias("id"), "conversation_id", "message_id", text_at("part", "$.name").alias("name"), text_at("part", "$.input").alias("input")
    )
    results = parts.where(text_at("part", "$.type") == "tool_result").groupBy("conversation_id", text_at("part", "$.tool_use_id").alias("id")).agg(
        F.max_by(F.struct(flat_text(F.get_json_object("part", "$.content")).alias("output"), (text_at("part", "$.is_error") == "true").alias("is_error")), F.struct("line", "pos")).alias("r")
    )
    joined = calls.join(results, ["conversation_id", "id"], "left")
    return joined.select(
        "id", "conversation_id", "message_id", "name", "input", F.coalesce("r.output", F.lit("")).alias("output"), F.coalesce("r.is_error", F.lit(False)).alias("is_error"), F.lit(-1).cast("long").alias("duration_ms")
    )


def _segment_conversations(rows: DataFrame, adapter: str) -> DataFrame:
    names, models = R.conversation_names(rows), R.primary_model(rows).drop("uses")
    base = rows.groupBy("conversation_id").agg(
        F.min("session").alias("session"), F.min("relationship").alias("own"), F.min("parent_segment_id").alias("up"), F.max("spawner").alias("spawner"), F.min("segment").alias("segment"),
        F.min_by("timestamp", "line").alias("started_at"), F.max_by("timestamp", "line").alias("ended_at"), F.min("path").alias("source_path"),
        F.coalesce(F.max(F.nullif("cwd", F.lit(""))), F.lit("")).alias("cwd"), F.coalesce(F.max(F.nullif("branch", F.lit(""))), F.lit("")).alias("branch"),
    )
    spawned = (F.col("spawner") != "") & (F.col("segment") == 0)
    out = base.join(names, "conversation_id", "left").join(models, "conversation_id", "left")
    return out.select(
        F.col("conversation_id").alias("id"),
        F.when(F.col("spawner") != "", F.col("spawner")).otherwise(F.col("session")).alias("trace_id"),
        F.when(spawned, F.col("spawner")).otherwise(F.col("up")).alias("parent_id"),
        F.when(spawned, "spawned").otherwise(F.col("own")).alias("relationship"),
        F.lit(-1).alias("fork_point"), F.lit(adapter).alias("adapter_id"),
        F.coalesce("name", F.substring("session", 1, 8)).alias("name"), "cwd", F.lit("").alias("git_remote"), "branch", F.coalesce("model", F.lit("")).alias("model"),
        "started_at", "ended_at", "source_path", F.lit("jsonl").alias("source_format"),
    )


def fork_points(conversations: DataFrame, messages: DataFrame, tool_calls: DataFrame) -> DataFrame:
    """`conversations` whose spawned rows name the turn of the parent's first call that mentions them.

    Needles are matched only with calls of their parent, so the join is on the parent's id.
    """
    order = messages.select("conversation_id", F.col("id").alias("message_id"), "sequence", "turn")
    calls = tool_calls.join(order, ["conversation_id", "message_id"]).select(F.col("conversation_id").alias("p"), "sequence", "turn", F.concat_ws(" ", "name", "input", "output").alias("hay"))
    children = conversations.where("relationship = 'spawned'").select("id", "parent_id", F.regexp_replace("id", "^agent-", "").alias("needle"))
    found = children.join(calls, children["parent_id"] == calls["p"]).where(F.col("hay").contains(F.col("needle")))
    found = found.groupBy("id").agg(F.min_by("turn", F.struct("sequence", "turn")).alias("found"))
    return conversations.join(found, "id", "left").withColumn("fork_point", F.coalesce("found", "fork_point")).drop("found")
