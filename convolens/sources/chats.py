"""An editor's chats: one database each, its messages in a graph of blobs that are known by their hashes.

A blob is a JSON message, perhaps with the id of its parent, or raw bytes that hold the ids of others. Read from the
root, a message's parent comes before it, and references in their order; what was read once isn't read again. All
databases are read at once, in four steps:

1. chains of parents are closed by doubling: each message's end of chain, and how far it is;
2. references and ends of chains make a small graph of entries, whose paths from the root grow level by level; an
   entry keeps its least path, which is the one that a reader in depth takes first;
3. each message belongs to the least path among the entries below it in its chain, again by doubling;
4. messages sort by that path and by their place in the chain.

So the number of steps follows the depth of nested references and the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import rollup as R
from ..operators.graph import climbed
from ..operators.matching import answered
from ..streaming.state import saved
from .composers import UNNAMED, WRAPPED
from .sqlite import MODIFIED, read_sqlite
from .transcripts import _MESSAGE, blocks, iso_or, text_at

#: In raw bytes, an id stands behind a tag whose low three bits are 2 and this length.
ID_BYTES = 32


def blob_rows(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(path, id, raw, data): the blobs, raw being the JSON object they hold or null; and (path, head, modified)."""
    rows = read_sqlite(spark, path, ["blobs"], ["id", "data"], ["data"]).where("id IS NOT NULL AND data IS NOT NULL AND data != ''")
    text = F.try_to_binary("data", F.lit("hex"))
    raw = F.try_validate_utf8(text.cast("string"))
    is_object = raw.rlike(r"^\s*\{") & F.try_parse_json(raw).isNotNull()
    blobs = rows.select("path", "id", F.when(is_object, raw).alias("raw"), F.when(~F.coalesce(is_object, F.lit(False)), F.lower("data")).alias("data"))
    metas = read_sqlite(spark, path, ["meta"], ["key", "value", MODIFIED]).where("key = '0'")
    head = F.try_validate_utf8(F.try_to_binary("value", F.lit("hex")).cast("string"))
    heads = metas.select("path", head.alias("head"), F.col(MODIFIED).alias("modified")).where(F.try_parse_json("head").isNotNull() & F.col("head").rlike(r"^\s*\{"))
    return blobs, heads.groupBy("path").agg(F.min("head").alias("head"), F.min("modified").alias("modified"))


def references(blobs: DataFrame) -> DataFrame:
    """(path, id, n, ref): the n-th id that a blob's raw bytes hold, of blobs that exist.

    Ids stand at any byte, so each place with a tag and the length in front is looked at. Known ids are met by a join.
    """
    last = F.length("data") / 2 - ID_BYTES - 2
    tagged = "cast(conv(substring(data, 2 * i + 2, 1), 16, 10) AS int) % 8 = 2 AND substring(data, 2 * i + 3, 2) = '20'"
    places = F.expr(f"filter(sequence(0, cast(length(data) / 2 AS int) - {ID_BYTES + 2}), i -> {tagged})")
    found = blobs.where(F.col("data").isNotNull() & (last >= 0)).select("path", "id", F.explode(places).alias("n"), "data")
    found = found.select("path", "id", "n", F.substring("data", 2 * F.col("n") + 5, F.lit(2 * ID_BYTES)).alias("ref"))
    return found.join(blobs.select("path", F.col("id").alias("ref")), ["path", "ref"])


def chains(links: DataFrame) -> DataFrame:
    """(path, id, up, at, steps): the end of each chain of parents and the links to it.

    A circle of parents is cut above its least id, which then has no parent.
    """
    walk = climbed(links, ["path"])
    ends = walk.where("up IS NULL").select("path", F.col("id").alias("at"))
    endless = walk.join(ends, ["path", "at"], "left_anti").select("path", "at").distinct()
    if not endless.isEmpty():
        cut = endless.join(walk.select("path", F.col("id").alias("at"), "least"), ["path", "at"]).select("path", F.col("least").alias("id"), F.lit(True).alias("cut")).distinct()
        walk = climbed(links.join(cut, ["path", "id"], "left").select("path", "id", F.when(F.col("cut").isNull(), F.col("up")).alias("up")), ["path"])
    return walk.select("path", "id", "up", "at", "steps")


def first_paths(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, node, key): the least path from the root to each node, of labels in order; a path meets a node once.

    `roots` has path and node, `edges` path, src, label (a number from 0) and dst. A reader in depth that takes each
    node once reaches it by this path. Each round grows the paths that got less in the one before.
    """
    state = saved(roots.select("path", "node", F.lit("").alias("key"), F.array("node").alias("met")))
    grown = state
    while True:
        step = F.concat("key", F.lpad(F.hex("label"), 8, "0"))
        found = grown.join(edges.withColumnRenamed("src", "node"), ["path", "node"]).where(~F.array_contains("met", F.col("dst")))
        found = found.groupBy("path", F.col("dst").alias("node")).agg(F.min(F.struct(step.alias("key"), F.concat("met", F.array("dst")).alias("met"))).alias("new"))
        grown = saved(found.join(state.select("path", "node", F.col("key").alias("old")), ["path", "node"], "left").where("old IS NULL OR new.key < old").select("path", "node", "new.key", "new.met"))
        if grown.isEmpty():
            return state.select("path", "node", "key")
        state = saved(state.join(grown, ["path", "node"], "left_anti").unionByName(grown))


def _least_below(chain: DataFrame, reached: DataFrame) -> DataFrame:
    """(path, id, key, steps): the least key among a message and all below it in chains; messages that none reaches are left out."""
    most = chain.agg(F.max("steps")).first()[0] or 0
    now = saved(chain.select("path", "id", F.col("up").alias("jump"), "steps").join(reached, ["path", "id"], "left"))
    for _ in range(most.bit_length()):
        sent = now.where("jump IS NOT NULL AND key IS NOT NULL").groupBy("path", F.col("jump").alias("id")).agg(F.min("key").alias("sent"))
        ahead = now.select("path", F.col("id").alias("jump"), F.col("jump").alias("next"))
        moved = now.join(ahead, ["path", "jump"], "left").join(sent, ["path", "id"], "left")
        now = saved(moved.select("path", "id", F.col("next").alias("jump"), "steps", F.least("key", "sent").alias("key")))
    return now.where("key IS NOT NULL").select("path", "id", "key", "steps")


def read_order(blobs: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, id, place): the messages that a root reaches, numbered as a reader in depth meets them.

    `blobs` has path, id, raw (a JSON message, or null) and data; `roots` path and node. Parents and references that
    are missing count as none.
    """
    blobs = saved(blobs)
    known = blobs.select("path", F.col("id").alias("parent"), F.col("raw").isNotNull().alias("is_message"))
    messages = blobs.where("raw IS NOT NULL").select("path", "id", F.get_json_object("raw", "$.parentId").alias("parent")).join(known, ["path", "parent"], "left")
    messages = saved(messages.select("path", "id", F.when(F.col("is_message"), F.col("parent")).alias("up"), F.when(~F.col("is_message"), F.col("parent")).alias("under")))
    chain = chains(messages.select("path", "id", "up"))
    # the raw bytes above a chain's end come before it
    unders = chain.join(messages.where("under IS NOT NULL").select("path", F.col("id").alias("at"), "under"), ["path", "at"])
    edges = saved(references(blobs).select("path", F.col("id").alias("src"), F.col("n").cast("long").alias("label"), F.col("ref").alias("dst")).unionByName(unders.select("path", F.col("id").alias("src"), F.lit(0).cast("long").alias("label"), F.col("under").alias("dst"))))
    reached = first_paths(roots.join(blobs.select("path", F.col("id").alias("node")), ["path", "node"]), edges)
    owned = _least_below(chain, reached.select("path", F.col("node").alias("id"), "key"))
    order = Window.partitionBy("path").orderBy(F.concat("key", F.lit("~")), "steps")  # behind all that its path goes on to
    return owned.select("path", "id", F.row_number().over(order).alias("place"))


_PART = "struct<type:string,text:string,toolName:string,name:string,toolCallId:string,isError:string>"


def _parts(value: str) -> dict:
    """Columns of a message's content: its text, its reasoning, and its blocks as JSON texts."""
    content = F.get_json_object(value, "$.content")
    is_list = F.schema_of_variant(F.try_variant_get(F.try_parse_json(F.col(value)), "$.content", "variant")).startswith("ARRAY")
    listed = F.when(is_list, blocks(content))
    parsed = F.transform(listed, lambda b: F.from_json(b, _PART))
    calls = ("tool-call", "tool_use", "tool-result", "tool_result")
    said = F.filter(parsed, lambda p: (F.coalesce(p["text"], F.lit("")) != "") & ~F.coalesce(p["type"], F.lit("")).isin(*calls))
    thought = F.filter(said, lambda p: p["type"] == "reasoning")
    join = lambda parts: F.array_join(F.transform(parts, lambda p: p["text"]), "\n")
    return {"content": F.coalesce(join(said), content, F.lit("")), "thinking_content": F.coalesce(join(thought), F.lit("")), "blocks": listed}


def _events(nodes: DataFrame) -> DataFrame:
    """Calls and results of messages' blocks, as `operators.matching` takes them; `nth` numbers a message's calls."""
    each = nodes.select("conversation_id", "place", F.col("id").alias("message_id"), F.posexplode("blocks").alias("ord", "b"))
    kind = text_at("b", "$.type")
    each = each.withColumn("kind", F.when(kind.isin("tool-call", "tool_use"), "call").when(kind.isin("tool-result", "tool_result"), "result")).where("kind IS NOT NULL")
    raw = lambda *paths: F.coalesce(*(F.get_json_object("b", p) for p in paths))
    nth = F.count(F.when(F.col("kind") == "call", 1)).over(Window.partitionBy("conversation_id", "place").orderBy("ord")) - 1
    return each.select(
        "conversation_id", "place", "ord", "message_id", "kind", text_at("b", "$.toolCallId").alias("call_id"), text_at("b", "$.toolName", "$.name").alias("name"), nth.alias("nth"),
        F.coalesce(raw("$.args", "$.input"), F.lit("{}")).alias("input"), F.coalesce(raw("$.result", "$.output"), F.lit("")).alias("output"), (text_at("b", "$.isError") == "true").alias("is_error"),
    )


def read_chats(spark: SparkSession, path: str | list[str], adapter: str = "cursor") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Conversations, messages and tool calls of chat databases. Of databases with one id, the latest counts.

    Blocks of text and reasoning are a message's content; a message without content and calls is left out. Results go
    to the calls they answer, also of earlier messages. A database without a readable head or root gives nothing.
    """
    blobs, heads = blob_rows(spark, path)
    given = F.coalesce(F.nullif(text_at("head", "$.agentId"), F.lit("")), F.element_at(F.split("path", "/"), -2))
    heads = heads.withColumn("conversation_id", given)
    newest = F.row_number().over(Window.partitionBy("conversation_id").orderBy(F.desc(F.col("modified").cast("long")), "path"))
    heads = saved(heads.withColumn("nth", newest).where("nth = 1").drop("nth"))
    blobs = saved(blobs.join(heads.select("path"), "path", "left_semi"))
    order = read_order(blobs, heads.select("path", text_at("head", "$.latestRootBlobId").alias("node")))
    nodes = order.join(blobs.select("path", "id", "raw"), ["path", "id"]).join(heads, "path")
    nodes = saved(nodes.withColumns(_parts("raw")).withColumn("has_call", F.exists(F.coalesce("blocks", F.array().cast("array<string>")), lambda b: F.get_json_object(b, "$.type").isin("tool-call", "tool_use"))))
    calls = answered(_events(nodes))
    rows = nodes.where("content != '' OR has_call").withColumns({"sequence": (F.row_number().over(Window.partitionBy("conversation_id").orderBy("place")) - 1).cast("int"), "role": F.coalesce(*(F.when(F.get_json_object("raw", "$.role") == r, r) for r in ("user", "system")), F.lit("assistant"))})
    own_id = lambda c: F.concat_ws(":", "conversation_id", c)
    updated = iso_or(F.col("modified"), F.lit(None).cast("timestamp"))
    created = iso_or(text_at("head", "$.createdAt"), F.lit(None).cast("timestamp"))
    zero, w = F.lit(0).cast("long"), Window.partitionBy("conversation_id").orderBy("sequence")
    messages = rows.withColumns({"blob": F.col("id"), "id": own_id("id")}).select(
        "*", F.lit("").alias("record_type"), F.coalesce(F.nullif(text_at("raw", "$.model"), F.lit("")), text_at("head", "$.model")).alias("model"), R.running_turn(F.col("role")).alias("turn"), F.lit(False).alias("is_sidechain"),
        F.coalesce(F.lag("id").over(w), F.lit("")).alias("parent_message_id"), zero.alias("input_tokens"), zero.alias("output_tokens"), zero.alias("cache_read"), zero.alias("cache_write"), zero.alias("thinking_tokens"),
        F.coalesce(iso_or(text_at("raw", "$.createdAt"), F.lit(None).cast("timestamp")), created, updated).alias("timestamp"),
    )
    calls = calls.select(
        F.when(F.col("call_id") != "", own_id("call_id")).otherwise(F.concat_ws(":", "conversation_id", "message_id", F.lit("tool"), F.col("nth").cast("string"))).alias("id"), "conversation_id", own_id("message_id").alias("message_id"),
        F.coalesce(F.nullif("name", F.lit("")), F.concat(F.lit("tool_"), F.col("nth").cast("string"))).alias("name"), "input", "output", "is_error", F.lit(-1).cast("long").alias("duration_ms"),
    )
    users = messages.where("role = 'user' AND content != ''")
    bare = F.regexp_replace("content", WRAPPED, "")
    ends = messages.groupBy("conversation_id").agg(F.max_by("timestamp", "sequence").alias("last"))
    firsts = users.groupBy("conversation_id").agg(F.min_by(F.when(F.trim(bare) != "", F.substring(F.trim(bare), 1, 80)), F.when(F.trim(bare) != "", F.col("sequence"))).alias("first"), F.min_by(F.substring("content", 1, 80), "sequence").alias("plain"))
    out = heads.join(ends, "conversation_id").join(firsts, "conversation_id", "left")
    conversations = out.select(
        F.col("conversation_id").alias("id"), F.col("conversation_id").alias("trace_id"), F.lit("").alias("parent_id"), F.lit("root").alias("relationship"), F.lit(-1).alias("fork_point"), F.lit(adapter).alias("adapter_id"),
        F.coalesce(F.nullif(F.nullif(text_at("head", "$.name"), F.lit(UNNAMED)), F.lit("")), "first", "plain", F.substring("conversation_id", 1, 8)).alias("name"),
        F.url_decode(F.regexp_replace(text_at("head", "$.workspaceUri", "$.workspaceUris[0]", "$.cwd", "$.workingDirectory"), "^file://", "")).alias("cwd"), F.lit("").alias("git_remote"), F.lit("").alias("branch"),
        text_at("head", "$.model").alias("model"), F.coalesce(created, updated).alias("started_at"), F.coalesce("last", updated).alias("ended_at"), F.col("path").alias("source_path"), F.lit("sqlite").alias("source_format"),
    )
    return conversations, messages.select(*_MESSAGE), calls
