"""Traces as trees: parent links followed by joins on written tables, one a level or one a doubling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..streaming.state import saved


def climbed(links: DataFrame, scope: list[str]) -> DataFrame:
    """(*scope, id, up, at, steps, least): where the walk up from each id ends, walks doubling in length each round.

    `links` has the columns of scope, id and up, an id of the same scope or null. A walk that ended is at an id
    without up, after `steps` links; one in a circle is somewhere in it, after more steps than there are ids. `least`
    is the least id that it met behind its start.
    """
    here = F.coalesce("up", "id")
    walk = saved(links.select(*scope, "id", "up", here.alias("at"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("steps"), here.alias("least")))
    for _ in range(walk.count().bit_length() + 1):
        ahead = walk.select(*scope, F.col("id").alias("at"), F.col("at").alias("far"), F.col("steps").alias("more"), F.col("least").alias("other"))
        joined = walk.join(ahead, [*scope, "at"])
        if joined.where("more > 0").isEmpty():
            break
        # steps past those of any chain mean a circle: they needn't grow on
        steps = F.least(F.col("steps") + F.col("more"), F.lit(1 << 60))
        walk = saved(joined.select(*scope, "id", "up", F.col("far").alias("at"), steps.alias("steps"), F.least("least", "other").alias("least")))
    return walk


def top_traces(links: DataFrame) -> DataFrame:
    """(id, trace): of (id, parent_id, trace_id), each id once, the trace that its topmost known ancestor names.

    That is the ancestor itself, or the parent that it names where that one isn't known. Circles keep what they have.
    """
    known = links.select(F.col("id").alias("parent_id"), F.lit(True).alias("known"))
    own = links.join(known, "parent_id", "left").select("id", F.when(F.col("known") & (F.col("parent_id") != F.col("id")), F.col("parent_id")).alias("up"))
    walk = climbed(own, [])
    ends = walk.where("up IS NULL").select(F.col("id").alias("at")).join(links.select(F.col("id").alias("at"), F.col("parent_id").alias("above")), "at")
    found = walk.select("id", "at").join(ends, "at").select("id", F.when(F.col("above").isin("") | (F.col("above") == F.col("at")), F.col("at")).otherwise(F.col("above")).alias("trace"))
    return links.select("id", "trace_id").join(found, "id", "left").select("id", F.coalesce("trace", "trace_id").alias("trace"))


def trace(conversations: DataFrame, trace_id: str) -> DataFrame:
    return conversations.where(F.col("trace_id") == trace_id).orderBy("started_at", "ended_at", "id")


def roots(conversations: DataFrame) -> DataFrame:
    """(trace_id, id): of each trace the root row, else one without a parent, else the one named like the trace,
    else one whose parent isn't in the trace, else the earliest."""
    parents = conversations.select(F.col("trace_id").alias("t"), F.col("id").alias("p")).distinct()
    known = conversations.join(parents, (F.col("trace_id") == F.col("t")) & (F.col("parent_id") == F.col("p")), "left")
    rank = F.when(F.col("relationship") == "root", 0).when(F.col("parent_id") == "", 1).when(F.col("id") == F.col("trace_id"), 2).when(F.col("p").isNull(), 3).otherwise(4)
    dated = (S.iso_time(F.col("started_at")).asc_nulls_last(), F.col("started_at"), S.iso_time(F.col("ended_at")).asc_nulls_last(), F.col("ended_at"), F.col("id"))
    plain = (F.col("started_at"), F.col("ended_at"), F.col("id"))
    w = Window.partitionBy("trace_id").orderBy("rank", *(F.when(F.col("rank") < 4, c) for c in plain), *dated)
    return known.withColumn("rank", rank).withColumn("n", F.row_number().over(w)).where("n = 1").select("trace_id", "id")


def _grown(rows: DataFrame) -> DataFrame:
    """(trace_id, id, depth, path, prefix) of what the root of each trace reaches, level by level.

    `rows` has trace_id, id, parent_id, key and step; path joins the keys from the root down, prefix the
    steps below it. A path never visits an id twice. Each level is one join, written to the shared folder;
    levels end when one adds nothing.
    """
    rows = saved(rows)
    first = rows.join(roots(rows), ["trace_id", "id"], "left_semi")
    level = saved(first.select("trace_id", "id", F.lit(0).alias("depth"), F.col("key").alias("path"), F.lit("").alias("prefix"), F.array("id").alias("seen")))
    below = rows.select("trace_id", F.col("parent_id").alias("up"), F.col("id").alias("own"), "key", "step")
    levels = []
    while not level.isEmpty():
        levels.append(level)
        up = level.withColumnRenamed("id", "up")
        found = up.join(below, ["trace_id", "up"]).where(~F.array_contains("seen", F.col("own")))
        prefix = F.when(F.col("prefix") == "", F.col("step")).otherwise(F.concat("prefix", F.lit(">"), "step"))
        path = F.concat("path", F.lit(">"), "key")
        level = saved(found.select("trace_id", F.col("own").alias("id"), (F.col("depth") + 1).alias("depth"), path.alias("path"), prefix.alias("prefix"), F.array_append("seen", F.col("own")).alias("seen")))
    return reduce(DataFrame.union, levels or [level]).drop("seen")


def trees(conversations: DataFrame) -> DataFrame:
    """(trace_id, id, depth, path) of what the root of each trace reaches; a path never visits an id twice.

    `path` sorts a tree in pre-order with siblings by start, end and id.
    """
    key = F.concat_ws("|", F.col("started_at"), F.col("ended_at"), F.col("id"))
    rows = conversations.select("trace_id", "id", "parent_id", "relationship", "started_at", "ended_at", key.alias("key"), F.lit("").alias("step"))
    return _grown(rows).drop("prefix")


def nested(conversations: DataFrame, trace_id: str) -> dict | None:
    """One trace as nested dicts of id and children, for a view; a trace is what one user started."""
    rows = trees(conversations.where(F.col("trace_id") == trace_id)).orderBy("path").collect()
    stack: list[dict] = []
    for r in rows:
        node = {"id": r["id"], "children": []}
        del stack[r["depth"] :]
        if stack:
            stack[-1]["children"].append(node)
        stack.append(node)
    return stack[0] if stack else None


def children(conversations: DataFrame) -> DataFrame:
    """(id, parent_id, siblings): children of each parent in the same trace."""
    w = Window.partitionBy("trace_id", "parent_id").orderBy("started_at", "ended_at", "id")
    return conversations.where("parent_id != ''").select("trace_id", "parent_id", "id", F.row_number().over(w).alias("place"))


def parents(conversations: DataFrame) -> DataFrame:
    """Each conversation with its parent's name, null where the parent isn't in the trace."""
    up = conversations.select(F.col("trace_id").alias("t"), F.col("id").alias("p"), F.col("name").alias("parent_name"))
    return conversations.join(up, (F.col("trace_id") == F.col("t")) & (F.col("parent_id") == F.col("p")), "left").drop("t", "p")


def orphans(conversations: DataFrame) -> DataFrame:
    up = conversations.select(F.col("id").alias("parent_id"))
    return conversations.where("parent_id != ''").join(up, "parent_id", "left_anti").select("id", "parent_id", "adapter_id", "relationship").orderBy("id")


def trace_consistency(conversations: DataFrame) -> DataFrame:
    """(id, trace_id, top): conversations whose walk up ends at another id than their trace.

    Walks double in length each round. One that never ends (parents in a circle) has a null top.
    """
    ids = conversations.select(F.col("id").alias("up"), F.lit(True).alias("known"))
    walk = conversations.select("id", "trace_id", F.col("parent_id").alias("up")).join(ids, "up", "left")
    walk = saved(walk.select("id", "trace_id", F.col("id").alias("top"), F.when(F.col("known"), F.col("up")).alias("up")))
    for _ in range(walk.count().bit_length() + 1):
        if walk.where("up IS NOT NULL").isEmpty():
            break
        ahead = walk.select(F.col("id").alias("up"), F.col("top").alias("far"), F.col("up").alias("next"))
        walk = saved(walk.join(ahead, "up", "left").select("id", "trace_id", F.coalesce("far", "top").alias("top"), F.col("next").alias("up")))
    top = F.when(F.col("up").isNull(), F.col("top"))
    return walk.select("id", "trace_id", top.alias("top")).where("NOT (top <=> trace_id)")


def render_order(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """(trace_id, place, kind, id): each message of a trace; a spawned child after the last message of its fork
    turn, other children behind the messages, compacted continuations last.

    A child's messages stand below its parent's place, so sorting by nested keys gives the order.
    """
    pad = lambda c: F.lpad(c.cast("string"), 8, "0")
    lasts = messages.groupBy("conversation_id", "turn").agg(F.max("sequence").alias("last"))
    at = conversations.join(lasts, (F.col("parent_id") == F.col("conversation_id")) & (F.col("fork_point") == F.col("turn")), "left")
    group = F.when(F.col("relationship") == "compacted", 2).when(F.col("last").isNull(), 1).otherwise(0)
    step = F.concat_ws("~", group.cast("string"), pad(F.when(group == 0, F.col("last")).otherwise(0)), F.lit("1"), F.col("started_at"), F.col("ended_at"), F.col("id"))
    rows = at.select("trace_id", "id", "parent_id", "relationship", "started_at", "ended_at", F.col("id").alias("key"), step.alias("step"))
    prefix = _grown(rows).select("trace_id", "id", "prefix")
    key = F.concat_ws(">", F.nullif("prefix", F.lit("")), F.concat_ws("~", F.lit("0"), pad(F.col("sequence")), F.lit("0"), F.col("m.id")))
    rows = messages.alias("m").join(prefix.alias("c"), F.col("m.conversation_id") == F.col("c.id")).select("c.trace_id", key.alias("key"), F.col("m.id").alias("id"), "m.conversation_id")
    return rows.select("trace_id", F.row_number().over(Window.partitionBy("trace_id").orderBy("key")).alias("place"), "conversation_id", "id")
