"""Derived columns: turns, names, models, costs and counts of a conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..model import TOKENS


def _in_order(key: str = "conversation_id", *order: str) -> Window:
    return Window.partitionBy(key).orderBy(*(order or ("sequence",))).rowsBetween(Window.unboundedPreceding, 0)


def running_turn(role: Column, key: str = "conversation_id", order: tuple[str, ...] = ("sequence",), skip_null: bool = False) -> Column:
    """Each user row opens a turn; rows before any user are in turn 0, which shifts later turns by one. `skip_null`: as if rows without a role weren't there."""
    w = _in_order(key, *order)
    users = F.sum((role == "user").cast("int")).over(w)
    return (users - (F.first(role, ignorenulls=skip_null).over(w) == "user").cast("int")).cast("int")


def sidechain_turn(role: Column, is_sidechain: Column, key: str = "conversation_id", order: str = "sequence") -> Column:
    """Turns of a tool with side chains: these and system rows get -1; an assistant before any user bumps all by one."""
    counts = ~is_sidechain & (role != "system")
    w = _in_order(key, order)
    users = F.sum((counts & (role == "user")).cast("int")).over(w)
    first = F.first(F.when(counts, role), ignorenulls=True).over(w)
    return F.when(counts, users + (first == "assistant").cast("int")).otherwise(-1).cast("int")


def context_turn(kind: Column, key: str = "conversation_id", order: str = "sequence") -> Column:
    """Turns counted by `turn_context` records; -1 before the first."""
    n = F.sum((kind == "turn_context").cast("int")).over(_in_order(key, order))
    return F.when(n == 0, -1).otherwise(n).cast("int")


def message_costs(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """`messages` with est_cost; a message without a model is priced by its conversation's."""
    models = conversations.select(F.col("id").alias("conversation_id"), F.col("model").alias("conversation_model"))
    model = F.coalesce(F.nullif("model", F.lit("")), "conversation_model", F.lit(""))
    priced = messages.join(models, "conversation_id").withColumn("price", S.prices(model))
    return priced.withColumn("est_cost", S.estimate_cost(F.col("price"), *(F.col(t) for t in TOKENS))).drop("conversation_model", "price")


def conversation_rollup(conversations: DataFrame, messages: DataFrame, tool_calls: DataFrame) -> DataFrame:
    """`conversations` with their derived columns made anew, each side aggregated before the join."""
    costs = message_costs(messages, conversations)
    sums = costs.groupBy("conversation_id").agg(
        F.count("*").alias("message_count"),
        F.greatest(F.max("turn"), F.lit(0)).cast("long").alias("turn_count"),
        *(F.sum(t).alias(t) for t in TOKENS),
        F.sum("est_cost").alias("est_cost"),
    )
    tools = tool_calls.groupBy("conversation_id").agg(F.count("*").alias("tool_count"))
    derived = ("duration_ms", "message_count", "turn_count", "tool_count", "est_cost", *TOKENS)
    base = conversations.drop(*derived)
    joined = base.join(sums, base["id"] == sums["conversation_id"], "left").drop("conversation_id")
    joined = joined.join(tools, joined["id"] == tools["conversation_id"], "left").drop("conversation_id")
    filled = joined.fillna(0, [c for c in derived if c != "duration_ms"])
    return filled.withColumn("duration_ms", S.duration_ms(F.col("started_at"), F.col("ended_at")))


def primary_model(messages: DataFrame, first_seen: bool = False) -> DataFrame:
    """(conversation_id, model, uses): the most used model; on ties the first by name, or the first seen."""
    uses = messages.where("model != ''").groupBy("conversation_id", "model").agg(F.count("*").alias("uses"), F.min("sequence").alias("seen"))
    tie = [F.col("seen"), F.col("model")] if first_seen else [F.col("model")]
    w = Window.partitionBy("conversation_id").orderBy(F.desc("uses"), *tie)
    return uses.withColumn("n", F.row_number().over(w)).where("n = 1").select("conversation_id", "model", "uses")


def conversation_names(messages: DataFrame, limit: int = 120) -> DataFrame:
    """(conversation_id, name): the first user text that isn't blank."""
    named = messages.where(F.col("role") == "user").withColumn("name", S.first_line_name(F.col("content"), limit)).where("name != ''")
    return named.groupBy("conversation_id").agg(F.min_by("name", "sequence").alias("name"))


def dedup_usage(messages: DataFrame, fingerprint: list[str], partition: str = "conversation_id", order: str = "sequence") -> DataFrame:
    """Counters of an assistant row that repeats an earlier row's fingerprint become 0; an empty fingerprint never repeats."""
    w = Window.partitionBy(partition, *fingerprint, "role").orderBy(order)
    empty = F.concat(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fingerprint)) == ""
    again = (F.col("role") == "assistant") & ~empty & (F.row_number().over(w) > 1)
    marked = messages.withColumn("is_replay", again)
    return marked.withColumns({t: F.when(F.col("is_replay"), 0).otherwise(F.col(t)).cast("long") for t in TOKENS})


def occurrence_ids(rows: DataFrame, partition: str, seed: str, order: str) -> DataFrame:
    """`rows` with occurrence (from 1) and a stable id of partition, seed and occurrence."""
    w = Window.partitionBy(partition, seed).orderBy(order)
    numbered = rows.withColumn("occurrence", F.row_number().over(w))
    return numbered.withColumn("stable_id", S.stable_id(F.col(partition), F.col(seed), F.col("occurrence").cast("string")))


def latest_before(rows: DataFrame, partition: str, key: str, ref: str, order: str, value: str) -> DataFrame:
    """As-of self join: `value` of the latest earlier row whose `key` is this row's `ref`, as parent_value.

    Rows and references are laid on one line by `order` for each (partition, key), where the last row seen
    is carried forward: one sort in place of a join on a range.
    """
    rows = rows.withColumn("_ref", F.coalesce(F.col(ref), F.lit("")))
    defs = rows.where(F.col(key) != "").select(F.col(partition).alias("_p"), F.col(key).alias("_k"), F.col(order).alias("_o"), F.lit(1).alias("_what"), F.col(value).alias("_v"))
    refs = rows.where("_ref != ''").select(F.col(partition).alias("_p"), F.col("_ref").alias("_k"), F.col(order).alias("_o"), F.lit(0).alias("_what"), F.lit(None).alias("_v"))
    w = Window.partitionBy("_p", "_k").orderBy("_o", "_what").rowsBetween(Window.unboundedPreceding, 0)
    found = defs.union(refs).withColumn("parent_value", F.last("_v", ignorenulls=True).over(w)).where("_what = 0")
    found = found.groupBy("_p", "_k", "_o").agg(F.first("parent_value").alias("parent_value"))  # equal where the keys are
    return rows.join(found, (F.col(partition) == F.col("_p")) & (F.col("_ref") == F.col("_k")) & (F.col(order) == F.col("_o")), "left").drop("_p", "_k", "_o", "_ref")


def segments(rows: DataFrame, partition: str, order: str, boundary: Column) -> DataFrame:
    """`rows` with segment (running count of boundaries), segment_id, parent_segment_id and relationship."""
    w = Window.partitionBy(partition).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = rows.withColumn("segment", F.sum(boundary.cast("int")).over(w).cast("int"))
    name = lambda n: F.concat_ws("#", F.col(partition), n.cast("string"))
    first = F.col("segment") == 0
    return numbered.withColumns(
        {
            "segment_id": F.when(first, F.col(partition)).otherwise(name(F.col("segment"))),
            "parent_segment_id": F.when(first, "").when(F.col("segment") == 1, F.col(partition)).otherwise(name(F.col("segment") - 1)),
            "relationship": F.when(first, "root").otherwise("compacted"),
        }
    )
