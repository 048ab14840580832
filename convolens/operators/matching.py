"""Results of tool calls matched with the calls they answer: by id, else by name, else the latest call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def claims(events: DataFrame, scope: str = "conversation_id") -> DataFrame:
    """(scope, place, ord, of_place, of_ord): the call that each result answers, null if none stands before it.

    `events` has scope, place, ord, kind ('call' or 'result'), call_id and name ('' if unknown); place is the
    message, ord the block inside it. A result behind calls of its own message answers one of those, else one of an
    earlier message: the latest of its id, else the latest of its name, else the latest of all. Each of the three is
    carried forward by a sort, without a join.
    """
    call = F.when(F.col("kind") == "call", F.struct("place", "ord"))
    before = lambda *keys: F.last(call, ignorenulls=True).over(Window.partitionBy(scope, *keys).orderBy("place", "ord").rowsBetween(Window.unboundedPreceding, -1))
    marked = events.withColumns({"of_id": F.when(F.col("call_id") != "", before("call_id")), "of_name": F.when(F.col("name") != "", before("name")), "of_any": before()})
    inside = F.col("of_any.place") == F.col("place")
    own: Column = F.coalesce(*(F.when(F.col(f"{c}.place") == F.col("place"), F.col(c)) for c in ("of_id", "of_name")), "of_any")
    found = marked.where("kind = 'result'").withColumn("of", F.when(inside, own).otherwise(F.coalesce("of_id", "of_name", "of_any")))
    return found.select(scope, "place", "ord", F.col("of.place").alias("of_place"), F.col("of.ord").alias("of_ord"))


def answered(events: DataFrame, scope: str = "conversation_id") -> DataFrame:
    """The calls of `events` with output and is_error: of several results the last gives the output, any the error.

    Results have output and is_error. Calls without a result have '' and false.
    """
    results = events.where("kind = 'result'").select(scope, "place", "ord", "output", "is_error")
    taken = claims(events, scope).where("of_place IS NOT NULL").join(results, [scope, "place", "ord"])
    per_call = taken.groupBy(scope, F.col("of_place").alias("place"), F.col("of_ord").alias("ord")).agg(
        F.max_by("output", F.struct("place", "ord")).alias("output"), F.bool_or("is_error").alias("is_error")
    )
    calls = events.where("kind = 'call'").drop("output", "is_error", "kind")
    joined = calls.join(per_call, [scope, "place", "ord"], "left")
    return joined.withColumns({"output": F.coalesce("output", F.lit("")), "is_error": F.coalesce("is_error", F.lit(False))})
