"""Routes: conversations matched against glob rules, sinks of all that match."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S


@dataclass(frozen=True)
class Route:
    """A rule: all given patterns must match; an absent one matches anything."""

    sinks: tuple[str, ...]
    remote: str | None = None
    adapter: str | None = None
    branch: str | None = None
    name: str | None = None

    def condition(self, with_names: bool = True) -> Column:
        """Remote and adapter are compared in normal form, branch and name as they are; null never matches a pattern."""
        parts = [F.lit(True)]
        if self.remote is not None:
            parts.append(S.normalize_remote(F.col("git_remote")).rlike(S.glob_regex(S.normalize_remote_text(self.remote))))
        if self.adapter is not None:
            parts.append(F.lower(F.trim("adapter_id")).rlike(S.glob_regex(self.adapter.strip().lower())))
        if self.branch is not None:
            parts.append(F.col("branch").rlike(S.glob_regex(self.branch)))
        if self.name is not None and with_names:
            parts.append(F.col("name").rlike(S.glob_regex(self.name)))
        return F.coalesce(reduce(lambda a, b: a & b, parts), F.lit(False))


def routed(conversations: DataFrame, routes: list[Route], with_names: bool = True) -> DataFrame:
    """`conversations` with sinks: of all rules that match, in the order first seen.

    The rules are configuration, so each becomes an expression: no join, one pass over the rows.
    """
    none = F.array().cast("array<string>")
    parts = [F.when(r.condition(with_names), F.array(*(F.lit(s) for s in r.sinks))).otherwise(none) for r in routes]
    return conversations.withColumn("sinks", F.array_distinct(F.flatten(F.array(*parts))) if parts else none)


def flow(conversations: DataFrame, routes: list[Route], active: list[str]) -> DataFrame:
    """Per project: conversations, routed and unrouted ones, those of each active sink, all sinks."""
    rows = routed(conversations.where("git_remote != ''"), routes)
    live = F.array_intersect("sinks", F.array(*(F.lit(s) for s in active)).cast("array<string>"))
    rows = rows.withColumn("live", live)
    return rows.groupBy("git_remote").agg(
        F.count("*").alias("conversations"),
        F.count_if(F.size("live") > 0).alias("routed"),
        F.count_if(F.size("live") == 0).alias("unrouted"),
        *(F.count_if(F.array_contains("live", s)).alias(f"to_{s}") for s in active),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("live")))), ",").alias("sinks"),
    )


def unrouted_projects(conversations: DataFrame, routes: list[Route]) -> DataFrame:
    """Projects none of whose conversations a rule on remote or branch matches."""
    rows = routed(conversations.where("git_remote != ''"), [Route(r.sinks, r.remote, None, r.branch) for r in routes])
    return rows.groupBy("git_remote").agg(F.max(F.size("sinks")).alias("n")).where("n = 0").select("git_remote")


def merge_route(routes: list[Route], new: Route) -> list[Route]:
    """A rule with the same patterns takes the new sinks in; else the new one is added."""
    same = lambda r: (r.remote, r.adapter, r.branch, r.name) == (new.remote, new.adapter, new.branch, new.name)
    if not any(map(same, routes)):
        return [*routes, new]
    return [Route(tuple(dict.fromkeys((*r.sinks, *new.sinks))), r.remote, r.adapter, r.branch, r.name) if same(r) else r for r in routes]


def unknown_sinks(routes: DataFrame, configured: DataFrame) -> DataFrame:
    """Sinks that rules name and nobody configured."""
    return routes.select(F.explode("sinks").alias("sink_id")).distinct().join(configured, "sink_id", "left_anti")
