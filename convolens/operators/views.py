"""Views: what a screen or a command shows, as small results of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Store
from . import filters as L
from . import graph as G
from . import routing as P
from . import usage as U

#: How many of each a home view shows.
TOP = {"adapters": 5, "tools": 5, "models": 8, "harness": 7, "recent": 6}


def home(store: Store, since: str | None = None) -> dict[str, DataFrame]:
    c = store.conversations
    return {
        "overview": U.overview(c),
        "recent": L.list_conversations(c, limit=TOP["recent"]),
        "adapters": U.top(U.by_adapter(c), TOP["adapters"], F.desc("conversations"), F.desc("tokens"), F.desc("cost"), "adapter_id"),
        "tools": U.top(U.by_tool(store.tool_calls), TOP["tools"], F.desc("calls"), "name"),
        "models": U.top(U.by_model(store.messages), TOP["models"], F.desc("messages"), "model"),
        "projects": U.projects_by_harness(c, TOP["harness"]),
        "relationships": L.relationship_mix(c),
        "days": U.timeline_by_day(c, since),
        "weeks": U.timeline_by_week(c, since),
    }


def conversation_list(store: Store, filters: L.Filters, limit: int | None = None, offset: int | None = None) -> dict[str, DataFrame]:
    """Rows, page and facets; a facet leaves its own filter out."""
    limit, offset = L.clamp(limit, 100, 200, 1), L.clamp(offset, 0, 2**31 - 1)
    f, c = filters, store.conversations
    return {
        "rows": L.list_conversations(c, f, limit, offset),
        "page": L.page(c, f, limit, offset),
        "repositories": L.distinct_values(c, "git_remote", L.Filters(f.adapter, f.since, None, f.relationship, f.search)),
        "adapters": L.distinct_values(c, "adapter_id"),
        "relationships": L.relationship_mix(c, L.Filters(f.adapter, f.since, f.remote, None, f.search)),
    }


def detail(store: Store, conversation_id: str) -> dict[str, DataFrame]:
    own = store.conversations.where(F.col("id") == conversation_id)
    trace = store.conversations.join(own.select("trace_id"), "trace_id", "left_semi")
    m = store.messages.where(F.col("conversation_id") == conversation_id)
    t = store.tool_calls.where(F.col("conversation_id") == conversation_id)
    return {
        "conversation": own,
        "messages": L.messages_with_tools(m, t).orderBy("sequence", "id"),
        "tool_calls": L.ordered_tool_calls(t, m),
        "parent": trace.join(own.select(F.col("parent_id").alias("id")), "id", "left_semi"),
        "children": trace.where(F.col("parent_id") == conversation_id).orderBy("started_at", "ended_at", "id"),
        "trace": U.overview(trace),
    }


def trace(store: Store, trace_id: str) -> dict:
    rows = G.trace(store.conversations, trace_id)
    return {"rows": rows, "tree": G.nested(store.conversations, trace_id), "messages": G.render_order(rows, store.messages)}


def routing(store: Store, routes: list[P.Route], active: list[str]) -> dict[str, DataFrame]:
    c = store.conversations
    return {"projects": U.projects(c), "flow": P.flow(c, routes, active), "unrouted": P.unrouted_projects(c, routes)}


def stats(store: Store) -> dict[str, DataFrame]:
    return {"overview": U.overview(store.conversations), "adapters": U.by_adapter(store.conversations), "models": U.by_model(store.messages)}


def merged_pages(*pages: DataFrame) -> DataFrame:
    """Pages put together; of a row that two show the first stays."""
    parts = [p.withColumn("_page", F.lit(n)) for n, p in enumerate(pages)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return L.first_hit_each(out, "id", F.col("_page")).drop("_page")


def usage_chart(store: Store, size: int = 14, offset: int = 0) -> DataFrame:
    """Daily usage of a window of days, zeros left out, at most a year back."""
    days = U.last_buckets(U.daily_usage(U.timeline_by_day(store.conversations)), "day", 366)
    return U.last_buckets(days, "day", size, offset)


def phases_report(phases: DataFrame) -> DataFrame:
    """One row over benchmark phases (name, status, wall_ms, peak_rss): total, peak, failed and skipped names."""
    names = lambda status: F.array_join(F.array_sort(F.collect_list(F.when(F.col("status") == status, F.col("name")))), ",")
    return phases.agg(F.sum("wall_ms").alias("total_ms"), F.max("peak_rss").alias("peak_rss"), names("failed").alias("failed"), names("skipped").alias("skipped"))


def dataset_manifest(conversations: DataFrame) -> DataFrame:
    """One row: conversations by relationship, traces, traces with a compaction or a spawned child."""
    each = conversations.groupBy("trace_id").agg(
        F.count("*").alias("n"), *(F.count_if(F.col("relationship") == r).alias(r) for r in ("root", "compacted", "spawned", "forked"))
    )
    return each.agg(
        F.sum("n").alias("conversations"), F.count("*").alias("traces"), *(F.sum(r).alias(r) for r in ("root", "compacted", "spawned", "forked")),
        F.count_if(F.col("compacted") > 0).alias("traces_compacted"), F.count_if(F.col("spawned") > 0).alias("traces_spawned"),
    )
