"""The registered queries over the lens, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import filters as L
from ..operators import graph as G
from ..operators import legacy as V1
from ..operators import matching as MT
from ..operators import rollup as R
from ..operators import routing as P
from ..operators import search as FT
from ..operators import sync as Y
from ..operators import upkeep as K
from ..operators import usage as U
from ..sources import chats as C
from . import lens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

ROUTES = [
    P.Route(("warehouse",), remote="https://GitHub.com/acme/repo*.git", adapter="c*"),
    P.Route(("hook", "warehouse"), branch="feature/*"),
    P.Route(("bucket",), remote="github.com/acme/repo?", branch="main", adapter="amp"),
]
NOW = "2024-03-05T00:00:00.000Z"


def query(sql: str | None = None) -> Callable:
    """Registers a query; `sql` follows the lens' common tables, or stands alone if it starts with WITH or SELECT!."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = lens.SQL + sql
        return f

    return register


_TOKEN_SUMS = """sum(message_count)::BIGINT AS messages, sum(tokens)::BIGINT AS tokens, sum(input_tokens + output_tokens)::BIGINT AS display_tokens,
 sum(cache_read + cache_write)::BIGINT AS cache_tokens, round(sum(est_cost), 10) AS cost"""


@query(f"SELECT count(*) AS conversations, {_TOKEN_SUMS}, sum(tool_count)::BIGINT AS tool_calls, count(DISTINCT trace_id) AS traces, count(DISTINCT nullif(git_remote, '')) AS projects FROM conv")
def overview_summary(spark, sf):
    return U.overview(lens.store(spark, sf).conversations)


@query(f"SELECT adapter_id, count(*) AS conversations, {_TOKEN_SUMS} FROM conv GROUP BY 1")
def usage_by_adapter(spark, sf):
    return U.by_adapter(lens.store(spark, sf).conversations)


@query("""SELECT model, count(*) AS messages, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(cache_read)::BIGINT AS cache_read, sum(cache_write)::BIGINT AS cache_write
FROM msg WHERE model != '' GROUP BY 1""")
def usage_by_model(spark, sf):
    return U.by_model(lens.messages(spark, sf))


@query("SELECT name, count(*) AS calls, count(DISTINCT conversation_id) AS conversations FROM tool GROUP BY 1")
def tool_usage(spark, sf):
    return U.by_tool(lens.tool_calls(spark, sf))


@query("SELECT id, message_count, turn_count, tool_count, duration_ms, input_tokens, output_tokens, cache_read, cache_write, round(est_cost, 10) AS est_cost FROM conv")
def conversation_rollup(spark, sf):
    out = lens.store(spark, sf).conversations
    return out.select("id", "message_count", "turn_count", "tool_count", "duration_ms", "input_tokens", "output_tokens", "cache_read", "cache_write", F.round("est_cost", 10).alias("est_cost"))


@query("SELECT id, model, round(est_cost, 10) AS est_cost FROM conv ORDER BY round(est_cost, 10) DESC, id LIMIT 10")
def top_cost(spark, sf):
    rows = lens.store(spark, sf).conversations.select("id", "model", F.round("est_cost", 10).alias("est_cost"))
    return U.top(rows, 10, F.desc("est_cost"), "id")


@query("SELECT substr(activity, 1, 10) AS day, adapter_id, count(*) AS sessions, sum(tokens)::BIGINT AS tokens, round(sum(est_cost), 10) AS cost FROM conv WHERE activity >= '2024-01-15' GROUP BY 1, 2")
def timeline_by_day(spark, sf):
    return U.timeline_by_day(lens.store(spark, sf).conversations, "2024-01-15")


@query("""SELECT strftime(date_trunc('week', CAST(substr(activity, 1, 10) AS DATE)), '%Y-%m-%d') AS week_start, strftime(date_trunc('week', CAST(substr(activity, 1, 10) AS DATE)) + INTERVAL 6 DAY, '%Y-%m-%d') AS week_end,
adapter_id, count(*) AS sessions, sum(tokens)::BIGINT AS tokens, round(sum(est_cost), 10) AS cost FROM conv GROUP BY 1, 2, 3""")
def timeline_by_week(spark, sf):
    return U.timeline_by_week(lens.store(spark, sf).conversations)


@query("""SELECT git_remote, replace(git_remote, '/', '%2F') AS id, count(*) AS conversations, sum(tokens)::BIGINT AS tokens, round(sum(est_cost), 10) AS cost, max(activity) AS last_seen,
string_agg(DISTINCT adapter_id, ',' ORDER BY adapter_id) AS adapters FROM conv WHERE git_remote != '' GROUP BY 1""")
def projects_by_remote(spark, sf):
    return U.projects(lens.store(spark, sf).conversations)


@query(""", each AS (SELECT git_remote, adapter_id, count(*) AS conversations, sum(tokens)::BIGINT AS tokens, sum(est_cost) AS c, max(activity) AS seen FROM conv WHERE git_remote != '' GROUP BY 1, 2),
p AS (SELECT git_remote, sum(conversations)::BIGINT AS conversation_count, sum(tokens)::BIGINT AS total_tokens, round(sum(c), 10) AS total_cost, max(seen) AS last_seen FROM each GROUP BY 1 ORDER BY last_seen DESC, conversation_count DESC, git_remote LIMIT 3)
SELECT p.*, CAST(row_number() OVER (PARTITION BY git_remote ORDER BY tokens DESC, conversations DESC, adapter_id) - 1 AS INT) AS place, adapter_id, conversations, tokens, round(c, 10) AS cost FROM p JOIN each USING (git_remote)""")
def project_usage_by_harness(spark, sf):
    return U.harness_rows(U.projects_by_harness(lens.store(spark, sf).conversations, 3))


@query("SELECT relationship, count(*) AS conversations FROM conv GROUP BY 1")
def relationship_mix(spark, sf):
    return L.relationship_mix(lens.store(spark, sf).conversations)


@query("SELECT count(*) AS conversations FROM conv WHERE adapter_id = 'codex' AND activity >= '2024-01-10' AND relationship = 'spawned'")
def filtered_count(spark, sf):
    return L.count_conversations(lens.store(spark, sf).conversations, L.Filters(adapter="codex", since="2024-01-10", relationship="spawned"))


@query("SELECT DISTINCT git_remote FROM conv WHERE git_remote != '' AND adapter_id = 'amp'")
def distinct_repositories(spark, sf):
    return L.distinct_values(lens.store(spark, sf).conversations, "git_remote", L.Filters(adapter="amp"))


@query("SELECT DISTINCT adapter_id FROM conv WHERE adapter_id != ''")
def distinct_adapters(spark, sf):
    return L.distinct_values(lens.store(spark, sf).conversations, "adapter_id")


@query("SELECT id, adapter_id, started_at, ended_at FROM conv ORDER BY activity DESC, started_at DESC, id LIMIT 50")
def list_conversations(spark, sf):
    return L.list_conversations(lens.store(spark, sf).conversations, limit=50).select("id", "adapter_id", "started_at", "ended_at")


@query("SELECT id, adapter_id, started_at, ended_at FROM conv WHERE adapter_id = 'cursor' ORDER BY activity DESC, started_at DESC, id LIMIT 5 OFFSET 5")
def list_page_2(spark, sf):
    return L.list_conversations(lens.store(spark, sf).conversations, L.Filters(adapter="cursor"), 5, 5).select("id", "adapter_id", "started_at", "ended_at")


@query("""SELECT (SELECT count(*) FROM conv WHERE adapter_id = 'cursor') AS total_count, count(*) AS filtered_count, count(*) > 5 AS has_more, CASE WHEN count(*) > 5 THEN 5 END AS next_offset
FROM conv WHERE adapter_id = 'cursor' AND relationship = 'root'""")
def list_page_envelope(spark, sf):
    return L.page(lens.store(spark, sf).conversations, L.Filters(adapter="cursor", relationship="root"), 5, 0)


@query("""SELECT id, name FROM conv WHERE """ + " OR ".join(f"lower(coalesce({c}, '')) LIKE '%repo3%'" for c in L.SEARCHED))
def list_filtered_search(spark, sf):
    return L.list_conversations(lens.store(spark, sf).conversations, L.Filters(search=" Repo3 ")).select("id", "name")


@query("SELECT id FROM conv WHERE id = 'c1' OR lower(id) LIKE 'c1%' ORDER BY CASE WHEN id = 'c1' THEN 0 ELSE 1 END, activity DESC, id LIMIT 10")
def id_prefix_match(spark, sf):
    return L.match_id(lens.store(spark, sf).conversations, "C1".lower()).select("id")


@query("""SELECT id, name, adapter_id AS adapter, relationship IN ('spawned', 'forked') AS is_sub_agent, relationship = 'compacted' AS is_compacted, input_tokens + output_tokens AS total_tokens, message_count FROM conv""")
def session_shape(spark, sf):
    return L.session_shape(lens.store(spark, sf).conversations)


@query("SELECT id, parent_id, relationship, started_at FROM conv WHERE trace_id = 'c8'")
def trace_conversations(spark, sf):
    return G.trace(lens.store(spark, sf).conversations, "c8").select("id", "parent_id", "relationship", "started_at")


@query("""SELECT id, trace_id, CASE WHEN id = trace_id THEN 0 WHEN n % 4 = 3 THEN 2 ELSE 1 END AS depth FROM conv c
WHERE id = trace_id OR (n % 20 NOT IN (1, 3) AND EXISTS (SELECT 1 FROM conv p WHERE p.id = c.parent_id) AND EXISTS (SELECT 1 FROM conv r WHERE r.id = c.trace_id))""")
def conversation_tree(spark, sf):
    return G.trees(lens.bare_conversations(lens.messages(spark, sf))).select("id", "trace_id", "depth")


@query("""SELECT trace_id, id FROM (SELECT trace_id, c.id, row_number() OVER (PARTITION BY trace_id ORDER BY CASE WHEN relationship = 'root' THEN 0 WHEN parent_id = '' THEN 1 WHEN c.id = trace_id THEN 2 WHEN NOT EXISTS (SELECT 1 FROM conv p WHERE p.id = c.parent_id AND p.trace_id = c.trace_id) THEN 3 ELSE 4 END,
started_at, ended_at, c.id) AS k FROM conv c) WHERE k = 1""")
def tree_root(spark, sf):
    return G.roots(lens.bare_conversations(lens.messages(spark, sf)))


@query("SELECT trace_id, parent_id, id, CAST(row_number() OVER (PARTITION BY trace_id, parent_id ORDER BY started_at, ended_at, id) AS INT) AS place FROM conv WHERE parent_id != ''")
def tree_children(spark, sf):
    return G.children(lens.store(spark, sf).conversations)


@query("SELECT c.id, p.name AS parent_name FROM conv c LEFT JOIN conv p ON p.id = c.parent_id AND p.trace_id = c.trace_id")
def tree_parents(spark, sf):
    return G.parents(lens.store(spark, sf).conversations).select("id", "parent_name")


@query("""SELECT id, parent_id, adapter_id, relationship FROM conv c WHERE parent_id != '' AND NOT EXISTS (SELECT 1 FROM conv p WHERE p.id = c.parent_id)""")
def orphans(spark, sf):
    return G.orphans(lens.bare_conversations(lens.messages(spark, sf)))


@query(""", w AS (SELECT c.id, c.trace_id, coalesce(r2.id, r1.id, c.id) AS top FROM conv c LEFT JOIN conv r1 ON r1.id = c.parent_id LEFT JOIN conv r2 ON r2.id = r1.parent_id)
SELECT * FROM w WHERE top != trace_id""")
def trace_consistency(spark, sf):
    return G.trace_consistency(lens.bare_conversations(lens.messages(spark, sf)))


@query()
def trace_render_order(spark, sf):
    s = lens.store(spark, sf)
    return G.render_order(s.conversations, s.messages)


@query("SELECT id, conversation_id, role, sequence FROM msg")
def messages_ordered(spark, sf):
    return L.ordered_messages(lens.messages(spark, sf)).select("id", "conversation_id", "role", "sequence")


@query("SELECT m.id, count(t.id) AS tools, coalesce(string_agg(t.id, ',' ORDER BY t.id), '') AS tool_ids FROM msg m LEFT JOIN tool t ON t.conversation_id = m.conversation_id AND t.message_id = m.id GROUP BY 1")
def messages_with_tools(spark, sf):
    out = L.messages_with_tools(lens.messages(spark, sf), lens.tool_calls(spark, sf))
    ids = F.transform("tool_uses", lambda t: t["id"])
    return out.select("id", F.coalesce(F.size("tool_uses"), F.lit(0)).cast("long").alias("tools"), F.coalesce(F.array_join(ids, ","), F.lit("")).alias("tool_ids"))


@query("SELECT t.id, t.conversation_id, coalesce(m.sequence, 0) AS message_sequence FROM tool t LEFT JOIN msg m ON m.conversation_id = t.conversation_id AND m.id = t.message_id")
def tool_calls_ordered(spark, sf):
    return L.ordered_tool_calls(lens.tool_calls(spark, sf), lens.messages(spark, sf)).select("id", "conversation_id", "message_sequence")


@query("SELECT s.conversation_id, local_revision FROM sync s LEFT JOIN push p ON p.conversation_id = s.conversation_id AND p.sink_id = 'warehouse' WHERE coalesce(last_successful_revision, 0) < local_revision")
def needs_push(spark, sf):
    c = lens.bare_conversations(lens.messages(spark, sf))
    return Y.needs_push(lens.sync(c), lens.push_state(c), "warehouse")


@query("SELECT id FROM conv WHERE id NOT IN (SELECT conversation_id FROM sync)")
def missing_sync(spark, sf):
    c = lens.bare_conversations(lens.messages(spark, sf))
    return Y.missing_sync(c, lens.sync(c))


@query("""SELECT p.conversation_id, p.sink_id, CASE WHEN h THEN 9 ELSE last_attempted_revision END::BIGINT AS last_attempted_revision, CASE WHEN h AND ok THEN 9 ELSE last_successful_revision END::BIGINT AS last_successful_revision,
CASE WHEN h THEN 'now' ELSE last_attempted_at END AS last_attempted_at, CASE WHEN h AND ok THEN 'now' ELSE last_successful_at END AS last_successful_at, CASE WHEN h THEN CASE WHEN ok THEN '' ELSE 'refused' END ELSE last_error END AS last_error
FROM (SELECT p.*, sink_id = 'hook' AND n % 3 != 0 AS h, n % 3 = 1 AS ok FROM push p JOIN conv c ON c.id = p.conversation_id) p
UNION ALL SELECT id, 'hook', 9, CASE WHEN n % 3 = 1 THEN 9 ELSE 0 END, 'now', CASE WHEN n % 3 = 1 THEN 'now' ELSE '' END, CASE WHEN n % 3 = 1 THEN '' ELSE 'refused' END FROM conv WHERE n % 3 != 0 AND n % 5 != 0""")
def push_state_after(spark, sf):
    c = lens.bare_conversations(lens.messages(spark, sf))
    n = F.substring("id", 2, 20).cast("long")
    results = c.where(n % 3 != 0).select(F.col("id").alias("conversation_id"), F.lit("hook").alias("sink_id"), F.lit(9).cast("long").alias("revision"), (n % 3 == 1).alias("ok"), F.lit("refused").alias("error"))
    return Y.record_push(lens.push_state(c), results, "now")


@query("""SELECT (SELECT count(*) FROM push WHERE sink_id = 'hook') AS cleared_rows, (SELECT count(*) FROM sync s LEFT JOIN push p ON p.conversation_id = s.conversation_id AND p.sink_id = 'hook' WHERE coalesce(last_successful_revision, 0) < local_revision) AS dirty_before,
(SELECT count(*) FROM sync WHERE local_revision > 0) AS dirty_after""")
def repush_reset(spark, sf):
    c = lens.bare_conversations(lens.messages(spark, sf))
    return Y.reset_push(lens.sync(c), lens.push_state(c), "hook")[1]


@query("""SELECT coalesce(s.conversation_id, c.id) AS conversation_id, CASE WHEN n % 6 = 5 THEN content_hash WHEN n % 2 = 0 THEN 'h' || (n % 5) ELSE 'new' END AS content_hash,
CASE WHEN n % 6 = 5 THEN local_revision ELSE coalesce(local_revision, 0) + CASE WHEN n % 2 = 0 AND n % 13 != 0 THEN 0 ELSE 1 END END::BIGINT AS local_revision, CASE WHEN n % 6 = 5 THEN ingested_at ELSE 'now' END AS ingested_at,
n % 6 != 5 AND (n % 2 != 0 OR n % 13 = 0) AS changed FROM conv c LEFT JOIN sync s ON s.conversation_id = c.id WHERE n % 6 != 5 OR s.conversation_id IS NOT NULL""")
def revision_gate(spark, sf):
    c = lens.bare_conversations(lens.messages(spark, sf))
    n = F.substring("id", 2, 20).cast("long")
    new = c.where(n % 6 != 5).select(F.col("id").alias("conversation_id"), F.when(n % 2 == 0, F.concat(F.lit("h"), n % 5)).otherwise("new").alias("content_hash"))
    return Y.revise(lens.sync(c), new, "now")


_R1 = "(regexp_full_match(git_remote, 'github\\.com/acme/repo.*') AND regexp_full_match(adapter_id, 'c.*'))"
_R2 = "regexp_full_match(branch, 'feature/.*')"
_R3 = "(regexp_full_match(git_remote, 'github\\.com/acme/repo.') AND branch = 'main' AND adapter_id = 'amp')"
_SINKS = f"""CASE WHEN {_R1} AND {_R2} THEN 'warehouse,hook' WHEN {_R1} THEN 'warehouse' WHEN {_R2} THEN 'hook,warehouse' WHEN {_R3} THEN 'bucket' ELSE '' END"""


@query(f"SELECT id, {_SINKS} AS sinks FROM conv")
def routed_sinks(spark, sf):
    return P.routed(lens.bare_conversations(lens.messages(spark, sf)), ROUTES).select("id", F.array_join("sinks", ",").alias("sinks"))


@query(f""", r AS (SELECT git_remote, {_SINKS} AS s FROM conv WHERE git_remote != ''), x AS (SELECT git_remote, unnest(string_split(s, ',')) AS sink FROM r)
SELECT r.git_remote, count(*) AS conversations, count(*) FILTER (WHERE contains(s, 'hook') OR contains(s, 'warehouse')) AS routed, count(*) FILTER (WHERE NOT (contains(s, 'hook') OR contains(s, 'warehouse'))) AS unrouted,
count(*) FILTER (WHERE contains(s, 'warehouse')) AS to_warehouse, count(*) FILTER (WHERE contains(s, 'hook')) AS to_hook, any_value(y.sinks) AS sinks
FROM r JOIN (SELECT git_remote, coalesce(string_agg(DISTINCT sink, ',' ORDER BY sink) FILTER (WHERE sink IN ('hook', 'warehouse')), '') AS sinks FROM x GROUP BY 1) y USING (git_remote) GROUP BY 1""")
def routing_flow(spark, sf):
    return P.flow(lens.bare_conversations(lens.messages(spark, sf)), ROUTES, ["warehouse", "hook"])


@query("SELECT git_remote FROM conv WHERE git_remote != '' GROUP BY 1 HAVING bool_and(git_remote NOT LIKE '%repo2' AND git_remote NOT LIKE '%repo4')")
def unrouted_projects(spark, sf):
    return P.unrouted_projects(lens.bare_conversations(lens.messages(spark, sf)), [P.Route(("warehouse",), remote="*/repo2"), P.Route(("hook",), remote="github.com/acme/repo4", branch="*")])


_WORDS = r"""SELECT id, conversation_id, sequence, list_filter(regexp_split_to_array(lower(strip_accents(coalesce(content, ''))), '[^\p{L}\p{N}]+'), lambda w: w != '') AS w FROM msg"""


def _bm25_sql(hits: str, terms: dict[str, str], keep: str = "TRUE") -> str:
    """`terms`: a name and its count in the word list w."""
    cols = ", ".join(f"{tf} AS tf_{k}" for k, tf in terms.items())
    idf = lambda k: f"greatest(CASE WHEN ln((total - df_{k} + 0.5) / (df_{k} + 0.5)) > 0 THEN ln((total - df_{k} + 0.5) / (df_{k} + 0.5)) ELSE 1e-6 END, 1e-6)"
    rank = " ".join(f"- {idf(k)} * (tf_{k} * 2.2) / (tf_{k} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for k in terms)
    stats = ", ".join(f"count(*) FILTER (WHERE tf_{k} > 0)::DOUBLE AS df_{k}" for k in terms)
    return f""", w AS ({_WORDS}), c AS (SELECT *, len(w)::DOUBLE AS dl, {cols} FROM w), s AS (SELECT count(*)::DOUBLE AS total, avg(dl) AS avgdl, {stats} FROM c)
SELECT c.id AS message_id, c.conversation_id, sequence, round(0.0 {rank}, 6) AS rank FROM c, s JOIN conv v ON TRUE WHERE v.id = c.conversation_id AND {hits} AND {keep}"""


def _rounded(hits: DataFrame) -> DataFrame:
    return hits.withColumn("rank", F.round("rank", 6))


_TF = "len(list_filter(w, lambda x: {}))"


@query(_bm25_sql("tf_a > 0 AND tf_b > 0", {"a": _TF.format("x = 'the'"), "b": _TF.format("x = 'and'")}))
def search_bm25(spark, sf):
    m = lens.messages(spark, sf)
    return _rounded(FT.search(m, lens.bare_conversations(m), FT.Terms(all_of=("the", "and")), limit=None))


@query(_bm25_sql("tf_a > 0", {"a": _TF.format("starts_with(x, 'th')")}))
def search_prefix(spark, sf):
    m = lens.messages(spark, sf)
    return _rounded(FT.search(m, lens.bare_conversations(m), FT.Terms(all_of=("th*",)), limit=None))


_PHRASE = "len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the'))"


@query(_bm25_sql("tf_a > 0", {"a": _PHRASE}))
def search_phrase(spark, sf):
    m = lens.messages(spark, sf)
    return _rounded(FT.search(m, lens.bare_conversations(m), FT.Terms(all_of=("of the",)), limit=None))


@query(_bm25_sql("(tf_a > 0 OR tf_b > 0) AND len(list_filter(w, lambda x: x = 'is')) = 0", {"a": _TF.format("x = 'the'"), "b": _TF.format("x = 'de'")}, "adapter_id = 'codex' AND activity >= '2024-01-10'"))
def search_filtered(spark, sf):
    m = lens.messages(spark, sf)
    return _rounded(FT.search(m, lens.bare_conversations(m), FT.Terms(any_of=("the", "de"), none_of=("is",)), "codex", "2024-01-10", None))


@query()
def search_snippets(spark, sf):
    m = lens.messages(spark, sf)
    return FT.with_snippets(FT.search(m, lens.bare_conversations(m), FT.Terms(all_of=("the",))), m, FT.Terms(all_of=("the",)))


@query("SELECT id, turn FROM msg")
def turn_numbers(spark, sf):
    return lens.messages(spark, sf).select("id", "turn")


@query(""", x AS (SELECT *, sequence % 7 = 5 AS side FROM msg), y AS (SELECT *, sum(CASE WHEN NOT side AND role = 'user' THEN 1 ELSE 0 END) OVER w AS users, first_value(CASE WHEN NOT side AND role != 'system' THEN role END IGNORE NULLS) OVER w AS f
FROM x WINDOW w AS (PARTITION BY conversation_id ORDER BY sequence ROWS UNBOUNDED PRECEDING)) SELECT id, CAST(CASE WHEN side OR role = 'system' THEN -1 ELSE users + CASE WHEN f = 'assistant' THEN 1 ELSE 0 END END AS INT) AS turn FROM y""")
def sidechain_turns(spark, sf):
    return lens.messages(spark, sf).withColumn("turn", R.sidechain_turn(F.col("role"), F.col("is_sidechain"))).select("id", "turn")


@query("""SELECT conversation_id, arg_min(m, (-uses, m)) AS model, max(uses) AS uses FROM (SELECT 'c' || (conv_id % 20) AS conversation_id, model AS m, count(*) AS uses FROM msg WHERE model != '' GROUP BY 1, 2) GROUP BY 1""")
def primary_model(spark, sf):
    n = F.substring("conversation_id", 2, 20).cast("long")
    return R.primary_model(lens.messages(spark, sf).withColumn("conversation_id", F.concat(F.lit("c"), n % 20)))


@query("SELECT conversation_id, name FROM names WHERE name != ''")
def conversation_name(spark, sf):
    return R.conversation_names(lens.messages(spark, sf))


@query(""", x AS (SELECT *, row_number() OVER (PARTITION BY conversation_id, cache_read, cache_write % 3, role ORDER BY sequence) > 1 AND role = 'assistant' AS is_replay FROM msg)
SELECT id, is_replay, CASE WHEN is_replay THEN 0 ELSE output_tokens END AS output_tokens FROM x""")
def first_occurrence_dedup(spark, sf):
    rows = lens.messages(spark, sf).withColumn("key", F.col("cache_write") % 3)
    return R.dedup_usage(rows.withColumn("read", F.col("cache_read")), ["read", "key"]).select("id", "is_replay", "output_tokens")


@query(""", x AS (SELECT *, row_number() OVER (PARTITION BY conversation_id, role ORDER BY sequence) AS k FROM msg)
SELECT id, CAST(k AS INT) AS occurrence, substr(sha256(conversation_id || chr(31) || role || chr(31) || k), 1, 24) AS stable_id FROM x""")
def nth_occurrence_id(spark, sf):
    return R.occurrence_ids(lens.messages(spark, sf), "conversation_id", "role", "sequence").select("id", "occurrence", "stable_id")


@query(""", x AS (SELECT *, 'u' || (sequence % 3) AS uuid, 'u' || ((sequence + 1) % 3) AS up FROM msg)
SELECT x.id, (SELECT arg_max(y.id, y.sequence) FROM x y WHERE y.conversation_id = x.conversation_id AND y.uuid = x.up AND y.sequence < x.sequence) AS parent_value FROM x""")
def parent_message(spark, sf):
    rows = lens.messages(spark, sf).withColumns({"uuid": F.concat(F.lit("u"), F.col("sequence") % 3), "up": F.concat(F.lit("u"), (F.col("sequence") + 1) % 3)})
    return R.latest_before(rows, "conversation_id", "uuid", "up", "sequence", "id").select("id", "parent_value")


@query("""SELECT id, lag(id) OVER (PARTITION BY conversation_id ORDER BY sequence) AS previous FROM msg""")
def previous_message(spark, sf):
    w = Window.partitionBy("conversation_id").orderBy("sequence")
    return lens.messages(spark, sf).select("id", F.lag("id").over(w).alias("previous"))


@query(""", x AS (SELECT id, conversation_id, CAST(sum(CASE WHEN sequence > 0 AND sequence % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conversation_id ORDER BY sequence ROWS UNBOUNDED PRECEDING) AS INT) AS segment FROM msg)
SELECT id, segment, CASE WHEN segment = 0 THEN conversation_id ELSE conversation_id || '#' || segment END AS segment_id,
CASE segment WHEN 0 THEN '' WHEN 1 THEN conversation_id ELSE conversation_id || '#' || (segment - 1) END AS parent_segment_id, CASE WHEN segment = 0 THEN 'root' ELSE 'compacted' END AS relationship FROM x""")
def segments(spark, sf):
    out = R.segments(lens.messages(spark, sf), "conversation_id", "sequence", (F.col("sequence") > 0) & (F.col("sequence") % 3 == 0))
    return out.select("id", "segment", "segment_id", "parent_segment_id", "relationship")


_DAILY = "day AS (SELECT substr(activity, 1, 10) AS day, adapter_id, count(*) AS sessions, sum(tokens)::BIGINT AS tokens, round(sum(est_cost), 10) AS cost FROM conv GROUP BY 1, 2)"


@query(f""", {_DAILY} SELECT day, """ + ", ".join(f"coalesce(sum(tokens) FILTER (WHERE adapter_id = '{a}'), 0)::BIGINT AS {a.replace('-', '_')}" for a in lens.ADAPTERS) + " FROM day GROUP BY 1")
def usage_pivot(spark, sf):
    return U.usage_pivot(U.daily_usage(U.timeline_by_day(lens.store(spark, sf).conversations)), list(lens.ADAPTERS))


@query(f""", {_DAILY} SELECT * FROM day WHERE day IN (SELECT DISTINCT day FROM day ORDER BY day DESC LIMIT 14 OFFSET 14)""")
def usage_window_daily(spark, sf):
    return U.last_buckets(U.daily_usage(U.timeline_by_day(lens.store(spark, sf).conversations)), "day", 14, 1)


@query(""", week AS (SELECT strftime(date_trunc('week', CAST(substr(activity, 1, 10) AS DATE)), '%Y-%m-%d') AS week_start, adapter_id, count(*) AS sessions FROM conv GROUP BY 1, 2)
SELECT * FROM week WHERE week_start IN (SELECT DISTINCT week_start FROM week ORDER BY 1 DESC LIMIT 4)""")
def usage_window_weekly(spark, sf):
    return U.last_buckets(U.timeline_by_week(lens.store(spark, sf).conversations), "week_start", 4).select("week_start", "adapter_id", "sessions")


@query(f""", {_DAILY} SELECT adapter_id, sum(tokens)::BIGINT AS tokens, sum(sessions)::BIGINT AS sessions, round(sum(cost), 10) AS cost FROM day GROUP BY 1""")
def adapter_rank(spark, sf):
    return U.adapter_rank(U.daily_usage(U.timeline_by_day(lens.store(spark, sf).conversations)))


@query(f""", {_DAILY}, k AS (SELECT adapter_id, sum(sessions)::BIGINT AS sessions FROM day WHERE day IN (SELECT DISTINCT day FROM day ORDER BY day DESC LIMIT 14) GROUP BY 1)
SELECT adapter_id, sessions, round(sessions / (SELECT sum(sessions) FROM k), 6) AS share FROM k""")
def adapter_mix(spark, sf):
    return U.adapter_mix(U.daily_usage(U.timeline_by_day(lens.store(spark, sf).conversations)))


@query("SELECT role, count(*) AS messages FROM msg GROUP BY 1")
def messages_by_role(spark, sf):
    return U.by_role(lens.messages(spark, sf))


@query(""", x AS (SELECT t.conversation_id, name, min((coalesce(m.sequence, 0), t.id)) AS pos FROM tool t LEFT JOIN msg m ON m.conversation_id = t.conversation_id AND m.id = t.message_id GROUP BY 1, 2),
y AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY pos, name) AS k FROM x) SELECT conversation_id, string_agg(name, ',' ORDER BY k) AS tools FROM y WHERE k <= 3 GROUP BY 1""")
def tool_preview(spark, sf):
    return U.tool_preview(lens.tool_calls(spark, sf), lens.messages(spark, sf))


@query("SELECT t.conversation_id, m.turn, count(*) AS calls FROM tool t JOIN msg m ON m.conversation_id = t.conversation_id AND m.id = t.message_id WHERE m.role = 'assistant' GROUP BY 1, 2 HAVING count(*) >= 3")
def agentic_loops(spark, sf):
    return U.agentic_loops(lens.messages(spark, sf), lens.tool_calls(spark, sf))


@query("SELECT id, adapter_id FROM conv WHERE id IN (SELECT conversation_id FROM tool WHERE name = 'purchase')")
def used_tool(spark, sf):
    return U.used_tool(lens.store(spark, sf).conversations, lens.tool_calls(spark, sf), "purchase")


@query("SELECT cwd, count(*) AS conversations, round(sum(est_cost), 10) AS cost FROM conv GROUP BY 1")
def cost_by_user(spark, sf):
    return U.cost_by(lens.store(spark, sf).conversations, "cwd")


_URL = "CASE page_id % 4 WHEN 0 THEN 'https://User@' || substr(url, strpos(url, '://') + 3) || '.GIT' WHEN 1 THEN 'git@host' || page_id || '.org:team/Repo.git/' WHEN 2 THEN ' ssh://git@host.org/a/b// ' ELSE url END"


@query(rf""", u AS (SELECT page_id, {_URL} AS raw FROM pages), v AS (SELECT page_id, raw, regexp_replace(regexp_replace(regexp_replace(trim(raw), '^[a-zA-Z][a-zA-Z0-9+.-]*://', ''), '^[^@]+@([^:]+):', '\1/'), '^[^/]+@([^/]+/)', '\1') AS x FROM u)
SELECT page_id, raw, regexp_replace(regexp_replace(regexp_replace(lower(x), '/+$', ''), '\.git$', ''), '/+$', '') AS remote FROM v""")
def normalize_remote(spark, sf):
    spark.read.parquet(f"{sf}/pages.parquet").createOrReplaceTempView("_pages")
    rows = spark.sql(f"SELECT page_id, {_URL.replace('strpos(url, ', 'instr(url, ')} AS raw FROM _pages")
    return rows.withColumn("remote", S.normalize_remote(F.col("raw")))


@query("SELECT id, regexp_full_match(name, '.*th.e.*') AS hit FROM conv")
def glob_match(spark, sf):
    return lens.bare_conversations(lens.messages(spark, sf)).select("id", F.col("name").rlike(S.glob_regex("*th?e*")).alias("hit"))


_NAMES = "model || CASE n % 3 WHEN 0 THEN '-4-5' WHEN 1 THEN '/x' ELSE '' END"


@query(f"SELECT id, {lens.tier_sql(_NAMES)} AS tier, {lens.family_sql(_NAMES)} AS family FROM conv")
def model_tier(spark, sf):
    n = F.substring("id", 2, 20).cast("long")
    name = F.concat("model", F.when(n % 3 == 0, "-4-5").when(n % 3 == 1, "/x").otherwise(""))
    return lens.bare_conversations(lens.messages(spark, sf)).select("id", S.model_tier(name).alias("tier"), S.model_family(name).alias("family"))


@query("SELECT id, substr(sha256(cwd), 1, 12) AS project_id, string_split(cwd, '/')[-1] AS project FROM conv")
def project_id_hash(spark, sf):
    c = lens.bare_conversations(lens.messages(spark, sf))
    return c.select("id", S.project_id(F.concat("cwd", F.lit("//"))).alias("project_id"), S.project_name(F.col("cwd")).alias("project"))


@query("SELECT id, substr(sha256(id || chr(31) || adapter_id), 1, 24) AS stable, sha1(id || '␟' || adapter_id) AS stable_sha1 FROM conv")
def stable_id(spark, sf):
    c = lens.bare_conversations(lens.messages(spark, sf))
    return c.select("id", S.stable_id(F.col("id"), F.col("adapter_id")).alias("stable"), S.stable_id_sha1(F.col("id"), F.col("adapter_id")).alias("stable_sha1"))


@query("SELECT conversation_id, name AS tool, count(*) AS calls, sum(length(input))::BIGINT AS input_chars, sum(length(output))::BIGINT AS output_chars FROM tool GROUP BY 1, 2")
def v1_tool_chars(spark, sf):
    return V1.tool_chars(lens.tool_calls(spark, sf))


_LANGUAGES = """ends AS (SELECT conversation_id, regexp_extract(input, '/src/a[0-9][.](py|ts|rs) ', 1) AS e, count(*) AS k FROM tool WHERE regexp_matches(input, '/src/a[0-9][.](py|ts|rs) ') GROUP BY 1, 2),
lang AS (SELECT conversation_id, CASE arg_min(e, (-k, e)) WHEN 'py' THEN 'Python' WHEN 'ts' THEN 'TypeScript' ELSE 'Rust' END AS language FROM ends GROUP BY 1)"""


@query(f", {_LANGUAGES} SELECT * FROM lang")
def v1_language(spark, sf):
    return V1.languages(lens.tool_calls(spark, sf))


_TAGS = f"""{_LANGUAGES}, tags AS (SELECT conversation_id, language AS tag, 'language' AS category FROM lang UNION SELECT id AS conversation_id, string_split(cwd, '/')[-1] AS tag, 'project' AS category FROM conv UNION SELECT id, adapter_id, 'tool' FROM conv
UNION SELECT conversation_id, {lens.family_sql('model')}, 'model' FROM msg WHERE model != '' UNION SELECT id, 'sub-agent', 'status' FROM conv WHERE relationship IN ('spawned', 'forked')
UNION SELECT id, 'compacted', 'status' FROM conv WHERE relationship = 'compacted' UNION SELECT id, 'high-cost', 'status' FROM conv WHERE est_cost > 1.0)"""


def _tags(spark, sf):
    s = lens.store(spark, sf)
    return s, V1.tags(s.conversations, s.messages, s.tool_calls)


@query(f", {_TAGS} SELECT * FROM tags")
def v1_tags(spark, sf):
    return _tags(spark, sf)[1]


@query(f", {_TAGS} SELECT category, tag, count(DISTINCT conversation_id) AS sessions FROM tags GROUP BY 1, 2")
def v1_tag_counts(spark, sf):
    return V1.tag_counts(_tags(spark, sf)[1])


@query(f", {_TAGS} SELECT c.id, adapter_id, string_split(cwd, '/')[-1] AS project, message_count, coalesce((SELECT string_agg(DISTINCT tag, ',' ORDER BY tag) FROM tags t WHERE t.conversation_id = c.id), '') AS tags FROM conv c")
def v1_enriched_sessions(spark, sf):
    s, rows = _tags(spark, sf)
    return V1.enriched(s.conversations, rows)


_BYTES = lambda names, fixed: " + ".join([str(fixed), *(f"coalesce(octet_length(encode({n})), 0)" for n in names)])
_LENS_MESSAGE, _LENS_CALL = ("id", "role", "content", "role", "model", "CASE WHEN sequence > 0 THEN 'm' || conv_id || '-' || (sequence - 1) ELSE '' END", "timestamp"), ("id", "name", "input", "output")


@query(f""", calls AS (SELECT conversation_id, message_id, sum({_BYTES(_LENS_CALL, K.CALL_BYTES)}) AS more FROM tool GROUP BY 1, 2),
each AS (SELECT m.conversation_id, b + coalesce(more, 0) AS b FROM (SELECT *, {_BYTES(_LENS_MESSAGE, K.MESSAGE_BYTES)} AS b FROM msg) m LEFT JOIN calls c ON c.conversation_id = m.conversation_id AND c.message_id = m.id),
sizes AS (SELECT conversation_id, sum(b)::BIGINT AS m, max(b)::BIGINT AS most FROM each GROUP BY 1)
SELECT id, ({_BYTES(K.CONVERSATION_TEXTS, K.CONVERSATION_BYTES)})::BIGINT AS bytes, m AS message_bytes, most AS largest_message FROM conv JOIN sizes ON conversation_id = id""")
def size_estimates(spark, sf):
    m = lens.messages(spark, sf)
    return K.conversation_bytes(lens.bare_conversations(m), m, lens.tool_calls(spark, sf))


@query("""SELECT conversation_id, count(*) AS steps_back FROM (SELECT conversation_id, lag(sequence) OVER (PARTITION BY conversation_id ORDER BY (sequence * 7) % 11, id) > sequence AS back FROM msg) WHERE back GROUP BY 1""")
def sequence_disorder(spark, sf):
    return K.out_of_order(lens.messages(spark, sf).withColumn("arrival", (F.col("sequence") * 7) % 11), "arrival")


_SIGNED = "SELECT adapter_id AS source_path, id AS ref_id, 's' || (n % 10) AS signature"


def _signatures(spark, sf):
    c = lens.bare_conversations(lens.messages(spark, sf)).withColumn("n", F.substring("id", 2, 20).cast("long"))
    row = [F.col("adapter_id").alias("source_path"), F.col("id").alias("ref_id")]
    known = c.where("n % 7 != 0").select(*row, F.concat(F.lit("s"), F.col("n") % 10).alias("signature"))
    found = c.where("n % 7 != 1 AND adapter_id != 'amp'").select(*row, F.concat(F.lit("s"), F.when(F.col("n") % 3 == 0, 99).otherwise(F.col("n") % 10)).alias("signature"))
    return K.changed_signatures(known, found)


@query("SELECT adapter_id AS source_path, id AS ref_id FROM conv WHERE n % 7 != 1 AND adapter_id != 'amp' AND (n % 7 = 0 OR n % 3 = 0)")
def changed_signatures(spark, sf):
    return _signatures(spark, sf)[0]


@query("""SELECT adapter_id AS source_path, id AS ref_id, CASE WHEN adapter_id != 'amp' AND n % 3 = 0 THEN 's99' ELSE 's' || (n % 10) END AS signature FROM conv WHERE CASE WHEN adapter_id = 'amp' THEN n % 7 != 0 ELSE n % 7 != 1 END""")
def signature_state(spark, sf):
    return _signatures(spark, sf)[1]


@query("SELECT adapter_id, string_agg(DISTINCT p, ',' ORDER BY p) AS paths FROM (SELECT adapter_id, source_path AS p FROM conv UNION ALL SELECT adapter_id, cwd FROM conv) GROUP BY 1")
def merged_hints(spark, sf):
    c = lens.bare_conversations(lens.messages(spark, sf))
    return K.merged_hints(c.select("adapter_id", F.array("source_path", "cwd").alias("paths"))).select("adapter_id", F.array_join("paths", ",").alias("paths"))


@query("""SELECT adapter_id, count(*) FILTER (WHERE n % 5 IN (3, 4)) AS cached, count(*) FILTER (WHERE n % 5 IN (1, 2)) AS invalidated, count(*) FILTER (WHERE n % 5 = 0) AS fresh FROM (SELECT n, adapter_id FROM conv) GROUP BY 1""")
def discovery_status(spark, sf):
    c = lens.bare_conversations(lens.messages(spark, sf)).withColumn("n", F.substring("id", 2, 20).cast("long"))
    row = ["adapter_id", F.col("source_path").alias("path"), F.lit(10).cast("long").alias("size")]
    known = c.where("n % 5 != 0").select(*row, F.lit(1).alias("mtime"))
    return K.discovery_status(known, c.where("n % 5 != 1").select(*row, F.when(F.col("n") % 5 == 2, 2).otherwise(1).alias("mtime")))


@query(f""", w AS ({_WORDS}), each AS (SELECT conversation_id, id, sequence, len(w) AS dl, unnest(w) AS word FROM w WHERE CAST(substr(conversation_id, 2) AS BIGINT) % 9 != 4)
SELECT word, conversation_id, id, sequence, count(*) AS tf, dl::INT AS dl FROM each GROUP BY ALL""")
def postings_refresh(spark, sf):
    """An index of the first four messages each, made whole again for two thirds of the conversations, the others having been new or lost."""
    m, n = lens.messages(spark, sf), F.substring("conversation_id", 2, 20).cast("long")
    index = K.postings(m.where((n % 3 == 0) | (F.col("sequence") < 4)).where(n % 9 != 1))
    changed = m.where((n % 3 != 0) | (n % 9 == 1)).select("conversation_id")
    return K.refreshed_postings(index, m.where(n % 9 != 4), changed)


@query(f", {_TAGS} SELECT conversation_id, category, tag FROM tags WHERE conversation_id IN ('c3', 'c8')")
def v1_session_tags(spark, sf):
    return V1.session_tags(_tags(spark, sf)[1], ["c3", "c8"])


@query("SELECT string_split(cwd, '/')[-1] AS project, adapter_id, count(*) AS sessions, round(sum(est_cost), 10) AS cost FROM conv GROUP BY 1, 2")
def v1_cost_by_project_tool(spark, sf):
    return V1.cost_by_project_and_tool(lens.store(spark, sf).conversations)


@query("SELECT substr(sha256(cwd), 1, 12) AS project_id, string_split(cwd, '/')[-1] AS project, count(*) AS sessions, sum(message_count)::BIGINT AS messages, round(sum(est_cost), 10) AS cost, max(activity) AS last_seen FROM conv GROUP BY 1, 2")
def v1_projects(spark, sf):
    return V1.projects(lens.store(spark, sf).conversations)


_PUSHES = "pushes AS (SELECT conversation_id, sink_id, last_attempted_at AS pushed_at FROM push)"


@query(f", {_PUSHES} SELECT conversation_id FROM sync WHERE conversation_id NOT IN (SELECT conversation_id FROM pushes)")
def v1_unpushed(spark, sf):
    c = lens.bare_conversations(lens.messages(spark, sf))
    return V1.never_pushed(lens.sync(c), lens.push_state(c).withColumnRenamed("last_attempted_at", "pushed_at"))


@query(f", {_PUSHES} SELECT conversation_id FROM sync s WHERE NOT EXISTS (SELECT 1 FROM pushes p WHERE p.conversation_id = s.conversation_id AND p.sink_id = 'warehouse' AND p.pushed_at >= s.ingested_at)")
def v1_needing_push(spark, sf):
    c = lens.bare_conversations(lens.messages(spark, sf))
    return V1.changed_since_push(lens.sync(c), lens.push_state(c).withColumnRenamed("last_attempted_at", "pushed_at"), "warehouse")


@query("SELECT id FROM conv WHERE id = 'c8' OR parent_id = 'c8'")
def v1_family(spark, sf):
    return V1.family_of(lens.bare_conversations(lens.messages(spark, sf)), "c8").select("id")


@query("""SELECT source_path AS path, CASE WHEN n % 5 = 0 THEN 'fresh' WHEN n % 5 = 1 THEN 'removed' ELSE 'changed' END AS change FROM conv WHERE n % 5 IN (0, 1, 2)""")
def source_diff(spark, sf):
    c = lens.bare_conversations(lens.messages(spark, sf)).withColumn("n", F.substring("id", 2, 20).cast("long"))
    known = c.where("n % 5 != 0").select(F.col("source_path").alias("path"), F.lit(10).cast("long").alias("size"), F.lit(1).cast("long").alias("mtime"))
    listed = c.where("n % 5 != 1").select(F.col("source_path").alias("path"), F.lit(10).cast("long").alias("size"), F.when(F.col("n") % 5 == 2, 2).otherwise(1).cast("long").alias("mtime"))
    return Y.source_diff(known, listed)


@query(""", blob AS (SELECT conversation_id, id, sequence, max(sequence) OVER (PARTITION BY conversation_id) AS last, CASE WHEN sequence % 6 != 0 AND role != 'system' THEN lag(id) OVER (PARTITION BY conversation_id ORDER BY sequence) END AS up FROM msg),
walk AS (
  SELECT conversation_id, id, up, sequence // 6 AS page, sequence AS entry, sequence FROM blob WHERE sequence % 6 = 5 OR sequence = last
  UNION ALL SELECT w.conversation_id, b.id, b.up, w.page, w.entry, b.sequence FROM walk w JOIN blob b ON b.id = w.up
), met AS (SELECT id, conversation_id, min((page, sequence)) AS first FROM walk GROUP BY 1, 2)
SELECT conversation_id, id, CAST(row_number() OVER (PARTITION BY conversation_id ORDER BY first) AS INT) AS place FROM met""")
def chat_order(spark, sf):
    """Messages as blobs: chains of parents in pages of six, broken above a system message, and raw pages that name the last message of each."""
    w = Window.partitionBy("conversation_id").orderBy("sequence")
    m = lens.messages(spark, sf).withColumns({"last": F.max("sequence").over(Window.partitionBy("conversation_id")), "before": F.lag("id").over(w)})
    key, page = lambda c: F.sha2(c, 256), (F.col("sequence") / 6).cast("int")
    linked = (F.col("sequence") % 6 != 0) & (F.col("role") != "system")
    up = F.when(linked, key(F.col("before"))).otherwise(F.sha2(F.concat(F.lit("lost"), "id"), 256))
    rows = m.select(F.col("conversation_id").alias("path"), key(F.col("id")).alias("id"), F.to_json(F.struct("role", up.alias("parentId"))).alias("raw"), F.lit(None).cast("string").alias("data"))
    names = m.where("sequence % 6 = 5 OR sequence = last").select(F.col("conversation_id").alias("path"), page.alias("page"), F.concat(F.lit("0a20"), key(F.col("id"))).alias("ref"))
    pages = names.groupBy("path", "page").agg(F.concat(F.lit("0820"), F.max("ref"), F.lit("1220"), F.repeat(F.lit("0"), 70)).alias("data"))
    top = pages.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", F.sha2("data", 256).alias("id")))), lambda x: F.concat(F.lit("0a20"), x["id"])), "").alias("data"))
    raw = lambda df: df.select("path", F.sha2("data", 256).alias("id"), F.lit(None).cast("string").alias("raw"), "data")
    found = C.read_order(rows.unionByName(raw(pages)).unionByName(raw(top)), top.select("path", F.sha2("data", 256).alias("node")))
    named = m.select("conversation_id", F.col("id").alias("message_id"), key(F.col("id")).alias("key"))
    return found.join(named, (F.col("path") == F.col("conversation_id")) & (F.col("id") == F.col("key"))).select("conversation_id", F.col("message_id").alias("id"), "place")


ORACLE["chat_order"] = ORACLE["chat_order"].replace("WITH msg0", "WITH RECURSIVE msg0", 1)
_EVENTS = """SELECT 'c' || (user_id % 100) AS conversation_id, CAST(event_id % 8 AS INT) AS place, CAST(event_id AS INT) AS ord, CASE WHEN event_id % 3 = 2 THEN 'result' ELSE 'call' END AS kind,
  CASE WHEN event_id % 4 = 0 THEN '' ELSE 'i' || (event_id % 50) END AS call_id, CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type END AS name, 'v' || event_id AS output, event_type = 'error' AS is_error FROM events"""


@query(f""", ev AS ({_EVENTS}),
claim AS (SELECT r.conversation_id, r.place, r.ord, any_value(r.output) AS output, any_value(r.is_error) AS is_error,
  arg_max((c.place, c.ord), (c.place = r.place, CASE WHEN r.call_id != '' AND c.call_id = r.call_id THEN 2 WHEN r.name != '' AND c.name = r.name THEN 1 ELSE 0 END, c.place, c.ord)) AS own
  FROM ev r JOIN ev c ON c.conversation_id = r.conversation_id AND c.kind = 'call' AND (c.place, c.ord) < (r.place, r.ord) WHERE r.kind = 'result' GROUP BY 1, 2, 3),
took AS (SELECT conversation_id, own, arg_max(output, (place, ord)) AS output, bool_or(is_error) AS is_error FROM claim GROUP BY 1, 2)
SELECT e.conversation_id, e.place, e.ord, e.call_id, e.name, coalesce(t.output, '') AS output, coalesce(t.is_error, FALSE) AS is_error FROM ev e LEFT JOIN took t ON t.conversation_id = e.conversation_id AND t.own = (e.place, e.ord) WHERE e.kind = 'call'""")
def tool_results_matched(spark, sf):
    """Events as calls and results whose ids repeat, are missing, or belong to calls of other messages."""
    e = F.col("event_id")
    events = spark.read.parquet(f"{sf}/events.parquet").select(
        F.concat(F.lit("c"), F.col("user_id") % 100).alias("conversation_id"), (e % 8).cast("int").alias("place"), e.cast("int").alias("ord"), F.when(e % 3 == 2, "result").otherwise("call").alias("kind"),
        F.when(e % 4 == 0, "").otherwise(F.concat(F.lit("i"), e % 50)).alias("call_id"), F.when(e % 5 == 0, "").otherwise(F.col("event_type")).alias("name"), F.concat(F.lit("v"), e).alias("output"), (F.col("event_type") == "error").alias("is_error"),
    )
    return MT.answered(events).select("conversation_id", "place", "ord", "call_id", "name", "output", "is_error")


@query()
def bundle_hash(spark, sf):
    s = lens.store(spark, sf)
    return Y.bundle_hash(s.conversations, s.messages, s.tool_calls)


@query("SELECT o_orderpriority, count(DISTINCT o_orderkey) AS conversations, count(*) AS messages, sum(l_quantity)::BIGINT AS tokens FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def scale_usage(spark, sf):
    """The rollup's shape over the largest tables: messages are aggregated before they meet their conversations."""
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_orderkey").agg(F.count("*").alias("messages"), F.sum("l_quantity").alias("tokens"))
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_orderpriority")
    out = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderpriority")
    return out.agg(F.countDistinct("o_orderkey").alias("conversations"), F.sum("messages").alias("messages"), F.sum("tokens").cast("long").alias("tokens"))
