"""A conversation store made of the plain tables, for the registered queries, and the same in DuckDB SQL.

`conversations` gives the messages, `events` the tool calls; the other columns are whole-number functions
of the ids, so that both engines agree to the last digit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..model import Store
from ..operators.rollup import conversation_rollup, running_turn

ADAPTERS = ("claude-code", "codex", "cursor", "gemini-cli", "amp")
MODELS = ("claude-opus-4-1", "claude-sonnet-4", "claude-3-5-haiku", "gpt-4o", "gemini-1.5-pro", "o3-mini")
KINDS = ("root", "spawned", "compacted", "forked")
ENDINGS = (".py", ".ts", ".rs", ".txt")
AS_OF = "2024-03-05"


def _pick(values: tuple[str, ...], number: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (number + 1).cast("int"))


def _stamp(conv: Column, minute: Column) -> Column:
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (conv % 60).cast("int")), "yyyy-MM-dd")
    pad = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat(day, F.lit("T"), pad(conv % 24), F.lit(":"), pad(minute % 60), F.lit(":00.000Z"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("cid", F.col("conv_id"))
    n, conv, assistant = F.length("text"), F.col("cid"), F.col("role") == "assistant"
    some = F.ceil(n / F.lit(4.0)).cast("long")
    zero = F.lit(0).cast("long")
    out = rows.select(
        F.concat(F.lit("m"), conv, F.lit("-"), F.col("turn")).alias("id"),
        F.concat(F.lit("c"), conv).alias("conversation_id"),
        "role",
        F.col("text").alias("content"),
        F.col("role").alias("record_type"),
        F.when(assistant, _pick(MODELS, conv % 6)).otherwise("").alias("model"),
        F.col("turn").cast("int").alias("sequence"),
        (F.col("turn") % 7 == 5).alias("is_sidechain"),
        F.when(F.col("turn") > 0, F.concat(F.lit("m"), conv, F.lit("-"), F.col("turn") - 1)).otherwise("").alias("parent_message_id"),
        F.when(assistant, zero).otherwise(some).alias("input_tokens"),
        F.when(assistant, some).otherwise(zero).alias("output_tokens"),
        (n % 97).cast("long").alias("cache_read"),
        (n % 31).cast("long").alias("cache_write"),
        F.lit("").alias("thinking_content"),
        zero.alias("thinking_tokens"),
        _stamp(conv, F.col("turn")).alias("timestamp"),
    )
    return out.withColumn("turn", running_turn(F.col("role")))


def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    conv, e = F.col("user_id") % 100, F.col("event_id")
    return rows.select(
        F.concat(F.lit("t"), e).alias("id"),
        F.concat(F.lit("c"), conv).alias("conversation_id"),
        F.concat(F.lit("m"), conv, F.lit("-"), e % 8).alias("message_id"),
        F.col("event_type").alias("name"),
        F.concat(F.coalesce("props", F.lit("")), F.lit(" /src/a"), e % 9, _pick(ENDINGS, e % 4), F.lit(" ")).alias("input"),
        F.concat(F.lit("v"), e % 1000).alias("output"),
        (F.col("event_type") == "error").alias("is_error"),
        (e % 5000 - 1).cast("long").alias("duration_ms"),
    )


def bare_conversations(found: DataFrame) -> DataFrame:
    """Conversations as adapters give them, of the messages `found`."""
    conv = F.col("n")
    root = conv - conv % 4
    base = found.groupBy("conversation_id").agg(F.max("sequence").alias("last")).withColumn("n", F.substring("conversation_id", 2, 20).cast("long"))
    names = found.where("role = 'user'").groupBy("conversation_id").agg(F.min_by(S.first_line_name(F.col("content")), "sequence").alias("name"))
    rows = base.join(names, "conversation_id", "left")
    parent = F.when(conv % 28 == 0, F.concat(F.lit("lost"), conv)).when(conv % 20 == 1, F.concat(F.lit("gone"), conv)).when(conv % 4 == 0, "").when(conv % 4 == 3, F.concat(F.lit("c"), root + 1)).otherwise(F.concat(F.lit("c"), root))
    return rows.select(
        F.col("conversation_id").alias("id"),
        F.concat(F.lit("c"), root).alias("trace_id"),
        parent.alias("parent_id"),
        F.when(conv % 28 == 0, "forked").otherwise(_pick(KINDS, conv % 4)).alias("relationship"),
        F.when(conv % 4 == 1, 1).otherwise(-1).alias("fork_point"),
        _pick(ADAPTERS, conv % 5).alias("adapter_id"),
        F.coalesce("name", F.lit("")).alias("name"),
        F.concat(F.lit("/home/dev/p"), conv % 7).alias("cwd"),
        F.when(conv % 7 == 0, "").otherwise(F.concat(F.lit("github.com/acme/repo"), conv % 7)).alias("git_remote"),
        F.when(conv % 2 == 0, "main").otherwise(F.concat(F.lit("feature/x"), conv % 3)).alias("branch"),
        _pick(MODELS, conv % 6).alias("model"),
        _stamp(conv, F.lit(0)).alias("started_at"),
        F.when(conv % 11 == 0, "").otherwise(_stamp(conv, F.col("last"))).alias("ended_at"),
        F.concat(F.lit("/data/c"), conv, F.lit(".jsonl")).alias("source_path"),
        F.lit("jsonl").alias("source_format"),
    )


def store(spark: SparkSession, sf_dir: str) -> Store:
    m, t = messages(spark, sf_dir), tool_calls(spark, sf_dir)
    return Store(conversation_rollup(bare_conversations(m), m, t), m, t)


def sync(conversations: DataFrame) -> DataFrame:
    """A revision for most conversations; some were never synchronised."""
    n = F.substring("id", 2, 20).cast("long")
    rows = conversations.where(n % 13 != 0)
    return rows.select(
        F.col("id").alias("conversation_id"), F.concat(F.lit("h"), n % 5).alias("content_hash"), (n % 4 + 1).cast("long").alias("local_revision"), F.concat(F.lit("2024-02-"), F.lpad((n % 28 + 1).cast("string"), 2, "0")).alias("ingested_at")
    )


def push_state(conversations: DataFrame) -> DataFrame:
    n = F.substring("id", 2, 20).cast("long")
    one = lambda sink, keep: conversations.where(keep).select(
        F.col("id").alias("conversation_id"),
        F.lit(sink).alias("sink_id"),
        (n % 3 + 1).cast("long").alias("last_attempted_revision"),
        (n % 3).cast("long").alias("last_successful_revision"),
        F.lit("2024-02-10").alias("last_attempted_at"),
        F.when(n % 3 == 0, "").otherwise("2024-02-09").alias("last_successful_at"),
        F.when(n % 2 == 0, "").otherwise("timeout").alias("last_error"),
    )
    return one("warehouse", n % 2 == 0).union(one("hook", n % 5 == 0))


def _case(values: tuple[str, ...], number: str) -> str:
    return f"CASE {number} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def tier_sql(model: str) -> str:
    def holds(groups: tuple) -> str:
        return " AND ".join("(" + " OR ".join(f"contains(lower({model}), '{p}')" for p in g) + ")" for g in groups)

    return "CASE " + " ".join(f"WHEN {holds(groups)} THEN '{name}'" for name, groups in S.TIER_RULES) + " ELSE 'default' END"


def family_sql(model: str) -> str:
    def holds(groups: tuple) -> str:
        return " AND ".join("(" + " OR ".join(f"contains(lower({model}), '{p}')" for p in g) + ")" for g in groups)

    return "CASE " + " ".join(f"WHEN {holds(groups)} THEN '{name}'" for name, groups in S.FAMILY_RULES) + f" ELSE string_split({model}, '/')[-1] END"


def cost_sql(model: str, prefix: str = "") -> str:
    prices = ", ".join(f"('{k}', {a}::DOUBLE, {b}::DOUBLE)" for k, (a, b) in S.TIERS.items())
    p = lambda which: f"(SELECT {which} FROM (VALUES {prices}) t(k, p, q) WHERE k = {tier_sql(model)})"
    c = lambda name: f"{prefix}{name}::DOUBLE"
    return f"({c('input_tokens')} * {p('p')} / 1e6 + {c('cache_read')} * {p('p')} * 0.1 / 1e6 + {c('cache_write')} * {p('p')} * 1.25 / 1e6 + {c('output_tokens')} * {p('q')} / 1e6)"


def _stamp_sql(conv: str, minute: str) -> str:
    return f"strftime(DATE '2024-01-01' + CAST({conv} % 60 AS INT), '%Y-%m-%d') || 'T' || lpad(CAST({conv} % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST({minute} % 60 AS VARCHAR), 2, '0') || ':00.000Z'"


#: The same store for DuckDB: msg, tool and conv.
SQL = f"""
WITH msg0 AS (
  SELECT conv_id, 'm' || conv_id || '-' || turn AS id, 'c' || conv_id AS conversation_id, role, text AS content,
         CASE WHEN role = 'assistant' THEN {_case(MODELS, 'conv_id % 6')} ELSE '' END AS model, CAST(turn AS INT) AS sequence,
         CASE WHEN role = 'assistant' THEN 0 ELSE CAST(ceil(length(text) / 4.0) AS BIGINT) END AS input_tokens,
         CASE WHEN role = 'assistant' THEN CAST(ceil(length(text) / 4.0) AS BIGINT) ELSE 0 END AS output_tokens,
         CAST(length(text) % 97 AS BIGINT) AS cache_read, CAST(length(text) % 31 AS BIGINT) AS cache_write,
         {_stamp_sql('conv_id', 'turn')} AS timestamp
  FROM conversations
), msg AS (
  SELECT *, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER w - CASE WHEN first_value(role) OVER w = 'user' THEN 1 ELSE 0 END AS INT) AS turn
  FROM msg0 WINDOW w AS (PARTITION BY conv_id ORDER BY sequence ROWS UNBOUNDED PRECEDING)
), tool AS (
  SELECT 't' || event_id AS id, 'c' || (user_id % 100) AS conversation_id, 'm' || (user_id % 100) || '-' || (event_id % 8) AS message_id,
         event_type AS name, coalesce(props, '') || ' /src/a' || (event_id % 9) || {_case(ENDINGS, 'event_id % 4')} || ' ' AS input, 'v' || (event_id % 1000) AS output, event_type = 'error' AS is_error, CAST(event_id % 5000 - 1 AS BIGINT) AS duration_ms
  FROM events
), names AS (
  SELECT conversation_id, arg_min(substr(trim(regexp_replace(content, '\\s+', ' ', 'g')), 1, 120), sequence) AS name FROM msg WHERE role = 'user' GROUP BY 1
), base AS (
  SELECT conversation_id AS id, any_value(conv_id) AS n, max(sequence) AS last, count(*) AS message_count, greatest(max(turn), 0)::BIGINT AS turn_count,
         sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(cache_read)::BIGINT AS cache_read, sum(cache_write)::BIGINT AS cache_write,
         sum({cost_sql("(CASE WHEN model = '' THEN " + _case(MODELS, "conv_id % 6") + " ELSE model END)")}) AS est_cost
  FROM msg GROUP BY 1
), conv0 AS (
  SELECT b.*, 'c' || (n - n % 4) AS trace_id, CASE WHEN n % 28 = 0 THEN 'lost' || n WHEN n % 20 = 1 THEN 'gone' || n WHEN n % 4 = 0 THEN '' WHEN n % 4 = 3 THEN 'c' || (n - n % 4 + 1) ELSE 'c' || (n - n % 4) END AS parent_id,
         CASE WHEN n % 28 = 0 THEN 'forked' ELSE {_case(KINDS, 'n % 4')} END AS relationship, CASE WHEN n % 4 = 1 THEN 1 ELSE -1 END AS fork_point, {_case(ADAPTERS, 'n % 5')} AS adapter_id,
         coalesce(x.name, '') AS name, '/home/dev/p' || (n % 7) AS cwd, CASE WHEN n % 7 = 0 THEN '' ELSE 'github.com/acme/repo' || (n % 7) END AS git_remote,
         CASE WHEN n % 2 = 0 THEN 'main' ELSE 'feature/x' || (n % 3) END AS branch, {_case(MODELS, 'n % 6')} AS model,
         {_stamp_sql('n', '0')} AS started_at, CASE WHEN n % 11 = 0 THEN '' ELSE {_stamp_sql('n', 'last')} END AS ended_at,
         '/data/c' || n || '.jsonl' AS source_path, 'jsonl' AS source_format,
         CASE WHEN n % 11 = 0 THEN 0 ELSE CAST((last % 60) * 60000 AS BIGINT) END AS duration_ms
  FROM base b LEFT JOIN names x ON x.conversation_id = b.id
), conv AS (
  SELECT c.*, coalesce(t.tool_count, 0) AS tool_count, coalesce(nullif(ended_at, ''), started_at) AS activity,
         input_tokens + output_tokens + cache_read + cache_write AS tokens
  FROM conv0 c LEFT JOIN (SELECT conversation_id, count(*) AS tool_count FROM tool GROUP BY 1) t ON t.conversation_id = c.id
), sync AS (
  SELECT id AS conversation_id, 'h' || (n % 5) AS content_hash, CAST(n % 4 + 1 AS BIGINT) AS local_revision, '2024-02-' || lpad(CAST(n % 28 + 1 AS VARCHAR), 2, '0') AS ingested_at
  FROM conv WHERE n % 13 != 0
), push AS (
  SELECT id AS conversation_id, s AS sink_id, CAST(n % 3 + 1 AS BIGINT) AS last_attempted_revision, CAST(n % 3 AS BIGINT) AS last_successful_revision, '2024-02-10' AS last_attempted_at,
         CASE WHEN n % 3 = 0 THEN '' ELSE '2024-02-09' END AS last_successful_at, CASE WHEN n % 2 = 0 THEN '' ELSE 'timeout' END AS last_error
  FROM conv, (VALUES ('warehouse'), ('hook')) v(s) WHERE (s = 'warehouse' AND n % 2 = 0) OR (s = 'hook' AND n % 5 = 0)
)
"""
