"""Context artifacts: instructions, settings, rules, plans and tasks that lie beside the transcripts of a tool."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S

MOST_CHARS = 100_000
#: Fixed values: (path below the tool's folder, kind, name, scope); a group in the path goes into the name.
KINDS = (
    (r"CLAUDE\.md", "memory", "CLAUDE.md (global)", "global"),
    (r"settings\.json", "config", "settings.json (global)", "global"),
    (r"rules/([^/]+\.(?:md|jsonl?))", "rules", "rules (global)/$1", "global"),
    (r"agents/([^/]+\.(?:md|jsonl?))", "agent-def", "agents (global)/$1", "global"),
    (r"commands/([^/]+\.(?:md|jsonl?))", "skill", "commands (global)/$1", "global"),
    (r"skills/([^/]+\.(?:md|jsonl?))", "skill", "skills (global)/$1", "global"),
    (r"history\.jsonl", "history", "history.jsonl", "global"),
    (r"stats-cache\.json", "config", "stats-cache.json", "global"),
    (r"plans/([^/]+\.(?:md|jsonl?))", "plan", "plans/$1", "global"),
    (r"projects/([^/]+)/memory/([^/]+\.(?:md|jsonl?))", "memory", "memory ($1)/$2", "project"),
    (r"todos/([^/]+\.(?:md|jsonl?))", "todo", "todos/$1", "session"),
    (r"tasks/([^/]+)/tasks\.json", "todo", "tasks/$1", "session"),
)


def read_artifacts(spark: SparkSession, folder: str, adapter: str = "claude-code") -> DataFrame:
    """(id, adapter_id, kind, name, path, scope, content, content_hash, size, updated_at) of the files of known kinds.

    The hash is of the path and the whole text; texts of over MOST_CHARS characters are shown cut, with a note.
    Other files are told by their path and never opened.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    below = F.regexp_extract("path", f"{folder.rstrip('/').split(':')[-1].lstrip('/')}/(.*)$", 1)
    kind, name, scope = (F.lit(None).cast("string") for _ in range(3))
    for pattern, k, label, s in KINDS:
        hit = below.rlike(f"^{pattern}$")
        kind, scope = F.when(hit, k).otherwise(kind), F.when(hit, s).otherwise(scope)
        name = F.when(hit, F.regexp_replace(below, f"^{pattern}$", label)).otherwise(name)
    known = files.withColumns({"kind": kind, "scope": scope, "name": name}).where("kind IS NOT NULL")
    text = F.decode("content", "UTF-8")
    known = known.withColumns({"text": text, "content_hash": S.stable_id(F.col("path"), text)})
    cut = F.when(F.length("text") > MOST_CHARS, F.concat(F.substring("text", 1, MOST_CHARS), F.lit("\n...[truncated]"))).otherwise(F.col("text"))
    return known.select(
        F.concat(F.lit("cc:"), "content_hash", F.lit(":"), F.element_at(F.split("path", "/"), -1)).alias("id"),
        F.lit(adapter).alias("adapter_id"), "kind", "name", "path", "scope", cut.alias("content"), "content_hash",
        F.col("length").alias("size"), F.col("modificationTime").alias("updated_at"),
    )
