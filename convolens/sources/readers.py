"""The readers by adapter: conversations, messages and tool calls of one folder or of a list of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..model import TOOL_CALL
from .chats import read_chats
from .composers import read_composers
from .rollouts import read_rollouts, trace_roots
from .sqlite import read_kiro, read_warp
from .transcripts import AMP, GEMINI, OPENCODE, OPENCODE_LINES, PI, PIAGENT, fork_points, read_documents, read_lines, read_sessions, read_simple

Paths = str | list[str]
Tables = tuple[DataFrame, DataFrame, DataFrame]


def _sessions(spark: SparkSession, path: Paths) -> Tables:
    conversations, messages, calls = read_sessions(read_lines(spark, path))
    return fork_points(conversations, messages, calls), messages, calls


def _rollouts(spark: SparkSession, path: Paths) -> Tables:
    conversations, messages, calls = read_rollouts(read_lines(spark, path))
    return trace_roots(conversations), messages, calls


def _databases(read: Callable[[SparkSession, Paths], tuple[DataFrame, ...]]) -> Callable[[SparkSession, Paths], Tables]:
    """A reader of databases; one without calls gets an empty table of them."""

    def run(spark: SparkSession, path: Paths) -> Tables:
        found = read(spark, path)
        return (*found, *([spark.createDataFrame([], TOOL_CALL)] if len(found) == 2 else []))

    return run


def _editor(spark: SparkSession, path: Paths) -> Tables:
    """The editor's key-value store, and its chats as graphs of blobs."""
    one, two = read_composers(spark, path), read_chats(spark, path)
    return tuple(a.unionByName(b) for a, b in zip(one, two))


def _opencode(spark: SparkSession, path: Paths) -> Tables:
    """Sessions as documents, and as lines."""
    one, two = read_simple(read_documents(spark, path), OPENCODE), read_simple(read_lines(spark, path), OPENCODE_LINES)
    return tuple(a.unionByName(b) for a, b in zip(one, two))


#: Adapters whose files are one JSON value each.
WHOLE = ("gemini-cli", "opencode")

READERS: dict[str, Callable[[SparkSession, Paths], Tables]] = {
    "claude-code": _sessions,
    "codex": _rollouts,
    "cursor": _editor,
    "kiro": _databases(read_kiro),
    "warp": _databases(read_warp),
    "amp": lambda spark, path: read_simple(read_lines(spark, path), AMP),
    "pi": lambda spark, path: read_simple(read_lines(spark, path), PI),
    "piagent": lambda spark, path: read_simple(read_lines(spark, path), PIAGENT),
    "gemini-cli": lambda spark, path: read_simple(read_documents(spark, path), GEMINI),
    "opencode": _opencode,
}
