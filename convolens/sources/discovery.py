"""Where transcripts lie, which tools may be read, and what a working directory belongs to."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tools whose folders the operating system guards: read only if asked for by name.
ASK_FIRST = frozenset({"cursor", "warp", "kiro"})


def default_path(candidates: Iterable[str], has_data) -> str | None:
    """The first folder that holds data, else the first that exists."""
    there = [p for p in candidates if os.path.isdir(os.path.expanduser(p))]
    return next((p for p in there if has_data(p)), there[0] if there else None)


def allowed(adapters: Iterable[str], opted_in: Iterable[str] = ()) -> list[str]:
    wanted = set(opted_in)
    return [a for a in adapters if a not in ASK_FIRST or a in wanted]


def not_own(path: Column, own_dir: str) -> Column:
    """Leaves out what lies in the engine's own folder."""
    root = own_dir.rstrip("/")
    return ~((path == root) | path.startswith(root + "/"))


def related(path: Column, root: str) -> Column:
    """A path that is `root`, above it or under it."""
    root = root.rstrip("/")
    plain = F.regexp_replace(path, "/+$", "")
    return (plain == root) | plain.startswith(root + "/") | F.lit(root + "/").startswith(F.concat(plain, F.lit("/")))


def git_facts(cwd: str) -> tuple[str, str]:
    """(remote, branch) of a folder on this machine; '' where there is none."""

    def ask(*args: str) -> str:
        try:
            return subprocess.run(["git", "-C", cwd, *args], capture_output=True, text=True, timeout=3).stdout.strip()
        except (OSError, subprocess.TimeoutExpired):
            return ""

    return ask("remote", "get-url", "origin"), ask("rev-parse", "--abbrev-ref", "HEAD")


def with_git(spark: SparkSession, conversations: DataFrame, folders: Iterable[str]) -> DataFrame:
    """Fills git_remote and branch of conversations in `folders`, the working copies on this machine."""
    facts = spark.createDataFrame([(c, *git_facts(c)) for c in folders], "cwd string, r string, b string")
    out = conversations.join(facts, "cwd", "left")
    filled = {"git_remote": F.coalesce(F.nullif("git_remote", F.lit("")), "r", F.lit("")), "branch": F.coalesce(F.nullif("branch", F.lit("")), "b", F.lit(""))}
    return out.withColumns(filled).drop("r", "b")
