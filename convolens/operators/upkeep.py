"""Upkeep of a store: sizes, order, changed sources and signatures, merged change hints, postings, versions."""

from __future__ import annotations

import hashlib
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import search as FT
from .sync import upsert

# The bytes that a record costs beside its texts.
CONVERSATION_BYTES, MESSAGE_BYTES, CALL_BYTES = 256, 256 + 8 * 8, 128 + 4 * 8
CONVERSATION_TEXTS = ("id", "trace_id", "parent_id", "relationship", "adapter_id", "name", "cwd", "git_remote", "branch", "model", "started_at", "ended_at", "source_path", "source_format")
MESSAGE_TEXTS = ("id", "role", "content", "record_type", "model", "parent_message_id", "thinking_content", "timestamp")
CALL_TEXTS = ("id", "name", "input", "output", "timestamp")


def _bytes(df: DataFrame, names: tuple[str, ...], fixed: int) -> Column:
    """UTF-8 bytes of the columns that `df` has, null counting none, and a fixed number."""
    out = F.lit(fixed).cast("long")
    for name in names:
        if name in df.columns:
            out = out + F.coalesce(F.octet_length(name), F.lit(0))
    return out


def message_bytes(messages: DataFrame, tool_calls: DataFrame) -> DataFrame:
    """(conversation_id, id, bytes): a message with its calls; calls are summed before they meet their message."""
    calls = tool_calls.groupBy("conversation_id", "message_id").agg(F.sum(_bytes(tool_calls, CALL_TEXTS, CALL_BYTES)).alias("more"))
    own = messages.select("conversation_id", "id", _bytes(messages, MESSAGE_TEXTS, MESSAGE_BYTES).alias("own"))
    joined = own.join(calls.withColumnRenamed("message_id", "id"), ["conversation_id", "id"], "left")
    return joined.select("conversation_id", "id", (F.col("own") + F.coalesce("more", F.lit(0))).alias("bytes"))


def conversation_bytes(conversations: DataFrame, messages: DataFrame, tool_calls: DataFrame) -> DataFrame:
    """(id, bytes, message_bytes, largest_message): what a conversation and its messages take to write."""
    each = message_bytes(messages, tool_calls).groupBy("conversation_id").agg(F.sum("bytes").alias("m"), F.max("bytes").alias("most"))
    own = conversations.select("id", _bytes(conversations, CONVERSATION_TEXTS, CONVERSATION_BYTES).alias("bytes"))
    joined = own.join(each, F.col("id") == F.col("conversation_id"), "left")
    zero = F.lit(0).cast("long")
    return joined.select("id", "bytes", F.coalesce("m", zero).alias("message_bytes"), F.coalesce("most", zero).alias("largest_message"))


def out_of_order(messages: DataFrame, arrival: str) -> DataFrame:
    """(conversation_id, steps_back): conversations whose messages, as they arrive, do not rise in sequence."""
    w = Window.partitionBy("conversation_id").orderBy(arrival, "id")
    back = (F.lag("sequence").over(w) > F.col("sequence")).alias("back")
    return messages.select("conversation_id", back).where("back").groupBy("conversation_id").agg(F.count("*").alias("steps_back"))


def changed_signatures(known: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of databases by signature: (source_path, ref_id) to read again, and the state that follows.

    Both have source_path, ref_id and signature. A row is read if it is new or its signature another; a null
    signature is a value. Rows that are gone from a database leave the state, those of databases that
    weren't looked at stay.
    """
    key = ["source_path", "ref_id"]
    old = known.select(*key, F.col("signature").alias("old"), F.lit(True).alias("seen"))
    changed = found.join(old, key, "left").where("seen IS NULL OR NOT (signature <=> old)").select(*key)
    return changed, upsert(known, found, ["source_path"])


def merged_hints(hints: DataFrame) -> DataFrame:
    """(adapter_id, paths): the paths of all pending hints (adapter_id, paths), each once, sorted; null and empty ones name none."""
    each = hints.select("adapter_id", F.explode("paths").alias("path")).where("path IS NOT NULL").distinct()
    return each.groupBy("adapter_id").agg(F.array_sort(F.collect_list("path")).alias("paths"))


def discovery_status(known: DataFrame, listed: DataFrame) -> DataFrame:
    """(adapter_id, cached, invalidated, fresh): sources as they were; changed or gone; new.

    Both have adapter_id, path, size and mtime.
    """
    key = ["adapter_id", "path"]
    old = known.select(*key, F.struct("size", "mtime").alias("old"))
    new = listed.select(*key, F.struct("size", "mtime").alias("new"))
    joined = old.join(new, key, "full")
    same = F.col("old").isNotNull() & F.col("old").eqNullSafe(F.col("new"))
    return joined.groupBy("adapter_id").agg(
        F.count_if(same).alias("cached"), F.count_if(F.col("old").isNotNull() & ~same).alias("invalidated"), F.count_if(F.col("old").isNull()).alias("fresh")
    )


def postings(messages: DataFrame) -> DataFrame:
    """(word, conversation_id, id, sequence, tf, dl): the words of each message; one without words has none."""
    return FT.placed_words(messages).select("word", "conversation_id", "id", "sequence", F.size("places").cast("long").alias("tf"), "dl")


def refreshed_postings(index: DataFrame, messages: DataFrame, changed: DataFrame) -> DataFrame:
    """`index` with the postings of the conversations in `changed` (conversation_id) made again from `messages`.

    Only their messages are tokenised; a conversation without messages leaves the index. The ids, few beside the
    words, are looked up by hash, so that no task sorts the index' rows.
    """
    ids = changed.select("conversation_id").distinct().hint("shuffle_hash")
    again = postings(messages.join(ids, "conversation_id", "left_semi"))
    return index.join(ids, "conversation_id", "left_anti").unionByName(again)


def canonical_json(value: Column) -> Column:
    """A JSON text with sorted keys and no spaces; null gives an empty text, what is no JSON stays."""

    def one(text: str | None) -> str:
        if text is None:
            return ""
        try:
            return json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return text

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(one)

    return run(value)


def config_fingerprint(adapter: str, contract_version: int, enabled: bool = True, data_dir: str | None = None, allow_protected: bool = False) -> str:
    """SHA-256 of a source's settings: a cache made under others is not used."""
    settings = {"adapterId": adapter, "adapterContractVersion": contract_version, "enabled": enabled, "dataDir": (data_dir or "").strip(), "allowProtectedSource": allow_protected}
    return hashlib.sha256(json.dumps(settings, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def version_problem(local: str, remote: str | None) -> str:
    """Why a store of schema version `remote` can't be written by `local` (major.minor; the majors must be equal), or nothing."""
    parsed = [re.fullmatch(r"\s*(\d+)\.(\d+)\s*", v or "") for v in (local, remote)]
    if not parsed[0]:
        return f"invalid local version {local}"
    if not (remote or "").strip():
        return "the remote schema is not initialised"
    if not parsed[1]:
        return f"remote version {remote} is not major.minor"
    ours, theirs = (int(m[1]) for m in parsed)
    return "" if ours == theirs else f"remote version {remote} is {'newer' if theirs > ours else 'older'} than {local}"
