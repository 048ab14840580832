"""Sinks: each takes payload rows (id, adapter_id, revision, idempotency_key, body) and gives (id, ok, error)."""

from __future__ import annotations

import json
import re
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_RESULT = "id string, ok boolean, error string"


def object_key(adapter: str, conversation: str, prefix: str = "") -> str:
    """prefix/adapter/id.json; a slash or a name of dots alone can't lead to another folder."""
    safe = lambda x: re.sub(r"[/\\]|^\.+$", lambda m: "".join(f"%{ord(c):02X}" for c in m[0]), x)
    return "/".join(x for x in (prefix.strip("/"), safe(adapter or ""), f"{safe(conversation)}.json") if x)


def objects(root: str, prefix: str = "") -> Callable[[DataFrame], DataFrame]:
    """One object for each conversation at root/prefix/adapter/id.json, in any store that Arrow's file systems reach.

    Each task writes its rows' objects, one at a time, under their final names: one that is written again has the same
    key. An object that fails gives its error and leaves the others alone.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        for frame in frames:
            errors = []
            for adapter, conversation, body in zip(frame.adapter_id, frame.id, frame.body):
                path = f"{base.rstrip('/')}/{object_key(adapter, conversation, prefix)}"
                try:
                    store.create_dir(path.rpartition("/")[0], recursive=True)
                    with store.open_output_stream(path) as out:
                        out.write(body.encode())
                    errors.append("")
                except OSError as problem:
                    errors.append(str(problem))
            yield pd.DataFrame({"id": frame.id, "ok": [not e for e in errors], "error": errors})

    return lambda rows: rows.select("id", "adapter_id", "body").mapInPandas(run, _RESULT)


def webhook(url: str, batch: int = 20, timeout: float = 30.0, post: Callable[[str, bytes, float], tuple[int, bytes]] | None = None) -> Callable[[DataFrame], DataFrame]:
    """Posts batches of bodies as JSON. An answer may name errors by id; those without one go to the rows in order."""

    def default_post(url: str, data: bytes, timeout: float) -> tuple[int, bytes]:
        request = urllib.request.Request(url, data, {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                return answer.status, answer.read()
        except urllib.error.HTTPError as e:
            return e.code, e.read()

    call = post or default_post

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                data = json.dumps([{"key": k, "payload": json.loads(b)} for k, b in zip(part.idempotency_key, part.body)]).encode()
                try:
                    status, body = call(url, data, timeout)
                    errors = assigned(list(part.id), json.loads(body or b"{}").get("errors", []) if status < 400 else [{"error": f"status {status}"}] * len(part))
                except (OSError, ValueError) as e:
                    errors = dict.fromkeys(part.id, str(e))
                yield pd.DataFrame({"id": part.id, "ok": [i not in errors for i in part.id], "error": [errors.get(i, "") for i in part.id]})

    return lambda rows: rows.select("id", "idempotency_key", "body").mapInPandas(run, _RESULT)


def assigned(ids: list[str], errors: list[dict]) -> dict[str, str]:
    """Error texts by id; an error that names none is given to the next id without one."""
    out = {e["id"]: str(e.get("error", "")) for e in errors if e.get("id") in ids}
    free = iter([i for i in ids if i not in out])
    for e in errors:
        if e.get("id") not in ids and (i := next(free, None)) is not None:
            out[i] = str(e.get("error", ""))
    return out


def jdbc(url: str, table: str, properties: dict[str, str] | None = None) -> Callable[[DataFrame], DataFrame]:
    """Appends bodies to a staging table; the database merges them by idempotency_key. Needs the driver's jar."""

    def send(rows: DataFrame) -> DataFrame:
        rows.select("id", "revision", "idempotency_key", "body").write.jdbc(url, table, mode="append", properties=properties or {})
        return rows.select("id", F.lit(True).alias("ok"), F.lit("").alias("error"))

    return send


def _filename() -> Column:
    safe = F.substring(F.regexp_replace("name", "[^A-Za-z0-9]+", "-"), 1, 50)
    return F.concat_ws("-", F.substring("started_at", 1, 10), safe, F.substring("id", 1, 8)).alias("filename")


def export_json(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """(id, filename, json): each conversation with its messages in order, as one JSON document."""
    bodies = messages.groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct("sequence", "id", F.struct(*messages.columns).alias("m")))).alias("parts"))
    rows = conversations.join(bodies, conversations["id"] == bodies["conversation_id"], "left").drop("conversation_id")
    listed = F.coalesce(F.transform("parts", lambda p: p["m"]), F.array().cast(bodies.select(F.transform("parts", lambda p: p["m"]).alias("x")).schema["x"].dataType))
    body = F.to_json(F.struct(F.struct(*conversations.columns).alias("conversation"), listed.alias("messages")))
    return rows.select("id", _filename(), body.alias("json"))


def markdown(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """(id, filename, markdown): each conversation as a document, its messages in order."""
    part = F.concat(F.lit("## "), F.initcap("role"), F.lit("\n\n"), "content")
    bodies = messages.groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct("sequence", "id", part.alias("t")))).alias("parts"))
    rows = conversations.join(bodies, conversations["id"] == bodies["conversation_id"], "left").drop("conversation_id")
    head = F.concat(F.lit("# "), F.col("name"), F.lit("\n\n- Harness: "), F.col("adapter_id"), F.lit("\n- Started: "), F.col("started_at"), F.lit("\n\n"))
    text = F.concat(head, F.coalesce(F.array_join(F.transform("parts", lambda p: p["t"]), "\n\n"), F.lit("")))
    return rows.select("id", _filename(), text.alias("markdown"))
