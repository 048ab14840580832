"""A sink that keeps conversations in a relational database: one transaction for each, its messages and calls replaced.

`connect` gives a DB-API connection that commits only when told to; it is called on the driver for the check of the
schema and once in each task that writes. A conversation that is sent again leaves the same rows, so a task that is
done twice changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import CONVERSATION, MESSAGE, TOOL_CALL
from ..operators.upkeep import version_problem
from .sinks import _RESULT

SCHEMA_VERSION = "1.0"
META, OWNER = "meta", ("team_id", "user_id")
TABLES = {"conversations": (*CONVERSATION.names, *OWNER), "messages": tuple(MESSAGE.names), "tool_calls": tuple(TOOL_CALL.names)}
KEYS = {"conversations": ("id",), "messages": ("conversation_id", "id"), "tool_calls": ("conversation_id", "message_id", "id")}
_KINDS = {"string": "TEXT", "integer": "INTEGER", "long": "BIGINT", "double": "DOUBLE PRECISION", "boolean": "BOOLEAN"}
#: The columns of a table's primary key in order, asked by table and schema.
STANDARD_KEYS = """SELECT k.column_name FROM information_schema.table_constraints c JOIN information_schema.key_column_usage k
ON k.constraint_name = c.constraint_name AND k.table_schema = c.table_schema AND k.table_name = c.table_name
WHERE c.constraint_type = 'PRIMARY KEY' AND k.table_name = {mark} AND k.table_schema = {mark} ORDER BY k.ordinal_position"""


def qualified(schema: str, table: str) -> str:
    return ".".join('"' + part.replace('"', '""') + '"' for part in (schema, table))


def _kind(column: str) -> str:
    fields = {f.name: f.dataType.typeName() for t in (CONVERSATION, MESSAGE, TOOL_CALL) for f in t}
    return _KINDS[fields.get(column, "string")]


def apply_schema(connection: Any, schema: str, mark: str = "%s") -> None:
    """Makes the tables that aren't there and records the version, in one transaction."""
    cursor = connection.cursor()
    try:
        cursor.execute(f"CREATE TABLE IF NOT EXISTS {qualified(schema, META)} (key TEXT PRIMARY KEY, value TEXT)")
        for table, columns in TABLES.items():
            listed = ", ".join(f"{c} {_kind(c)}" for c in columns)
            cursor.execute(f"CREATE TABLE IF NOT EXISTS {qualified(schema, table)} ({listed}, PRIMARY KEY ({', '.join(KEYS[table])}))")
        cursor.execute(f"DELETE FROM {qualified(schema, META)} WHERE key = 'schema_version'")
        cursor.execute(f"INSERT INTO {qualified(schema, META)} (key, value) VALUES ('schema_version', {mark})", (SCHEMA_VERSION,))
        connection.commit()
    except Exception:
        connection.rollback()
        raise


def schema_problems(connection: Any, schema: str, mark: str = "%s", keys: str = STANDARD_KEYS) -> list[str]:
    """Why the tables can't be written: a version of another major number, missing columns, other keys. Changes nothing."""
    cursor = connection.cursor()
    try:
        cursor.execute(f"SELECT value FROM {qualified(schema, META)} WHERE key = 'schema_version'")
        row = cursor.fetchone()
        if problem := version_problem(SCHEMA_VERSION, row[0] if row else None):
            return [problem]
        out = []
        for table, columns in TABLES.items():
            cursor.execute(f"SELECT * FROM {qualified(schema, table)} WHERE 1 = 0")
            if missing := sorted(set(columns) - {d[0] for d in cursor.description}):
                out.append(f"{table} lacks {', '.join(missing)}")
        cursor.execute(keys.format(mark=mark), ("tool_calls", schema))  # messages may have a narrower key: their ids are unique
        if (found := tuple(r[0] for r in cursor.fetchall())) != KEYS["tool_calls"]:
            out.append(f"the key of tool_calls is ({', '.join(found)}) and not ({', '.join(KEYS['tool_calls'])})")
        return out
    except Exception as problem:  # each driver has errors of its own; a table that isn't there is one
        return [f"the remote schema can't be read: {problem}"]
    finally:
        connection.rollback()


def warehouse(
    connect: Callable[[], Any], schema: str = "public", team: str = "", user: str = "", mark: str = "%s", keys: str = STANDARD_KEYS
) -> Callable[[DataFrame], DataFrame]:
    """Payloads into the tables of `schema`. When these aren't ready every row fails with the reason and nothing is written.

    A conversation whose transaction fails is rolled back and gives its error; the others go on. `mark` is the
    driver's sign of a parameter.
    """
    names = {t: qualified(schema, t) for t in TABLES}
    insert = {t: f"INSERT INTO {names[t]} ({', '.join(c)}) VALUES ({', '.join([mark] * len(c))})" for t, c in TABLES.items()}
    own = TABLES["conversations"]
    upsert = f"{insert['conversations']} ON CONFLICT (id) DO UPDATE SET {', '.join(f'{c} = EXCLUDED.{c}' for c in own if c != 'id')}"

    def replace(connection: Any, body: str) -> None:
        found = json.loads(body)
        conversation = found["conversation"] | dict(zip(OWNER, (team, user)))
        cursor = connection.cursor()
        cursor.execute(upsert, tuple(conversation.get(c) for c in own))
        for table in ("tool_calls", "messages"):
            cursor.execute(f"DELETE FROM {names[table]} WHERE conversation_id = {mark}", (conversation["id"],))
        for table in ("messages", "tool_calls"):
            if rows := [tuple(r.get(c) for c in TABLES[table]) for r in found.get(table) or []]:
                cursor.executemany(insert[table], rows)
        connection.commit()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        connection = None
        try:
            for frame in frames:
                errors = []
                for body in frame.body:
                    try:
                        connection = connection or connect()
                        replace(connection, body)
                        errors.append("")
                    except Exception as problem:  # whatever the database says is this row's error
                        errors.append(str(problem) or type(problem).__name__)
                        connection = _rolled_back(connection)
                yield pd.DataFrame({"id": frame.id, "ok": [not e for e in errors], "error": errors})
        finally:
            if connection is not None:
                connection.close()

    def send(rows: DataFrame) -> DataFrame:
        try:
            connection = connect()
        except Exception as problem:
            problems = [f"no connection: {problem}"]
        else:
            problems = schema_problems(connection, schema, mark, keys)
            connection.close()
        if problems:
            return rows.select("id", F.lit(False).alias("ok"), F.lit("; ".join(problems)).alias("error"))
        return rows.select("id", "body").mapInPandas(run, _RESULT)

    return send


def _rolled_back(connection: Any) -> Any:
    """The connection for the next row; none where this one is broken."""
    if connection is None:
        return None
    try:
        connection.rollback()
        return connection
    except Exception:
        return None
