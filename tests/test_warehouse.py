"""The relational sink: order of its statements, rollback, a second push, and checks of the schema."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from convolens.model import CONVERSATION, MESSAGE, TOOL_CALL
from convolens.operators import routing as P
from convolens.streaming import warehouse as W
from convolens.streaming.ingest import Engine

from .test_ingest import bundle, rows_of

KEYS = "SELECT name FROM pragma_table_info({mark}, {mark}) WHERE pk > 0 ORDER BY pk"


class Recorded:
    """A connection that notes the first words of what it is asked to do."""

    def __init__(self, path, log):
        self.own, self.log = sqlite3.connect(path, timeout=30), log

    def _note(self, text):
        with open(self.log, "a") as f:
            f.write(text + "\n")

    def cursor(self):
        outer, cursor = self, self.own.cursor()

        class Cursor:
            def execute(self, sql, params=()):
                outer._note(" ".join(sql.split()[:3]))
                return cursor.execute(sql, params)

            def executemany(self, sql, rows):
                outer._note(" ".join(sql.split()[:3]))
                return cursor.executemany(sql, rows)

            def __getattr__(self, name):
                return getattr(cursor, name)

        return Cursor()

    def commit(self):
        self._note("COMMIT")
        self.own.commit()

    def rollback(self):
        self._note("ROLLBACK")
        self.own.rollback()

    def close(self):
        self.own.close()


def dump(path):
    db = sqlite3.connect(path)
    out = {t: sorted(db.execute(f"SELECT * FROM {t}").fetchall(), key=repr) for t in W.TABLES}
    db.close()
    return out


@pytest.fixture
def base(tmp_path):
    path = str(tmp_path / "w.db")
    db = sqlite3.connect(path)
    W.apply_schema(db, "main", "?")
    W.apply_schema(db, "main", "?")
    assert W.schema_problems(db, "main", "?", KEYS) == []
    db.close()
    return path


def sink(path, log):
    return W.warehouse(lambda: Recorded(path, log), "main", "t1", "u1", "?", KEYS)


def payload(spark, ids, text="hi"):
    body = lambda i: {"conversation": {"id": i, "trace_id": i}, "messages": [{"id": f"{n}", "conversation_id": i, "content": f"{text} {n}", "sequence": n} for n in range(2)], "tool_calls": [{"id": "t", "conversation_id": i, "message_id": "0", "name": "read"}]}
    assert set(body("x")["conversation"]) <= set(CONVERSATION.names) and set(body("x")["messages"][0]) <= set(MESSAGE.names) and set(body("x")["tool_calls"][0]) <= set(TOOL_CALL.names)
    return spark.createDataFrame([(i, json.dumps(body(i))) for i in ids], "id string, body string").coalesce(1)


def test_statements_come_in_order(spark, base, tmp_path):
    log = tmp_path / "log"
    assert [tuple(r) for r in sink(base, log)(payload(spark, ["a"])).collect()] == [("a", True, "")]
    steps = log.read_text().splitlines()
    wrote = steps[steps.index("ROLLBACK") + 1 :]  # the check of the schema ends in a rollback
    table = lambda t: W.qualified("main", t)
    assert wrote == [f"INSERT INTO {table('conversations')}", f"DELETE FROM {table('tool_calls')}", f"DELETE FROM {table('messages')}", f"INSERT INTO {table('messages')}", f"INSERT INTO {table('tool_calls')}", "COMMIT"]
    assert not any(s.startswith(("INSERT", "DELETE", "CREATE")) for s in steps[: steps.index("ROLLBACK")])


def test_a_second_push_changes_nothing_and_a_new_one_replaces(spark, base, tmp_path):
    send = sink(base, tmp_path / "log")
    send(payload(spark, ["a", "b"])).collect()
    first = dump(base)
    assert {t: len(r) for t, r in first.items()} == {"conversations": 2, "messages": 4, "tool_calls": 2}
    assert first["conversations"][0][-2:] == ("t1", "u1")
    send(payload(spark, ["a", "b"])).collect()
    assert dump(base) == first
    send(payload(spark, ["b"], "new")).collect()
    now = dump(base)
    assert [r for r in now["messages"] if "b" in r] != [r for r in first["messages"] if "b" in r] and len(now["messages"]) == 4
    assert [r for r in now["messages"] if "a" in r] == [r for r in first["messages"] if "a" in r]


def test_a_failure_rolls_one_conversation_back(spark, base, tmp_path):
    send = sink(base, tmp_path / "log")
    send(payload(spark, ["a", "b", "c"])).collect()
    db = sqlite3.connect(base)
    db.execute("CREATE TRIGGER stop BEFORE INSERT ON messages WHEN NEW.conversation_id = 'b' AND NEW.sequence = 1 BEGIN SELECT RAISE(ABORT, 'refused'); END")
    db.commit()
    db.close()
    before = dump(base)
    out = {r.id: (r.ok, r.error) for r in send(payload(spark, ["a", "b", "c"], "new")).collect()}
    assert out == {"a": (True, ""), "b": (False, "refused"), "c": (True, "")}
    now = dump(base)
    of = lambda d, i: [r for t in d for r in d[t] if i in r]
    assert of(now, "b") == of(before, "b") and of(now, "a") != of(before, "a") and of(now, "c") != of(before, "c")


@pytest.mark.parametrize("change, reason", [("UPDATE meta SET value = '9.0'", "newer"), ("DELETE FROM meta", "not initialised"), ("DROP TABLE meta", "can't be read"), ("ALTER TABLE conversations DROP COLUMN team_id", "lacks team_id")])
def test_what_is_not_ready_is_not_written(spark, base, tmp_path, change, reason):
    db = sqlite3.connect(base)
    db.execute(change)
    db.commit()
    db.close()
    (row,) = sink(base, tmp_path / "log")(payload(spark, ["a"])).collect()
    assert not row.ok and reason in row.error
    assert dump(base)["messages"] == []


def test_another_key_is_found(tmp_path):
    db = sqlite3.connect(tmp_path / "x.db")
    columns = ", ".join(W.TABLES["tool_calls"])
    db.execute(f"CREATE TABLE tool_calls ({columns}, PRIMARY KEY (id))")
    W.apply_schema(db, "main", "?")
    assert W.schema_problems(db, "main", "?", KEYS) == ["the key of tool_calls is (id) and not (conversation_id, message_id, id)"]


def test_the_engine_pushes_to_it(spark, base, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/store", clock=lambda: "now", buckets=2)
    c, m, t = bundle(spark, ["x", "y"], "amp")
    engine.write(c, m, rows_of(spark, t.schema, [{"id": "t", "conversation_id": "x", "message_id": "x-0", "name": "read"}]))
    send, routes = sink(base, tmp_path / "log"), [P.Route(("w",))]
    assert engine.push("w", routes, send) == 2 and engine.push("w", routes, send) == 0
    found = dump(base)
    assert [r[0] for r in found["conversations"]] == ["x", "y"] and len(found["messages"]) == 2 and len(found["tool_calls"]) == 1
    assert engine.store().push_state.where(F.col("last_error") == "").count() == 2
