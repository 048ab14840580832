"""The engine's commits, failing files, late parents and batches of a push."""

import json
import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from convolens.model import CONVERSATION, MESSAGE, TOOL_CALL
from convolens.operators import routing as P
from convolens.sources.readers import READERS
from convolens.streaming import sinks
from convolens.streaming.ingest import Engine
from convolens.streaming.state import Buckets

EMPTY = {"s": "", "i": 0, "l": 0, "d": 0.0, "b": False}


def rows_of(spark, schema, rows):
    kinds = {"string": "", "integer": 0, "long": 0, "double": 0.0, "boolean": False}
    return spark.createDataFrame([tuple(r.get(f.name, kinds[f.dataType.typeName()]) for f in schema) for r in rows], schema)


def bundle(spark, ids, adapter="codex", text="hi", parents=None):
    parents = parents or {}
    conversations = rows_of(spark, CONVERSATION, [{"id": i, "trace_id": parents.get(i, i), "parent_id": parents.get(i, ""), "relationship": "spawned" if i in parents else "root", "fork_point": -1, "adapter_id": adapter, "started_at": "2026-01-01T00:00:00.000Z"} for i in ids])
    messages = rows_of(spark, MESSAGE, [{"id": f"{i}-0", "conversation_id": i, "role": "user", "content": text} for i in ids])
    return conversations, messages, rows_of(spark, TOOL_CALL, [])


def files(root):
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def test_a_change_rewrites_its_bucket_alone(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/store", clock=lambda: "now", buckets=8)
    ids = [f"c{i:05d}" for i in range(4000)]
    assert engine.write(*bundle(spark, ids, "amp")) == 4000
    first, before = engine.tables.snapshot(), files(tmp_path)
    assert engine.write(*bundle(spark, ids[:1], "amp", "changed")) == 1
    now = engine.tables.snapshot()
    assert (first.version, now.version) == (1, 2)
    for name in ("conversations", "messages", "sync"):
        same = [b for b, f in first.folders[name].items() if now.folders[name][b] == f]
        assert len(first.folders[name]) == 8 and len(same) == 7
        assert engine.tables.read(name, now).count() == 4000
    written = sum(n for f, n in files(tmp_path).items() if f not in before and "/messages/" in f)
    assert written < sum(n for f, n in before.items() if "/messages/" in f) / 4
    # a reader of the first commit sees all of it, also of other tables
    assert engine.tables.read("messages", first).where("content = 'changed'").isEmpty()
    assert engine.tables.read("messages", now).where("content = 'changed'").count() == 1
    assert engine.store().sync.where("local_revision = 2").count() == 1
    assert engine.write(*bundle(spark, ids[:1], "amp", "changed")) == 0
    engine.tables.vacuum(1)
    assert engine.store().messages.count() == 4000
    with pytest.raises(Exception):
        engine.tables.read("messages", first).count()


def test_two_writers_of_one_version(spark, tmp_path):
    schema = rows_of(spark, TOOL_CALL, []).schema
    one, other = (Buckets(spark, f"file://{tmp_path}/t", {"calls": (schema, "conversation_id")}, 4) for _ in range(2))
    rows = rows_of(spark, schema, [{"id": "x", "conversation_id": "c"}])
    early = other.snapshot()
    assert one.commit(one.snapshot(), {"calls": (rows, rows)}).version == 1
    with pytest.raises(RuntimeError):
        other.commit(early, {"calls": (rows, rows)})
    other.snapshot = lambda: early  # it looked before the first one committed
    with pytest.raises(RuntimeError):
        other.commit(early, {"calls": (rows, rows)})
    assert one.read("calls").count() == 1 and one.read("calls", early).isEmpty()
    assert one.commit(one.snapshot(), {"calls": (rows.limit(0), rows)}).version == 2 and one.read("calls").isEmpty()


def test_bad_files_are_put_down_and_tried_again(spark, tmp_path):
    folder = tmp_path / "amp"
    folder.mkdir()
    line = lambda i: json.dumps({"thread_id": f"T{i}", "role": "user", "content": f"text {i}", "timestamp": "2026-04-01T10:00:00Z"}) + "\n"
    for i in range(20):
        (folder / f"a b+{i}.jsonl").write_text(line(i))
    (folder / "broken.jsonl").write_text('{"thread_id": \n{"no\n')
    (folder / "binary.jsonl").write_bytes(bytes(range(1, 256)) * 20)
    (folder / "empty.jsonl").write_text("")
    engine = Engine(spark, f"file://{tmp_path}/amp/own", clock=lambda: "now")
    assert engine.ingest("amp", str(folder)) == 20
    failed = {r.path.rsplit("/", 1)[1]: r.problem for r in engine.failures().collect()}
    assert set(failed) == {"broken.jsonl", "binary.jsonl"} and "none of 2 lines" in failed["broken.jsonl"]
    assert engine.ingest("amp", str(folder)) == 0 and engine.failures().count() == 2
    (folder / "broken.jsonl").write_text(line(99))
    assert engine.ingest("amp", str(folder)) == 1
    assert [r.path.rsplit("/", 1)[1] for r in engine.failures().collect()] == ["binary.jsonl"]
    assert engine.store().conversations.count() == 21


def test_locked_databases_are_tried_again(spark, tmp_path):
    folder = tmp_path / "kiro"
    folder.mkdir()
    for i in range(3):
        db = sqlite3.connect(folder / f"{i}.db")
        db.execute("CREATE TABLE sessions (id TEXT, title TEXT)")
        db.execute("CREATE TABLE messages (id TEXT, conversation_id TEXT, role TEXT, content TEXT, created_at TEXT)")
        db.execute("INSERT INTO sessions VALUES (?, 'title')", [f"s{i}"])
        db.execute("INSERT INTO messages VALUES ('m', ?, 'user', 'hello', '2026-04-01T10:00:00Z')", [f"s{i}"])
        db.commit()
        db.close()
    (folder / "junk.db").write_text("no database at all, but long enough to be looked at" * 40)
    lock = sqlite3.connect(folder / "2.db", isolation_level=None)
    lock.execute("BEGIN EXCLUSIVE")
    engine = Engine(spark, f"file://{tmp_path}/store", clock=lambda: "now")
    assert engine.ingest("kiro", str(folder)) == 2
    problems = {r.path.rsplit("/", 1)[1]: r.problem for r in engine.failures().collect()}
    assert set(problems) == {"2.db", "junk.db"} and "locked" in problems["2.db"]
    lock.execute("COMMIT")
    lock.close()
    assert engine.ingest("kiro", str(folder)) == 1 and engine.failures().count() == 1


def chain(n):
    return {f"c{i:04d}": f"c{i - 1:04d}" for i in range(1, n)}


def linked(engine):
    return {tuple(r) for r in engine.store().conversations.select("id", "trace_id", "parent_id", "relationship", "fork_point").collect()}


def test_a_late_parent_moves_its_descendants(spark, tmp_path):
    parents, n = chain(300), 300
    ids = [f"c{i:04d}" for i in range(n)]
    whole, late = (Engine(spark, f"file://{tmp_path}/{x}", clock=lambda: "now", buckets=4) for x in ("whole", "late"))
    whole.write(*bundle(spark, ids, parents=parents))
    late.write(*bundle(spark, ids[150:], parents=parents))
    assert late.store().conversations.where("trace_id = 'c0149'").count() == 150
    late.write(*bundle(spark, ids[:150], parents=parents))
    assert linked(late) == linked(whole) and {r[1] for r in linked(whole)} == {"c0000"}
    revisions = dict(late.store().sync.groupBy("local_revision").count().collect())
    assert revisions == {1: 150, 2: 150}  # what moved is due again
    assert late.write(*bundle(spark, ids[200:], parents=parents)) == 0
    assert linked(late) == linked(whole)


def test_a_late_parent_gives_fork_points(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/store", clock=lambda: "now", buckets=4)
    child = bundle(spark, ["agent-7"], "claude-code", parents={"agent-7": "P"})
    engine.write(*child)
    assert linked(engine) == {("agent-7", "P", "P", "spawned", -1)}
    c, m, _ = bundle(spark, ["P"], "claude-code")
    m = m.withColumn("turn", F.lit(3))
    engine.write(c, m, rows_of(spark, TOOL_CALL, [{"id": "t", "conversation_id": "P", "message_id": "P-0", "name": "spawn", "output": "started 7"}]))
    assert linked(engine) == {("agent-7", "P", "P", "spawned", 3), ("P", "P", "", "root", -1)}
    assert engine.write(*child) == 0 and ("agent-7", "P", "P", "spawned", 3) in linked(engine)
    engine.write(*bundle(spark, ["agent-7"], "claude-code", "more", {"agent-7": "P"}))
    assert ("agent-7", "P", "P", "spawned", 3) in linked(engine)


def test_a_push_is_recorded_batch_by_batch(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/store", clock=lambda: "now", buckets=4)
    engine.write(*bundle(spark, [f"c{i:02d}" for i in range(50)], "amp"))
    routes, sent = [P.Route(("lake",))], []

    def send(rows):
        keys = sorted(r.idempotency_key for r in rows.collect())
        if len(sent) == 2:
            raise ConnectionError("the sink died")
        sent.append(keys)
        return rows.select("id", F.lit(True).alias("ok"), F.lit("").alias("error"))

    with pytest.raises(ConnectionError):
        engine.push("lake", routes, send)
    assert [len(s) for s in sent] == [20, 20] and engine.store().push_state.count() == 40
    first = {k for s in sent for k in s}
    sent.clear()
    assert engine.push("lake", routes, send) == 10
    assert len(sent) == 1 and not first & set(sent[0]) and len(first | set(sent[0])) == 50
    assert engine.push("lake", routes, send) == 0


def test_a_file_that_grows_starts_a_batch(spark, tmp_path):
    folder = tmp_path / "amp"
    folder.mkdir()
    line = lambda i: json.dumps({"thread_id": "T", "role": "user", "content": f"text {i}", "timestamp": "2026-04-01T10:00:00Z"}) + "\n"
    (folder / "t.jsonl").write_text(line(0))
    engine = Engine(spark, f"file://{tmp_path}/store", clock=lambda: "now", buckets=2)

    calls, ingest = [], engine.ingest
    engine.ingest = lambda *of: calls.append(of) or ingest(*of)

    def batches():
        calls.clear()
        query = engine.watch("amp", str(folder), f"{tmp_path}/checkpoint", once=True)
        query.awaitTermination(120)
        assert query.exception() is None
        return len(calls)

    assert batches() == 1 and engine.store().messages.count() == 1
    assert batches() == 0
    with (folder / "t.jsonl").open("a") as f:
        f.write(line(1))
    assert batches() == 1 and engine.store().messages.count() == 2


def test_objects_have_one_key_a_conversation(spark, tmp_path):
    rows = spark.createDataFrame([("a/b", "x", '{"n": 1}'), ("..", "x", "{}"), ("c", "y", '{"n": 2}')], "id string, adapter_id string, body string")
    (tmp_path / "lake" / "p" / "y").mkdir(parents=True)
    (tmp_path / "lake" / "p" / "y" / "c.json").mkdir()  # a folder where the object should be
    send = sinks.objects(f"file://{tmp_path}/lake", "p")
    out = {r.id: (r.ok, bool(r.error)) for r in send(rows).collect()}
    assert out == {"a/b": (True, False), "..": (True, False), "c": (False, True)}
    assert sorted(os.listdir(tmp_path / "lake" / "p" / "x")) == ["%2E%2E.json", "a%2Fb.json"]
    assert (tmp_path / "lake" / "p" / "x" / "a%2Fb.json").read_text() == '{"n": 1}'


def test_lines_and_documents_of_one_tool(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"id": "D", "messages": [{"role": "user", "content": "hi"}]}))
    (tmp_path / "b.jsonl").write_text("\n".join(json.dumps(x) for x in ({"session_id": "first", "role": "user", "content": "one"}, {"session_id": "L", "role": "assistant", "content": "two"})))
    conversations, messages, _ = READERS["opencode"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in conversations.select("id", "source_format").collect()) == [("D", "json"), ("L", "jsonl")]
    assert sorted(tuple(r) for r in messages.select("conversation_id", "sequence", "content").collect()) == [("D", 0, "hi"), ("L", 0, "one"), ("L", 1, "two")]
