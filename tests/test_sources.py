"""Transcript readers, state and streaming on small made-up files."""

import json
import sqlite3
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from convolens.operators import routing as P
from convolens.operators import search as FT
from convolens.plans import adapters, lens
from convolens.sources import logs, rollouts, sqlite
from convolens.sources import transcripts as TR
from convolens.sources.readers import READERS
from convolens.streaming import sinks
from convolens.streaming.ingest import Engine


def put(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")


def said(role, text, at, **more):
    return {"thread_id": "T1", "role": role, "content": [{"text": text}], "timestamp": f"2026-04-01T10:{at:02d}:00Z", **more}


@pytest.fixture
def amp(tmp_path):
    call = {"id": "k1", "function": {"name": "grep", "arguments": "{}"}, "output": "found", "duration_ms": 7}
    put(tmp_path / "amp" / "t1.jsonl", [said("system", "hello", 0), said("human", "first  question\nhere", 1), "{broken", said("assistant", "answer", 2, model="gpt-4o", usage={"input_tokens": 10, "output_tokens": 5}, tool_calls=[call]), said("tool", "x", 3)])
    return tmp_path / "amp"


def test_simple_lines(spark, amp):
    conversations, messages, calls = READERS["amp"](spark, str(amp))
    m = messages.orderBy("sequence").collect()
    assert [(r["role"], r["content"], r["turn"]) for r in m] == [("system", "hello", 0), ("user", "first  question\nhere", 1), ("assistant", "answer", 1)]
    assert m[2]["input_tokens"] == 10 and m[2]["timestamp"] == "2026-04-01T10:02:00.000Z"
    c = conversations.first()
    assert (c["id"], c["name"], c["model"], c["started_at"]) == ("T1", "first question here", "gpt-4o", "2026-04-01T10:00:00.000Z")
    assert [(r["id"], r["name"], r["output"], r["duration_ms"], r["message_id"]) for r in calls.collect()] == [("k1", "grep", "found", 7, m[2]["id"])]


def test_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"sessionId": "G", "messages": [{"id": "1", "type": "user", "content": [{"text": "hi"}]}, {"id": "2", "type": "model", "parts": [{"text": "there"}], "model": "gemini-pro"}]}))
    (tmp_path / "b.json").write_text("not json")
    conversations, messages, _ = READERS["gemini-cli"](spark, str(tmp_path))
    assert [(r["role"], r["content"]) for r in messages.orderBy("sequence").collect()] == [("user", "hi"), ("assistant", "there")]
    assert conversations.select("id", "model", "relationship").collect() == [("G", "gemini-pro", "root")]


def test_sessions(spark, tmp_path):
    usage = {"input_tokens": 5, "output_tokens": 3, "cache_read_input_tokens": 2, "cache_creation_input_tokens": 1}
    line = lambda kind, at, **more: {"type": kind, "sessionId": "S", "timestamp": f"2026-04-01T10:{at:02d}:00Z", **more}
    rows = [
        line("user", 0, uuid="u1", message={"role": "user", "content": "start agent-7 please"}),
        line("assistant", 1, uuid="u2", parentUuid="u1", requestId="r", message={"id": "m", "content": [{"type": "thinking", "thinking": "hm"}, {"type": "tool_use", "id": "c1", "name": "spawn", "input": {"who": "7x"}}], "usage": usage, "model": "claude-opus"}),
        line("assistant", 2, uuid="u3", parentUuid="u2", requestId="r", message={"id": "m", "content": [{"type": "text", "text": "done"}], "usage": usage, "model": "claude-opus"}),
        line("user", 3, uuid="u4", message={"content": [{"type": "tool_result", "tool_use_id": "c1", "content": [{"text": "ok"}], "is_error": True}]}),
        line("system", 4, subtype="compact_boundary", content="compacted"),
        line("user", 5, uuid="u5", message={"content": "go on"}),
    ]
    put(tmp_path / "p" / "S.jsonl", rows)
    put(tmp_path / "p" / "S" / "subagents" / "agent-7x.jsonl", [line("user", 1, uuid="a1", message={"content": "work"})])
    conversations, messages, calls = READERS["claude-code"](spark, str(tmp_path))
    c = {r["id"]: r for r in conversations.collect()}
    assert c["S"]["relationship"] == "root" and c["S#1"]["relationship"] == "compacted" and c["S#1"]["parent_id"] == "S"
    assert (c["agent-7x"]["relationship"], c["agent-7x"]["parent_id"], c["agent-7x"]["trace_id"], c["agent-7x"]["fork_point"]) == ("spawned", "S", "S", 1)
    m = messages.where("conversation_id = 'S'").orderBy("sequence").collect()
    assert [r["content"] for r in m] == ["start agent-7 please", "hm", "done", "ok"] and [r["turn"] for r in m] == [1, 1, 1, 2]
    assert sum(r["input_tokens"] for r in m) == 5 and m[1]["parent_message_id"] == m[0]["id"]
    assert calls.select("name", "output", "is_error").collect() == [("spawn", "ok", True)]


def test_rollouts(spark, tmp_path):
    item = lambda kind, **p: {"timestamp": "2026-04-01T10:00:00Z", "type": "response_item", "payload": {"type": kind, **p}}
    rows = [
        {"type": "session_meta", "payload": {"id": "R", "cwd": "/w"}},
        {"type": "turn_context", "payload": {"model": "gpt-4o"}},
        item("message", role="user", content=[{"text": "run it"}]),
        item("function_call", call_id="c", name="shell", arguments="ls"),
        item("function_call_output", call_id="c", output="files"),
        {"type": "event_msg", "payload": {"type": "token_count", "info": {"last_token_usage": {"input_tokens": 9, "output_tokens": 4}}}},
        item("message", role="assistant", content=[{"text": "ran"}]),
        item("function_call", call_id="d", name="web", arguments="q"),
        {"type": "compacted", "payload": {"replacement_history": [{"type": "message", "role": "user", "content": [{"text": "old"}]}]}},
        item("message", role="user", content=[{"text": "next"}]),
    ]
    put(tmp_path / "r.jsonl", rows)
    conversations, messages, calls = rollouts.read_rollouts(TR.read_lines(spark, str(tmp_path)))
    m = messages.orderBy("conversation_id", "sequence").collect()
    assert [(r["conversation_id"], r["role"], r["content"], r["turn"]) for r in m] == [
        ("R", "user", "run it", 1), ("R", "assistant", "ran", 1), ("R", "assistant", rollouts.FLUSHED, 1), ("R#1", "user", "old", -1), ("R#1", "user", "next", 1),
    ]
    assert m[1]["input_tokens"] == 9 and m[1]["model"] == "gpt-4o"
    got = {r["name"]: (r["output"], r["message_id"]) for r in calls.collect()}
    assert got == {"shell": ("files", m[1]["id"]), "web": ("", m[2]["id"])}
    rooted = rollouts.trace_roots(conversations)
    assert {(r["id"], r["trace_id"], r["relationship"]) for r in rooted.collect()} == {("R", "R", "root"), ("R#1", "R", "compacted")}


def test_sqlite(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "w.db")
    db.execute("CREATE TABLE ai_queries (working_directory, query, response, created_at, model)")
    db.executemany("INSERT INTO ai_queries VALUES (?, ?, ?, ?, ?)", [("/a", "q1", "\x1b[31mr1\x1b[0m", "2026-01-01T00:00:00Z", "o3"), ("/a", "q2", "", "2026-01-02T00:00:00Z", "o3"), (None, "q3", "r3", "2026-01-03T00:00:00Z", None)])
    db.commit()
    db.close()
    db = sqlite3.connect(tmp_path / "k.db")
    db.execute("CREATE TABLE sessions (id, title, cwd, model)")
    db.execute("CREATE TABLE chat_messages (id, conversation_id, role, content, created_at)")
    db.execute("INSERT INTO sessions VALUES ('s', 'Title', '/k', 'm')")
    db.executemany("INSERT INTO chat_messages VALUES (?, 's', ?, ?, '2026-01-01T00:00:00Z')", [(1, "user", "a"), (2, "assistant", "b")])
    db.commit()
    db.close()
    conversations, messages = sqlite.read_warp(spark, str(tmp_path))
    assert conversations.count() == 2
    assert {(r["role"], r["content"]) for r in messages.collect()} == {("user", "q1"), ("assistant", "r1"), ("user", "q2"), ("user", "q3"), ("assistant", "r3")}
    conversations, messages = sqlite.read_kiro(spark, str(tmp_path))
    assert conversations.select("id", "name", "cwd").collect() == [("s", "Title", "/k")] and messages.count() == 2


def test_engine(spark, amp, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/store", clock=lambda: "now")
    assert engine.ingest("amp", str(amp)) == 1
    assert engine.ingest("amp", str(amp)) == 0
    routes = [P.Route(("lake",), adapter="a*")]
    send = sinks.objects(f"file://{tmp_path}/lake")
    refuse = sinks.webhook("x", post=lambda u, d, t: (200, b'{"errors": [{"error": "no"}]}'))
    assert engine.push("lake", routes, refuse) == 1
    assert engine.store().push_state.select("last_successful_revision", "last_error").collect() == [(0, "no")]
    assert engine.push("lake", routes, send) == 1 and engine.push("lake", routes, send) == 0
    assert json.loads((tmp_path / "lake" / "amp" / "T1.json").read_text())["conversation"]["id"] == "T1"
    with (amp / "t1.jsonl").open("a") as f:
        f.write(json.dumps(said("user", "more", 9)) + "\n")
    query = engine.watch("amp", str(amp), f"{tmp_path}/cp", once=True)
    query.awaitTermination(120)
    assert query.exception() is None
    store = engine.store()
    assert store.sync.select("local_revision").collect() == [(2,)] and store.messages.count() == 4
    assert store.conversations.first()["message_count"] == 4
    assert engine.repush("lake") == {"cleared_rows": 1, "dirty_before": 1, "dirty_after": 1}
    assert "## User" in sinks.markdown(store.conversations, store.messages).first()["markdown"]


def test_search_terms(spark):
    rows = [("a", "c", 0, "Émile walked to the old house"), ("b", "c", 1, "the house was old and walking"), ("d", "c", 2, "nothing here")]
    messages = spark.createDataFrame(rows, "id string, conversation_id string, sequence int, content string")
    conversations = spark.createDataFrame([("c", "x", "2026", "")], "id string, adapter_id string, started_at string, ended_at string")
    terms = FT.Terms
    hits = lambda **q: {r["message_id"] for r in FT.search(messages, conversations, terms(**q)).collect()}
    assert hits(all_of=("emile",)) == {"a"} and hits(all_of=("walk*",)) == {"a", "b"} and hits(all_of=('"old house"',)) == {"a"}
    assert hits(all_of=("house",), none_of=("emile",)) == {"b"} and hits(any_of=("emile", "nothing")) == {"a", "d"} and hits() == set()
    assert hits(near=(("old", "was", 0),)) == {"b"} and hits(near=(("old", "house", 0),)) == {"a"} and hits(near=(("old", "house", 2),)) == {"a", "b"}
    assert hits(any_of=("emile", "walking"), all_of=("house",)) == {"a", "b"} and hits(all_of=("missing", "house")) == set()
    snippet = FT.with_snippets(FT.search(messages, conversations, terms(all_of=("old",))), messages, terms(all_of=("old",))).where(F.col("message_id") == "a").first()["snippet"]
    assert snippet == "Émile walked to the >>>old<<< house"


def test_log_tail(spark, tmp_path):
    (tmp_path / "x.log").write_text("".join(f"line {i}\r\n" for i in range(30)))
    rows, n = logs.tail(spark, str(tmp_path / "x.log"), 3)
    assert [r["line"] for r in rows.collect()] == ["line 27", "line 28", "line 29"] and n == 30


def test_composers(spark, tmp_path):
    from convolens.sources import composers

    db = sqlite3.connect(tmp_path / "state.db")
    db.execute("CREATE TABLE cursorDiskKV (key TEXT, value BLOB)")
    head = lambda **x: json.dumps({"createdAt": 1775037600000, "modelConfig": {"modelName": "gpt-4o"}, **x})
    cells = [
        ("composerData:P", head(name="New Agent", fullConversationHeadersOnly=[{"bubbleId": "1", "type": 1}, {"bubbleId": "2", "type": 2}, {"bubbleId": "9"}], subagentComposerIds=["C"])),
        ("composerData:C", head(name="Child", fullConversationHeadersOnly=[{"bubbleId": "3", "type": 1}])),
        ("bubbleId:P:1", json.dumps({"type": 1, "text": "<ctx>x</ctx> do it", "createdAt": "2026-04-01T10:00:00Z"})),
        ("bubbleId:P:2", json.dumps({"type": 2, "text": "", "tokenCount": {"inputTokens": 3, "outputTokens": 4}, "toolFormerData": {"toolCallId": "t", "name": "task", "rawArgs": "C", "result": "r", "status": "error"}})),
        ("bubbleId:C:3", json.dumps({"type": 1, "text": "sub"})),
    ]
    db.executemany("INSERT INTO cursorDiskKV VALUES (?, ?)", cells)
    db.commit()
    db.close()
    conversations, messages, calls = composers.read_composers(spark, str(tmp_path))
    c = {r["id"]: r for r in conversations.collect()}
    assert (c["P"]["name"], c["P"]["relationship"], c["P"]["trace_id"]) == ("do it", "root", "P")
    assert (c["C"]["name"], c["C"]["parent_id"], c["C"]["trace_id"], c["C"]["fork_point"]) == ("Child", "P", "P", 1)
    m = messages.where("conversation_id = 'P'").orderBy("sequence").collect()
    assert [(r["role"], r["content"], r["parent_message_id"]) for r in m] == [("user", "<ctx>x</ctx> do it", ""), ("assistant", "[tool:task]", "P:1")]
    assert calls.select("id", "name", "output", "is_error").collect() == [("t", "task", "r", True)]


def test_discovery(spark, tmp_path):
    from convolens.sources import discovery as D

    assert D.allowed(["amp", "cursor", "warp"], ["warp"]) == ["amp", "warp"]
    assert D.default_path([str(tmp_path / "no"), str(tmp_path)], lambda p: False) == str(tmp_path)
    df = spark.createDataFrame([("/a/b",), ("/a/b/c",), ("/a",), ("/a/bc",)], "p string")
    assert [r["p"] for r in df.where(D.related(F.col("p"), "/a/b/")).collect()] == ["/a/b", "/a/b/c", "/a"]
    assert [r["p"] for r in df.where(D.not_own(F.col("p"), "/a/b")).collect()] == ["/a", "/a/bc"]


def test_views(spark, sf_dir):
    from convolens.operators import views
    from convolens.operators.filters import Filters
    from convolens.plans import lens

    s = lens.store(spark, sf_dir)
    found = views.conversation_list(s, Filters(adapter="codex"), 2, 0)
    assert found["rows"].count() == 2 and found["page"].first()["has_more"]
    assert views.trace(s, "c8")["tree"]["id"] == "c8"
    assert views.home(s)["recent"].count() == 6
    assert views.dataset_manifest(s.conversations).first()["traces"] > 0
    assert views.merged_pages(found["rows"], found["rows"]).count() == 2


def test_long_chains_and_circles(spark):
    from convolens.operators import graph as G

    rows = [(f"n{i:03d}", f"n{i - 1:03d}" if i else "", "n000", "root" if i == 0 else "compacted", -1, f"{i:03d}", "") for i in range(20)]
    rows += [("x", "y", "x", "spawned", -1, "1", ""), ("y", "x", "x", "spawned", -1, "2", ""), ("o", "lost", "n000", "spawned", -1, "9", "")]
    c = spark.createDataFrame(rows, "id string, parent_id string, trace_id string, relationship string, fork_point int, started_at string, ended_at string")
    assert {r["id"]: r["depth"] for r in G.trees(c).collect()} == {f"n{i:03d}": i for i in range(20)} | {"x": 0, "y": 1}
    assert {r["id"]: r["top"] for r in G.trace_consistency(c).collect()} == {"x": None, "y": None, "o": "o"}
    m = spark.createDataFrame([(f"m{i}", f"n{i:03d}", 1, 0) for i in range(20)], "id string, conversation_id string, sequence int, turn int")
    assert [r["id"] for r in G.render_order(c, m).orderBy("place").collect()] == [f"m{i}" for i in range(20)]


def test_packed_transcripts_are_read_as_files_are(spark, tmp_path):
    lines = {f"c{i}": [f'{{"thread_id":"c{i}","role":"user","content":"n{k}"}}' if k % 5 else f"no json {k}" for k in range(i % 4 + 2)] for i in range(40)}
    for name, own in lines.items():
        (tmp_path / "files").mkdir(exist_ok=True)
        (tmp_path / "files" / f"{name}.txt").write_text("\n".join(own) + "\n")
    rows = [(f"{n}.txt", k, x) for n, own in lines.items() for k, x in enumerate(own)]
    packed = spark.createDataFrame(rows, "path string, line int, value string").selectExpr("path", "timestamp '2024-01-01' AS modified", "line", "value")
    packed.write.parquet(str(tmp_path / "pack"))
    one, two = TR.read_lines(spark, str(tmp_path / "files"), "*.txt"), TR.packed_lines(spark, str(tmp_path / "pack"))
    said = lambda df: sorted((r["path"].split("/")[-1], r["line"], r["value"]) for r in df.collect())
    assert said(one) == said(two) and sorted(one.columns) == sorted(two.columns)
    tables = [[sorted(map(tuple, t.drop("timestamp", "started_at", "ended_at", "source_path").collect())) for t in TR.read_simple(df, TR.AMP)] for df in (one, two)]
    assert tables[0] == tables[1] and len(tables[0][0]) == 40


def test_files_of_the_adapters_do_not_grow_with_the_conversations(spark, sf_dir):
    m = lens.messages(spark, sf_dir)
    item = F.struct("role", "content")
    for path in (adapters._written(m, F.to_json(item)), adapters._documents(m, item, F.col("conversation_id").alias("id"))):
        files = [p for p in Path(path.removeprefix("file:")).rglob("*") if p.is_file() and not p.name.startswith((".", "_"))]
        assert len(files) <= 4 < m.select("conversation_id").distinct().count()


def _pack(spark, path, rows):
    """A pack of transcripts: (path, line, value) as `packed_lines` reads them."""
    packed = spark.createDataFrame([(p, n, json.dumps(v)) for p, n, v in rows], "path string, line int, value string")
    packed.selectExpr("path", "timestamp '2024-01-01' AS modified", "line", "value").write.parquet(path)
    return path


def test_lines_of_sessions_are_taken_apart_once(spark, tmp_path):
    line = lambda role, uuid, up="", **more: {"type": role, "sessionId": "S", "uuid": uuid, "parentUuid": up, "message": {"role": role, "content": f"by {uuid}", **more}}
    # two files of one session, whose lines have the same numbers
    rows = [("of=a/f.txt", 0, line("user", "u1")), ("of=a/f.txt", 1, line("assistant", "u2", "u1", model="m")), ("of=b/f.txt", 0, line("user", "v1")), ("of=b/f.txt", 1, line("assistant", "v2", "v1"))]
    pack = _pack(spark, str(tmp_path / "pack"), rows)
    tables = TR.read_sessions(TR.packed_lines(spark, pack))
    assert not any(pack in f for t in tables for f in t.inputFiles())
    m = {r["content"]: r for r in tables[1].collect()}
    assert tables[1].count() == 4 and m["by u2"]["model"] == "m"
    assert m["by u2"]["parent_message_id"] == m["by u1"]["id"] and m["by v2"]["parent_message_id"] == m["by v1"]["id"]


def _plan_of_messages(monkeypatch, source, spec):
    """Lines of the optimized plan of what `read_simple` writes, and its messages."""
    plans = []

    def saved(df):
        plans.extend(df._jdf.queryExecution().optimizedPlan().toString().splitlines())
        return df

    monkeypatch.setattr(TR, "saved", saved)
    return plans, TR.read_simple(source, spec)[1]


def test_documents_are_taken_apart_once(spark, tmp_path, monkeypatch):
    rows = [("tool", "x"), ("model", "before"), ("user", "one"), ("user", " "), ("user", "two")]
    whole = {"id": "G", "messages": [{"type": role, "content": [{"text": text}], "model": "m"} for role, text in rows]}
    texts = [("of=g/f.txt", json.dumps(whole)), ("of=h/f.txt", "\n" + json.dumps({**whole, "id": ""})), ("of=i/f.txt", json.dumps([whole])), ("of=j/f.txt", '{"id": "none"}')]
    source = spark.createDataFrame(texts, "path string, value string").selectExpr("path", "timestamp '2024-01-01' AS modified", "value")
    plan, messages = _plan_of_messages(monkeypatch, source, TR.GEMINI)
    # neither a filter parses the rows again nor a row its document
    assert not any("from_json" in x for x in plan if "Filter" in x)
    above = plan[: next(i for i, x in enumerate(plan) if "Generate" in x)]
    assert not any("get_json_object(value" in x for x in above)
    want = [(s, n, role, text, n) for s in ("G", "f") for n, (role, text) in enumerate([("assistant", "before"), ("user", "one"), ("user", "two")])]
    assert [tuple(r) for r in messages.select("conversation_id", "sequence", "role", "content", "turn").orderBy("conversation_id", "sequence").collect()] == want


def _lines_plan(spark, tmp_path, monkeypatch, key, spec):
    rows = [("tool", "x"), ("user", "one"), ("ai", ""), ("ai", "two"), ("user", "three")]
    pack = _pack(spark, str(tmp_path / "pack"), [("of=a/f.txt", n, {"type": role, "content": text, **({key: "A"} if n == 3 else {})}) for n, (role, text) in enumerate(rows)])
    plan, messages = _plan_of_messages(monkeypatch, TR.packed_lines(spark, pack), spec)
    assert [tuple(r) for r in messages.select("conversation_id", "sequence", "content", "turn").orderBy("sequence").collect()] == [("A", 0, "one", 0), ("A", 1, "two", 0), ("A", 2, "three", 1)]
    return plan


def test_contents_of_amp_lines_are_worked_out_once(spark, tmp_path, monkeypatch):
    assert not any("from_json" in x for x in _lines_plan(spark, tmp_path, monkeypatch, "thread_id", TR.AMP) if "Filter" in x)


def test_rows_of_piagent_lines_are_not_moved_with_their_json(spark, tmp_path, monkeypatch):
    plan = _lines_plan(spark, tmp_path, monkeypatch, "sessionId", TR.PIAGENT)
    windows = [i for i, x in enumerate(plan) if x.lstrip("+-: ").startswith("Window")]
    parsed = next(i for i, x in enumerate(plan) if " AS row#" in x)
    # the struct of a row's JSON is used up below the first window
    assert len(windows) == 2 and parsed > max(windows) and not any("row#" in x for x in plan[: max(windows)])


def test_parts_of_amp_contents_are_taken_apart_once(spark, tmp_path, monkeypatch):
    parts = [{"text": " a "}, {"content": [{"text": "b"}, {"text": " "}, {"text": "c"}]}, "plain", {"content": "d"}, {"text": "", "content": " e"}, {"text": None, "content": []}, {"type": "x"}, ["n"], "", None]
    contents = [parts, [], {"content": "held"}, "[no array", [{"text": {"b": 1}}], [{"text": 1}, {"text": "two", "content": "three"}]]
    pack = _pack(spark, str(tmp_path / "pack"), [("of=a/f.txt", n, {"thread_id": "A", "role": "user", "content": c}) for n, c in enumerate(contents)])
    plan, messages = _plan_of_messages(monkeypatch, TR.packed_lines(spark, pack), TR.AMP)
    # a part's text and content, and the text of what lies in that
    assert "".join(plan).count("get_json_object(lambda") == 3
    want = ['a\n\nb\n\nc\n\nplain\n\nd\n\ne\n\n["n"]', "held", "[no array", '{"b":1}', "1\n\ntwo"]
    assert [r["content"] for r in messages.orderBy("sequence").collect()] == want


def test_counters_of_piagent_lines(spark, tmp_path, monkeypatch):
    given = {"": 0, " 7 ": 7, "NaN": 0, "Infinity": 0, "x": 0, "2.9": 2, "-3": 0}
    said = [(k, v) for k, v in given.items()] + [(5, 5), (-0.5, 0), (1e30, 0), (None, 0)]
    pack = _pack(spark, str(tmp_path / "pack"), [("of=a/f.txt", n, {"sessionId": "A", "type": "user", "content": "x", "usage": {"inputTokens": k}}) for n, (k, _) in enumerate(said)])
    plan, messages = _plan_of_messages(monkeypatch, TR.packed_lines(spark, pack), TR.PIAGENT)
    # a counter that isn't there is null, not a blank text whose cast throws
    assert "as double)" in "".join(plan) and ", ) as double)" not in "".join(plan)
    assert [tuple(r) for r in messages.orderBy("sequence").select("input_tokens", "output_tokens").collect()] == [(v, 0) for _, v in said]
