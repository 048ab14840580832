"""Chats as graphs of blobs, and results matched with calls, against plain versions that read in depth."""

import hashlib
import json
import random
import sqlite3

from convolens.operators import matching
from convolens.sources import chats
from convolens.sources.readers import READERS


def blob_id(name):
    return hashlib.sha256(name.encode()).hexdigest()


def packed(refs, rng):
    """Raw bytes that hold ids behind tags, among bytes that only look like it."""
    out = bytes([0x08, 0x20, 0x01])
    for r in refs:
        out += bytes([0x0A, 0x20]) + bytes.fromhex(r) + bytes(rng.randrange(256) for _ in range(rng.randrange(4)))
    return out + bytes([0x12, 0x20]) + bytes(31)


def in_depth(root, blobs):
    """Parents before a message, references in their order, each blob once."""
    done, out = set(), []

    def visit(name):
        if name in done or name not in blobs:
            return
        done.add(name)
        data = blobs[name]
        if isinstance(data, dict):
            visit(data.get("parentId"))
            out.append(name)
            return
        for i in range(len(data) - 33):
            if data[i] % 8 == 2 and data[i + 1] == 32:
                visit(data[i + 2 : i + 34].hex())

    visit(root)
    return out


def graph(seed):
    """A database of messages with chains of parents, raw blobs with references, copies of them and missing ids."""
    rng = random.Random(seed)
    names = [blob_id(f"{seed}-{i}") for i in range(40)]
    blobs = {}
    for i, name in enumerate(names):
        later = names[i + 1 :] + [blob_id("missing")]
        if rng.random() < 0.55:
            up = rng.choice(later) if rng.random() < 0.7 else None
            blobs[name] = {"role": "user", "content": f"m{i}", **({"parentId": up} if up else {})}
        else:
            blobs[name] = packed([rng.choice(later[:8]) for _ in range(rng.randint(0, 4))], rng)
    return blobs, names[0]


def as_rows(path, blobs):
    return [(path, k, json.dumps(v), None) if isinstance(v, dict) else (path, k, None, v.hex()) for k, v in blobs.items()]


def test_reading_order_of_graphs(spark):
    graphs = {f"db{i}": graph(i) for i in range(25)}
    graphs["chain"] = ({blob_id(f"c{i}"): {"content": "x", **({"parentId": blob_id(f"c{i - 1}")} if i else {})} for i in range(300)}, blob_id("c299"))
    graphs["rootless"] = (graphs["db1"][0], blob_id("nowhere"))
    rng = random.Random(0)
    a, b, c = (blob_id(x) for x in "abc")
    graphs["circle of bytes"] = ({a: packed([b, c], rng), b: packed([a, b], rng), c: {"content": "end", "parentId": b}}, a)
    low, high = sorted((blob_id("x"), blob_id("y")))
    graphs["circle of parents"] = ({low: {"content": "1", "parentId": high}, high: {"content": "2", "parentId": low}}, high)
    rows = [r for path, (blobs, _) in graphs.items() for r in as_rows(path, blobs)]
    blobs = spark.createDataFrame(rows, "path string, id string, raw string, data string").repartition(3)
    roots = spark.createDataFrame([(path, root) for path, (_, root) in graphs.items()], "path string, node string")
    found = {}
    for path, name, _ in sorted(map(tuple, chats.read_order(blobs, roots).collect()), key=lambda r: (r[0], r[2])):
        found.setdefault(path, []).append(name)
    want = {path: in_depth(root, blobs) for path, (blobs, root) in graphs.items()}
    assert found == {path: order for path, order in want.items() if order}
    assert len(found["chain"]) == 300 and "rootless" not in found


def answered_plainly(events):
    """Each result looks for a call from the latest back."""
    calls, out = [], {}
    for place, ord_, kind, call_id, name, output, error in sorted(events):
        if kind == "call":
            calls.append((place, ord_, call_id, name))
            out[place, ord_] = ["", False]
            continue
        scope = [c for c in calls if c[0] == place] or calls
        by_id = [c for c in scope if call_id and c[2] == call_id]
        by_name = [c for c in scope if name and c[3] == name]
        if taken := (by_id or by_name or scope)[-1:]:
            entry = out[taken[0][:2]]
            entry[0], entry[1] = output, entry[1] or error
    return {k: tuple(v) for k, v in out.items()}


def test_results_answer_calls(spark):
    rng = random.Random(2)
    conversations = {}
    for c in range(30):
        events = []
        for place in range(rng.randint(1, 8)):
            for ord_ in range(rng.randint(0, 5)):
                kind = rng.choice(["call", "call", "result"])
                events.append((place, ord_, kind, rng.choice(["", "i1", "i2", "i3"]), rng.choice(["", "grep", "read"]), f"o{place}.{ord_}" if kind == "result" else "", kind == "result" and rng.random() < 0.2))
        conversations[f"c{c}"] = events
    rows = [(c, *e) for c, events in conversations.items() for e in events]
    df = spark.createDataFrame(rows, "conversation_id string, place int, ord int, kind string, call_id string, name string, output string, is_error boolean").repartition(3)
    found = {}
    for r in matching.answered(df).collect():
        found.setdefault(r.conversation_id, {})[r.place, r.ord] = (r.output, r.is_error)
    want = {c: out for c, e in conversations.items() if (out := answered_plainly(e))}
    assert found == want
    assert matching.answered(df.limit(0)).collect() == []


def database(folder, blobs, **head):
    folder.mkdir(parents=True)
    db = sqlite3.connect(folder / "store.db")
    db.execute("CREATE TABLE meta (key TEXT, value TEXT)")
    db.execute("CREATE TABLE blobs (id TEXT, data BLOB)")
    db.execute("INSERT INTO meta VALUES ('0', ?)", [json.dumps(head).encode().hex()])
    db.executemany("INSERT INTO blobs VALUES (?, ?)", [(k, json.dumps(v) if isinstance(v, dict) else v) for k, v in blobs.items()])
    db.commit()
    db.close()


def test_chat_databases(spark, tmp_path):
    rng = random.Random(4)
    u, a, t, e, root = (blob_id(x) for x in ("u", "a", "t", "e", "root"))
    blobs = {
        u: {"role": "user", "content": "[not a list] fix it", "createdAt": "2026-04-01T10:00:00Z"},
        a: {"role": "assistant", "parentId": u, "model": "gpt-4o", "content": [{"type": "reasoning", "text": "hm"}, {"type": "text", "text": "look"}, {"type": "tool-call", "toolName": "grep", "toolCallId": "k", "args": {"q": 1}}, {"type": "tool_use", "name": "read"}]},
        t: {"role": "tool", "parentId": a, "content": [{"type": "tool-result", "toolCallId": "k", "result": "found", "isError": True}, {"type": "tool-result", "toolName": "read", "output": "text"}]},
        e: {"role": "assistant", "parentId": t, "content": "done"},
        root: packed([u, e], rng),
    }
    database(tmp_path / "w" / "s1", blobs, agentId="chat-1", latestRootBlobId=root, name="New Agent", createdAt=1775037600000, model="auto", workspaceUri="file:///home/x%20y")
    database(tmp_path / "w" / "s2", {}, agentId="chat-2", latestRootBlobId=root)
    (tmp_path / "w" / "s3").mkdir()
    (tmp_path / "w" / "s3" / "store.db").write_text("no database")
    conversations, messages, calls = READERS["cursor"](spark, str(tmp_path))
    c = [tuple(r) for r in conversations.select("id", "name", "cwd", "model", "started_at", "ended_at").collect()]
    assert c == [("chat-1", "[not a list] fix it", "/home/x y", "auto", "2026-04-01T10:00:00.000Z", "2026-04-01T10:00:00.000Z")]
    m = messages.orderBy("sequence").collect()
    assert [(r.id, r.role, r.content, r.thinking_content, r.model, r.turn) for r in m] == [(f"chat-1:{u}", "user", "[not a list] fix it", "", "auto", 0), (f"chat-1:{a}", "assistant", "hm\nlook", "hm", "gpt-4o", 0), (f"chat-1:{e}", "assistant", "done", "", "auto", 0)]
    assert [r.parent_message_id for r in m] == ["", m[0].id, m[1].id]
    assert sorted(tuple(r) for r in calls.select("id", "message_id", "name", "input", "output", "is_error").collect()) == [(f"chat-1:{a}:tool:1", m[1].id, "read", "{}", "text", False), ("chat-1:k", m[1].id, "grep", '{"q":1}', "found", True)]
