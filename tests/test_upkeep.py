"""Upkeep operators against small plain results."""

import json

from pyspark.sql import functions as F

from convolens.operators import search as FT
from convolens.operators import upkeep as K
from convolens.sources.artifacts import MOST_CHARS, read_artifacts

_SIGNED = "source_path string, ref_id string, signature string"


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_signatures(spark):
    known = spark.createDataFrame([("d1", "a", "1"), ("d1", "b", "1"), ("d1", "gone", "1"), ("d2", "z", "9"), ("d1", "n", None)], _SIGNED)
    found = spark.createDataFrame([("d1", "a", "1"), ("d1", "b", "2"), ("d1", "new", "1"), ("d1", "n", None)], _SIGNED)
    changed, state = K.changed_signatures(known, found)
    assert _rows(changed) == [("d1", "b"), ("d1", "new")]
    assert _rows(state) == sorted([("d1", "a", "1"), ("d1", "b", "2"), ("d1", "new", "1"), ("d1", "n", None), ("d2", "z", "9")], key=str)
    assert K.changed_signatures(known.limit(0), found)[0].count() == 4


def test_hints(spark):
    hints = spark.createDataFrame([("amp", ["b", "a"]), ("amp", ["a", None]), ("pi", None), ("pi", [])], "adapter_id string, paths array<string>")
    assert _rows(K.merged_hints(hints)) == [("amp", ["a", "b"])]


def test_order_and_sizes(spark):
    m = spark.createDataFrame([("c", "1", 0, 0, "é"), ("c", "2", 2, 1, None), ("c", "3", 1, 2, ""), ("d", "4", 0, 0, "x"), ("d", "5", 1, 1, "y")], "conversation_id string, id string, sequence int, at int, content string")
    assert _rows(K.out_of_order(m, "at")) == [("c", 1)]
    calls = spark.createDataFrame([("c", "1", "t", "né")], "conversation_id string, message_id string, id string, name string")
    got = {r["id"]: r["bytes"] for r in K.message_bytes(m, calls).collect()}
    assert got == {"1": 320 + 1 + 2 + 160 + 1 + 3, "2": 321, "3": 321, "4": 322, "5": 322}
    c = spark.createDataFrame([("c", "ab"), ("none", None)], "id string, name string")
    assert _rows(K.conversation_bytes(c, m, calls)) == [("c", 259, 321 * 2 + 487, 487), ("none", 260, 0, 0)]


def test_postings_refresh(spark):
    shape = "conversation_id string, id string, sequence int, content string"
    old = spark.createDataFrame([("c", "1", 0, "A b a"), ("d", "2", 0, "b"), ("e", "3", 0, None)], shape)
    new = spark.createDataFrame([("c", "1", 0, "z"), ("d", "2", 0, "never read"), ("e", "3", 0, "b b")], shape)
    index = K.postings(old)
    assert _rows(index) == [("a", "c", "1", 0, 2, 3), ("b", "c", "1", 0, 1, 3), ("b", "d", "2", 0, 1, 1)]
    got = K.refreshed_postings(index, new, spark.createDataFrame([("c",), ("e",), ("gone",)], "conversation_id string"))
    assert _rows(got.select(*index.columns)) == [("b", "d", "2", 0, 1, 1), ("b", "e", "3", 0, 2, 2), ("z", "c", "1", 0, 1, 1)]


def test_canonical_json(spark):
    df = spark.createDataFrame([('{"b": [1, {"d": "é", "c": null}], "a": true}',), (None,), ("no json",)], "v string")
    got = [r[0] for r in df.select(K.canonical_json(F.col("v"))).collect()]
    assert got == ['{"a":true,"b":[1,{"c":null,"d":"é"}]}', "", "no json"]


def test_versions_and_fingerprint():
    assert K.version_problem("2.1", "2.7") == ""
    assert "newer" in K.version_problem("2.1", "3.0") and "older" in K.version_problem("2.1", "1.9")
    assert "not initialised" in K.version_problem("2.1", None) and "not major.minor" in K.version_problem("2.1", "two") and "local" in K.version_problem("x", "1.0")
    assert K.config_fingerprint("amp", 1) == K.config_fingerprint("amp", 1, True, "  ")
    assert len({K.config_fingerprint("amp", 1), K.config_fingerprint("amp", 2), K.config_fingerprint("amp", 1, False), K.config_fingerprint("amp", 1, True, "/x")}) == 4


def test_artifacts(spark, tmp_path):
    for name, text in {"CLAUDE.md": "remember", "rules/a.md": "x" * (MOST_CHARS + 5), "rules/b.txt": "no", "projects/p1/memory/m.md": "é", "tasks/t1/tasks.json": json.dumps([]), "projects/p1/s.jsonl": "no"}.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")
    got = {r["name"]: r for r in read_artifacts(spark, str(tmp_path)).collect()}
    assert sorted((n, r["kind"], r["scope"]) for n, r in got.items()) == [
        ("CLAUDE.md (global)", "memory", "global"), ("memory (p1)/m.md", "memory", "project"), ("rules (global)/a.md", "rules", "global"), ("tasks/t1", "todo", "session"),
    ]
    assert got["rules (global)/a.md"]["content"] == "x" * MOST_CHARS + "\n...[truncated]"
    assert got["memory (p1)/m.md"]["content"] == "é" and got["memory (p1)/m.md"]["size"] == 2
    assert read_artifacts(spark, str(tmp_path)).where(F.col("content").isNull()).count() == 0


def test_words_are_counted_where_their_message_lies(spark):
    rows = [("c1", "m1", 0, "b a b, Ä a b"), ("c1", "m1", 0, "a z z z z z"), ("c1", "m1", 0, "short"), ("c1", "m2", 1, " .. "), ("c2", "m1", 0, None), ("c3", "m3", 2, "x")]
    messages = spark.createDataFrame(rows, "conversation_id string, id string, sequence int, content string")
    got = {(r["word"], r["conversation_id"], r["id"], r["sequence"], r["dl"]): r["tf"] for r in K.postings(messages).collect()}
    assert got == {("a", "c1", "m1", 0, 6): 4, ("b", "c1", "m1", 0, 6): 3, ("z", "c1", "m1", 0, 6): 5, ("short", "c1", "m1", 0, 1): 1, ("x", "c3", "m3", 2, 1): 1}
    placed = {(r["word"], r["dl"]): list(r["places"]) for r in FT.placed_postings(messages).collect()}
    assert placed["a", 6] == [0, 1, 3, 4] and placed["z", 6] == [1, 2, 3, 4, 5]
    plan = K.postings(messages)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("Exchange")  # words are made above the shuffle, which moves messages
    refreshed = K.refreshed_postings(K.postings(messages), messages, messages.select("conversation_id"))
    assert "Sort [word" not in refreshed._jdf.queryExecution().executedPlan().toString()
