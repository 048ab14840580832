"""The engine's postings and its discovery cache."""

import json

import pytest
from pyspark.sql import functions as F

from convolens.operators import search as FT
from convolens.streaming import ingest
from convolens.streaming.ingest import Engine

from .test_ingest import bundle, files

TERMS = [
    FT.Terms(all_of=("alpha",)),
    FT.Terms(all_of=("alpha beta",), none_of=("gamma",)),
    FT.Terms(any_of=("be*", "delta")),
    FT.Terms(all_of=("alpha",), any_of=("beta ga*",)),
    FT.Terms(near=(("alpha", "delta", 1),)),
    FT.Terms(none_of=("alpha",)),
    FT.Terms(all_of=("missing",)),
    FT.Terms(all_of=("!!",)),
]


def store(spark, tmp_path, texts):
    engine = Engine(spark, f"file://{tmp_path}/store", clock=lambda: "now", buckets=2)
    put(spark, engine, texts)
    return engine


def put(spark, engine, texts):
    c, m, t = bundle(spark, list(texts), "amp")
    said = spark.createDataFrame(list(texts.items()), "conversation_id string, said string")
    m = m.join(said, "conversation_id").withColumn("content", F.col("said")).select(m.columns)
    return engine.write(c, m, t)


TEXTS = {"a": "Alpha beta gamma", "b": "alpha, alpha beta", "c": "delta Älpha", "d": "", "e": "beta gamma delta " * 3, "f": "alpha x delta"}


def ranks(df):
    return [(r.message_id, r.conversation_id, round(r["rank"], 9)) for r in df.collect()]


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    out = store(spark, tmp_path_factory.mktemp("index"), {"a": "old words", **{k: v for k, v in TEXTS.items() if k not in "af"}})
    assert out.index() == 5 and out.index() == 0
    assert put(spark, out, TEXTS) == 2 and out.index() == 2
    return out


@pytest.mark.parametrize("terms", TERMS, ids=range(len(TERMS)))
def test_ranks_equal_a_scan_of_all_messages(engine, terms):
    s = engine.store()
    assert ranks(engine.search(terms)) == ranks(FT.search(s.messages, s.conversations, terms))
    assert ranks(engine.search(terms, adapter="amp", since="2025", limit=1)) == ranks(FT.search(s.messages, s.conversations, terms, "amp", "2025", 1))
    assert ranks(engine.search(terms, adapter="codex")) == []


def test_words_of_a_changed_conversation_go(engine):
    assert ranks(engine.search(FT.Terms(all_of=("old",)))) == []


def test_an_empty_store_is_searched(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/none", buckets=2)
    assert engine.index() == 0 and ranks(engine.search(FT.Terms(all_of=("alpha",)))) == []


def test_files_read_are_bounded_by_the_terms(spark, tmp_path):
    texts = {f"c{i}": " ".join(f"w{i * 40 + j}" for j in range(40)) + " common" for i in range(20)}
    engine = store(spark, tmp_path, texts)
    engine.index()
    index = engine.tables.read("postings")
    every = {f for f in files(tmp_path) if "/postings/" in f}
    read = lambda words: {r[0] for r in index.where(F.col("part").isin([FT.part_of(F.lit(w)) for w in words])).select(F.input_file_name()).distinct().collect()}
    assert len(every) == 2 * FT.PARTS and len(read(["w5"])) <= 2 and len(read(["w5", "w6", "w7"])) <= 6
    plan = engine.search(FT.Terms(all_of=("w5",)))._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan parquet" in line and "places" in line)
    assert "PartitionFilters: [(part#" in scan and "In(word" in scan or "EqualTo(word" in scan
    assert ranks(engine.search(FT.Terms(all_of=("w5",))))[0][1] == "c0" and len(ranks(engine.search(FT.Terms(all_of=("common",)), limit=None))) == 20


def test_other_settings_read_all_files_again(spark, tmp_path, monkeypatch):
    folder = tmp_path / "amp"
    folder.mkdir()
    for i in range(3):
        (folder / f"{i}.jsonl").write_text(json.dumps({"thread_id": f"T{i}", "role": "user", "content": "x", "timestamp": "2026-04-01T10:00:00Z"}) + "\n")
    engine = Engine(spark, f"file://{tmp_path}/store", clock=lambda: "now", buckets=2)
    read, reader = [], ingest.READERS["amp"]
    monkeypatch.setitem(ingest.READERS, "amp", lambda s, paths: read.append(len(paths)) or reader(s, paths))
    assert engine.ingest("amp", str(folder)) == 3 and engine.ingest("amp", str(folder)) == 0
    assert read == [3]  # equal settings read nothing
    assert engine.ingest("amp", str(folder), allow_protected=True) == 0 and read == [3, 3]
    assert engine.ingest("amp", str(folder), allow_protected=True) == 0 and read == [3, 3]
    monkeypatch.setattr(ingest, "PAYLOAD_VERSION", 2)
    assert engine.ingest("amp", str(folder), allow_protected=True) == 0 and read == [3, 3, 3]
    assert engine.tables.read("sources").count() == 3 and engine.store().conversations.count() == 3
