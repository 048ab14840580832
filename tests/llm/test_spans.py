"""Repeated passages of over 50 words are cut wherever they start and whatever stops they have."""

import random

import pytest

from convolens.llm import spans


def other(rng, n):
    return [f"w{rng.randrange(10**9)}" for _ in range(n)]


def passages(rng):
    for n in (51, 60, 140):
        yield "no stops", other(rng, n)
        yield "clause marks", [w + rng.choice(["", "", "", ","]) for w in other(rng, n)]
        at = n // 2
        yield "one whole sentence", [w + ("." if i in (at - 6, at + 6) else "") for i, w in enumerate(other(rng, n))]
        yield "few stops", [w + ("." if rng.random() < 0.06 else "") for w in other(rng, n)]
        yield "one word over and over", ["ha"] * n


def test_every_long_passage_holds_a_run():
    rng = random.Random(9)
    for _ in range(300):
        for kind, own in passages(rng):
            texts = [" ".join([*other(rng, rng.randint(0, 30)), *own, *other(rng, rng.randint(0, 30))]) for _ in range(2)]
            assert "".join(spans.sentences(texts[0])) == texts[0]
            a, b = ({d for *_, d in spans.runs(t)} for t in texts)
            assert a & b, (kind, len(own))


def chars(rng, n):
    return "".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(n))


@pytest.mark.parametrize("stop", ["。", "", "，"])
def test_texts_without_spaces(stop):
    rng = random.Random(4)
    for _ in range(100):
        own = stop.join(chars(rng, rng.randint(5, 20)) for _ in range(9))[:80]
        a, b = (chars(rng, 30) + own + chars(rng, 30) for _ in range(2))
        assert "".join(spans.sentences(a)) == a
        assert {d for *_, d in spans.runs(a)} & {d for *_, d in spans.runs(b)}


def test_unpunctuated_passage_is_cut_once(spark):
    rng = random.Random(2)
    own = other(rng, 70)
    texts = [" ".join([*other(rng, 9 + i), *own, *other(rng, 20)]) for i in range(3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r for r in spans.dedup_substrings(docs).collect()}
    assert out[0]["text"] == texts[0] and out[0]["n_removed"] == 0
    for i in (1, 2):
        left = out[i]["text"].split()
        assert out[i]["n_removed"] > 0 and len(set(left) & set(own)) <= 23
        assert [w for w in texts[i].split() if w not in own] == [w for w in left if w not in own]
