"""Components against plain union-find, in one block of edges and in many."""

import random

import pytest

from convolens.llm import components as C
from convolens.llm.common import Scratch


def plain(edges):
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = sorted((find(a), find(b)))
            top[b] = a
    return {x: find(x) for x in list(top)}


@pytest.mark.parametrize("block", [7, 40, 1_000_000])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_components_by_blocks(spark, monkeypatch, block, kind):
    monkeypatch.setattr(C, "BLOCK_EDGES", block)
    rng = random.Random(block)
    edges = [(i, i + 1) for i in range(100, 130)] + [(200, 200 + i) for i in range(1, 60)] + [(-(2**62), 7), (7, 2**62)]
    edges += [(rng.randrange(1000, 1120), rng.randrange(1000, 1120)) for _ in range(60)] + [(101, 100), (101, 100), (5, 5), (None, 6), (6, None)]
    rng.shuffle(edges)
    if kind == "string":
        edges = [tuple(None if x is None else f"n{x}é" for x in e) for e in edges]
    df = spark.createDataFrame(edges, f"a {kind}, b {kind}").repartition(9)
    got = [(r["node"], r["component"]) for r in C.components(df, Scratch(spark, "test")).collect()]
    assert sorted(got) == sorted(plain(edges).items())
