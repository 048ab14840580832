"""The join on counted keys against a plain join, with hot keys, cold keys and both."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from convolens.llm import common


@pytest.mark.parametrize("hot_keys", [1, 4, 4096])
def test_join_counted(spark, monkeypatch, hot_keys):
    monkeypatch.setattr(common, "HOT_KEYS", hot_keys)
    rows = [(k, i % 2, i) for i in range(300) for k in {0, i % 7, i % 50}] + [(99, 0, 1), (0, 0, 0), (0, 0, 0)]
    left = spark.createDataFrame(rows, "h long, g int, doc_id long").repartition(5)
    scratch = common.Scratch(spark, "test")
    counted = left.groupBy("h", "g").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")
    counted = scratch.table(counted, "counted")
    got = common.join_counted(left, counted, ["h", "g"])
    assert got.columns == ["h", "g", "doc_id", "n", "first"]
    n = Counter((h, g) for h, g, _ in rows)
    first = {}
    for h, g, i in rows:
        first[h, g] = min(i, first.get((h, g), i))
    want = Counter((h, g, i, n[h, g], first[h, g]) for h, g, i in rows if n[h, g] > 1)
    assert Counter(map(tuple, got.collect())) == want
    assert common.join_counted(left.limit(0), counted.limit(0), ["h", "g"]).count() == 0
