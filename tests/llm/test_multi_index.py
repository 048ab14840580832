"""Nearest neighbours against brute force over all rows."""

import numpy as np
import pytest

from convolens.llm import multi_index
from convolens.llm import queries as registered

COLUMNS = ["query_id", "rank", "vec_id", "score"]


def product(x, y):
    total = 0.0
    for a, b in zip(x, y):  # sum() would compensate for rounding
        total += a * b
    return total


def brute(rows, k=20, every=20):
    """{query: [(id, score)]} of usable rows."""
    there = {i: np.array(v, np.float32).astype(float) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    out = {}
    for q, x in there.items():
        if q % every == 0:
            scored = sorted((-product(x.tolist(), y.tolist()), i) for i, y in there.items() if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def found(df):
    assert df.columns == COLUMNS
    out = {}
    for q, rank, i, score in sorted(map(tuple, df.collect())):
        out.setdefault(q, []).append((i, score))
        assert rank == len(out[q])
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 3) for i, v in rows], "vec_id long, embedding array<float>, label int, vec string, q int").repartition(3)


def clusters(seed, n, d=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, d))
    return [(i, (centres[rng.integers(12)] * rng.uniform(0.5, 2) + 0.4 * rng.normal(size=d)).astype(np.float32).tolist()) for i in range(n)]


def recall(have, want):
    hits = [len({i for i, _ in have.get(q, [])} & {i for i, _ in near}) for q, near in want.items()]
    return sum(hits) / sum(map(len, want.values()))


def test_small_tables_are_exact(spark):
    """Few rows: the audited budget holds every neighbour of every query."""
    rows = clusters(1, 60)
    rows += [(60, rows[0][1]), (80, rows[0][1]), (100, None), (120, [0.0] * 16), (140, [1.0, None] * 8), (160, [float("nan")] * 16), (180, [float("inf")] * 16), (None, rows[5][1])]
    rows += [(1000 + i, rows[7][1]) for i in range(45)] + [rows[3], rows[3]] + [(-20, rows[8][1]), (200, [1.0, 2.0])]
    have, want = found(multi_index.nearest(frame(spark, rows))), brute(r for r in rows if r[0] != 200)
    assert set(have) == set(want) and -20 in have and 1020 in have
    assert recall(have, want) > 0.97
    for q in have:
        assert len(have[q]) == 20 and have[q] == sorted(have[q], key=lambda x: (-x[1], x[0]))
        exact = dict(want[q])
        assert all(exact[i] == s for i, s in have[q] if i in exact)
    assert have[1020] == want[1020] and [i for i, _ in have[1020]].count(1020) == 0


def test_hot_cells_and_copies_reach_the_recall(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "BLOCK", 16)
    monkeypatch.setattr(multi_index, "PART", 4)
    rng = np.random.default_rng(3)
    base = clusters(2, 900)
    near = (np.array(base[0][1]) + 0.01 * rng.normal(size=(400, 16))).astype(np.float32)
    rows = base + [(2000 + i, v.tolist()) for i, v in enumerate(near)] + [(4000 + i, base[1][1]) for i in range(500)]
    have, want = found(multi_index.nearest(frame(spark, rows))), brute(rows)
    assert set(have) == set(want) and recall(have, want) >= 0.93
    assert all(len(v) == 20 and len({i for i, _ in v}) == 20 for v in have.values())
    assert have[4020] == want[4020]


def test_cells_are_visited_by_falling_sums():
    rng = np.random.default_rng(4)
    index = multi_index.Index(rng.normal(size=(300, 8)), 400)
    cells = index.cells(rng.normal(size=(3000, 8)))
    index.set_sizes(*np.unique(cells, return_counts=True))
    index.sizes_list = index.sizes.tolist()
    for query in rng.normal(size=(20, 8)):
        sums = np.add.outer(*index.halves(query)).ravel()
        for budget in (1, 40, 3000, 9999):
            seen = index.visited(query, budget)
            order = [c for c in np.argsort(-sums) if index.sizes[c]]
            assert seen == order[: len(seen)] and (index.sizes[seen].sum() >= budget or len(seen) == len(order))
            assert index.sizes[seen[:-1]].sum() < budget
        assert index.needed(query, np.array(seen[:1]))[0] == index.sizes[seen[0]]


@pytest.mark.parametrize("rows", [[], [(0, None)], [(1, [1.0, 2.0])]])
def test_no_queries(spark, rows):
    assert multi_index.nearest(frame(spark, rows)).collect() == []


def test_fewer_candidates_than_asked_for(spark):
    rows = [(0, [1.0, 0.5]), (20, [1.0, 0.5]), (3, [-1.0, 0.0]), (4, [0.5, 1.0])]
    assert found(multi_index.nearest(frame(spark, rows))) == brute(rows)
    assert found(multi_index.nearest(frame(spark, [(40, [3.0])]))) == {}
    assert found(multi_index.nearest(frame(spark, [(40, [3.0]), (41, [2.0])]))) == {40: [(41, 6.0)]}


def test_registered_query_reaches_the_recall(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    have, want = found(registered.QUERIES["op11_index"](spark, sf_dir)), brute(rows)
    assert set(have) == set(want) and recall(have, want) >= 0.9
