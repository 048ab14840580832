"""Near copies against brute force over all pairs."""

import random
from itertools import combinations

import corpus_pipeline
from convolens.llm import copies, similar, simhash

from .test_operators import closure, prose


def plain_shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def replaced_words(rng, text, n):
    words = text.split(" ")
    for i in rng.sample(range(len(words)), n):
        words[i] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def near_rows():
    rng = random.Random(5)
    texts = [replaced_words(rng, t, n) if n else t for t in (prose(rng, 300) for _ in range(25)) for n in (0, 3, 5, 6, 7, 12)]
    for length in (1, 4, 5, 12, 40):
        one = prose(rng, length)
        texts += [one, one.upper(), one + " more", one + " " + prose(rng, 3)]
    texts += ["", " ", None, "\n", prose(rng, 20_000)]
    texts += [replaced_words(rng, texts[-1], 200), texts[0], texts[0]]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return rows


def similarity(a, b):
    return len(a & b) / len(a | b)


def test_near_copies_equal_brute_force(spark):
    rows = near_rows()
    sets = {i: plain_shingles(t) for i, t in rows}
    pairs = [(a, b) for a, b in combinations(sets, 2) if similarity(sets[a], sets[b]) >= 0.8]
    assert sum(similarity(sets[a], sets[b]) < 0.9 for a, b in pairs) > 30
    root = closure(pairs, sets)
    least = {}
    for i in sets:
        least[root[i]] = min(i, least.get(root[i], i))
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows] + [(None, rows[0][1], 2)], "doc_id long, text string, tk int").repartition(4)
    kept = copies.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {None, *least.values()}
    assert copies.drop_near_copies(docs.limit(0)).count() == 0


def test_large_groups_are_compared_by_chunks(spark, monkeypatch):
    monkeypatch.setattr(similar, "PIECE_ROWS", 4)
    test_near_copies_equal_brute_force(spark)


def test_the_stage_drops_near_copies(spark, sf_dir):
    import corpus_pipeline

    rows = [(i, t) for i, t in near_rows() if i < 6]  # one text with 0 to 12 of its 300 words replaced
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: plain_shingles(t) for i, t in rows}
    assert all(similarity(sets[0], sets[i]) >= 0.8 for i in (1, 2, 3))
    left = {r["doc_id"] for r in corpus_pipeline.simhash_dedup(spark, docs, sf_dir).collect()}
    assert 0 in left and not left & {1, 2, 3}


def test_stage_links_by_prints_and_by_similarity(spark):
    rng, near = random.Random(9), []
    while len(near) < 3:  # prints link, shingles don't; c is a near copy of b and too far from a in both
        a = prose(rng, 60)
        b = replaced_words(rng, a, 3)
        c = replaced_words(rng, b, 1)
        prints, sets = [simhash.fingerprint(t) for t in (a, b, c)], [plain_shingles(t) for t in (a, b, c)]
        bits = lambda i, j: (prints[i] ^ prints[j]).bit_count()  # noqa: B023, E731
        if bits(0, 1) <= 3 and bits(1, 2) > 3 and bits(0, 2) > 3 and similarity(sets[0], sets[1]) < 0.8 and similarity(sets[0], sets[2]) < 0.8 <= similarity(sets[1], sets[2]):
            near.append((a, b, c))
    rows = [(10 * i + k, t) for i, texts in enumerate(near) for k, t in enumerate(texts)] + [(100 + i, prose(rng, 60)) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in copies.drop_near_copies(docs).collect()} > {0, 1, 10, 11, 20, 21}
    assert {r["doc_id"] for r in corpus_pipeline.simhash_dedup(spark, docs, "").collect()} == {0, 10, 20, *range(100, 105)}
