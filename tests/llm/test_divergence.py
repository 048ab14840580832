"""The divergence audit against a plain version in whole numbers, and its SQL."""

import random
import re
from collections import Counter, defaultdict

import pytest

from convolens.llm import divergence
from convolens.llm import queries as registered

from ..compare import connect, differences

COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def rows():
    rng = random.Random(13)
    words = ["ada", "Bel", "été", "ÄB", "日本", "x1y", "dun", "eli", "fro", "gam", "hut", "😀z"]
    out = []
    for i in range(160):
        source = rng.choice(["s1", "s2", "s3", "s4", "hot", "hot", "hot", None])
        lang = rng.choice(["en", "en", "de", None])
        picked = words[: 4 + len(source or "")] if lang == "en" else words[2:]
        out.append((i, " ".join(rng.choice(picked) for _ in range(rng.randint(0, 30))), lang, source))
    return [*out, (900, None, "en", "none"), (901, "", "fr", "a"), (902, "rare", "fr", "b"), (903, "alone", "it", "a"), (904, "ada " * 5000, "en", "s1"), *[(905, "ada bel", "de", "s1")] * 3]


def plain(data, least, top):
    held, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in data:
        lang, source, text = lang or "", source or "", text or ""
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lowered)
        groups.add((lang, source))
        counts[lang, source].update(terms)
        held[lang].update(set(terms))
    out = set()
    for lang, source in groups:
        kept = sorted(t for t, n in held[lang].items() if n >= least)
        shares = {}
        for key in [None, *(s for at, s in groups if at == lang)]:
            n = Counter()
            for at, s in groups:
                if at == lang and key in (None, s):
                    n.update({t: counts[at, s][t] for t in kept})
            total = sum(n.values()) + 5 * len(kept)
            shares[key] = {t: 1 + 10**9 * (n[t] + 5) // total for t in kept}
        own = shares[source]
        apart = [(-sum(abs(own[t] - p[t]) for t in kept), s.encode(), s) for s, p in shares.items() if s not in (None, source)]
        up = [(shares[None][t] - own[t], t.encode(), t) for t in kept if counts[lang, source][t] and own[t] > shares[None][t]]
        for part, found in (("pair", sorted(apart)), ("term", sorted(up)[:top])):
            out |= {(lang, source, part, item, -value, rank) for rank, (value, _, item) in enumerate(found, 1)}
    return out


@pytest.mark.parametrize(("tile", "block", "top"), [(128, 2048, 50), (2, 3, 4), (1, 1, 1)])
def test_audit_equals_a_plain_version(spark, monkeypatch, tile, block, top):
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "BLOCK_TERMS", block)
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows()], "doc_id long, text string, lang string, source string, term string, n int, value int").repartition(3)
    found = divergence.audit_sources(docs, least_docs=3, top=top)
    assert found.columns == COLUMNS
    have = list(map(tuple, found.collect()))
    assert len(have) == len(set(have))
    assert set(have) == plain(rows(), 3, top)
    assert {r[2] for r in have} == {"pair", "term"} and ("fr", "a", "pair", "b", 0, 1) in have


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert divergence.audit_sources(docs).collect() == []


def test_shares_of_large_counts_are_exact(spark):
    data = [(n, n + rest, v) for n in (0, 7, divergence.SMALL, divergence.SMALL + 1, 10**15 + 3) for rest in (0, 11, 10**16) for v in (1, 10**7)]
    found = spark.createDataFrame(data, "n long, total long, v long").select("n", "total", "v", divergence.share("n", "total", "v").alias("p"))
    for r in found.collect():
        assert r.p == 1 + 10**9 * (r.n + 5) // (r.total + 5 * r.v)
    assert spark.sql("SELECT 1L AS n, 0L AS total, 0L AS v").select(divergence.share("n", "total", "v")).first()[0] is None


def test_registered_query_equals_its_sql(spark, sf_dir):
    df = registered.QUERIES["op13_divergence"](spark, sf_dir)
    assert differences(df, connect(sf_dir), registered.ORACLE["op13_divergence"]) == []
