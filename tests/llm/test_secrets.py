"""The secrets network: recall of each family on unseen values, plain strings, parts, long tokens."""

import random
import string
import time

import pytest

from convolens.llm import secrets

FAMILIES = {
    "hex": "0123456789abcdef",
    "base36": string.ascii_lowercase + string.digits,
    "base64": string.ascii_letters + string.digits + "+/",
    "letters": string.ascii_letters,
    "prefixed": string.ascii_letters + string.digits,
}
WORDS = "the river carried small boats past old stone houses while people talked about weather and bread".split()


def value(rng, family):
    n = 22 if family == "hex" else 32  # shorter than the base pattern, so the network must find it
    return ("ghp_" if family == "prefixed" else "") + "".join(rng.choice(FAMILIES[family]) for _ in range(n))


def plain(rng):
    uuid = "-".join("".join(rng.choice("0123456789abcdef") for _ in range(k)) for k in (8, 4, 4, 4, 12))
    words = [rng.choice(WORDS) for _ in range(4)]
    return rng.choice([uuid, f"www.{words[0]}{rng.randint(1, 99)}.example.com/{words[1]}/{words[2]}", "-".join(words) + f"-{rng.randint(1, 2000)}.html", "".join(w.title() for w in words) + "2"])


@pytest.fixture(scope="module")
def found(spark):
    rng, rows = random.Random(11), []
    prose = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randint(5, 30)))
    for i in range(60 * len(FAMILIES)):
        rows.append((i, f"{prose()} {value(rng, list(FAMILIES)[i % len(FAMILIES)])} {prose()}"))
    for i in range(1000, 1200):
        rows.append((i, f"{prose()} {plain(rng)} {prose()}"))
    for i in range(2000, 2060):
        rows.append((i, f"{prose()} password: {value(rng, 'base64')} {prose()}"))
    got = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    return {r.doc_id: r for r in got}


@pytest.mark.parametrize("family", FAMILIES)
def test_each_family_is_found_in_prose(found, family):
    mine = [found[i].n_cnn for i in range(60 * len(FAMILIES)) if list(FAMILIES)[i % len(FAMILIES)] == family]
    assert len(mine) == 60 and sum(n > 0 for n in mine) >= 58


def test_plain_strings_are_left_alone(found):
    assert sum(found[i].n_cnn > 0 for i in range(1000, 1200)) <= 6


def test_values_of_assignments_are_windowed_behind_their_word():
    text = 'so "api_key" = "Zk3TmX0vB7yLp2" ends'
    ((a, kind, b),) = secrets.base_spans(text)
    at = secrets.value_start(text, a, kind)
    window = secrets.windows(text, at, b)[0]
    assert text[at:b] == "Zk3TmX0vB7yLp2" and "api_key" in window[: secrets.BEFORE] and "api_key" not in window[secrets.BEFORE :]
    assert secrets.value_start("x AKIA", 2, "access") == 2


def test_equal_values_share_a_part_and_families_are_measured():
    made, labels = secrets.made_findings([], 3000)
    around = ["left side of the text ".rjust(secrets.BEFORE)[-secrets.BEFORE :] + w[secrets.BEFORE :] for w in made]
    assert [secrets._part(w) for w in made] == [secrets._part(w) for w in around]
    net = secrets.train(made, labels)
    assert set(net.families) == {*secrets.SECRETS, *secrets.PLAIN}
    assert min(net.families[f] for f in secrets.SECRETS) >= 0.95 and max(net.families[f] for f in secrets.PLAIN) <= 0.05
    assert net.recall >= 0.97 and net.precision >= 0.97


@pytest.mark.parametrize("token", ["a" * 1_000_000, "aB" * 500_000, "a1" * 500_000, "password=" + "x" * 1_000_000, "a-" * 500_000, "A" * 15 + "b" * 999_985])
def test_long_tokens_take_time_in_proportion(token):
    began = time.perf_counter()
    base = secrets.base_spans(token)
    found = secrets.candidates(token, base)
    [secrets._PLAIN.fullmatch(token, a, b) for a, b in found]
    assert time.perf_counter() - began < 5 and all(e <= len(token) for _, e in found)


def test_candidates():
    assert secrets.candidates("short1 onlysmalllettersinarow UPPERCASEONLYLETTERS x", []) == []
    text = "QwErTyUiOpAsDfGhJk and abcdefgh12345678"
    assert secrets.candidates(text, []) == [(0, 18), (23, 39)]
    assert secrets.candidates(text, [(10, "hex", 12)]) == [(23, 39)] and secrets.candidates(text, [(38, "hex", 45), (0, "hex", 1)]) == []


def test_all_labelled_findings_are_learnt_from(spark):
    rng = random.Random(3)
    prose = lambda: " ".join(rng.choice(WORDS) for _ in range(12))
    texts = [f"{prose()} password: {value(rng, 'base64')} {prose()} {plain(rng)}1 {prose()}" for _ in range(300)]
    found = secrets._found(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text")
    net = secrets.fit(found, labelled=150)  # in several tasks, each with a part
    labelled = found.selectExpr("explode(found) AS x").where("x.kind != 'cnn' OR x.plain").selectExpr("x.windows[0]").distinct().count()
    assert net.findings == labelled > 300
    assert net.recall >= 0.95 and min(net.families[f] for f in secrets.SECRETS) >= 0.93 and max(net.families[f] for f in secrets.PLAIN) <= 0.07
    again = secrets.fit(found.repartition(3), labelled=150)
    assert again.threshold == net.threshold and (again.conv == net.conv).all()
