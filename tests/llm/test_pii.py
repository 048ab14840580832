"""Patterns of personal data on long tokens, and where an address may begin."""

import base64
import random
import re
import time

from pyspark.sql import functions as F

from convolens.llm import pii

PLAIN = r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{2,}".replace("\\\\", "\\")


def test_a_token_of_a_megabyte_is_searched_in_time(spark):
    rng = random.Random(5)
    token = base64.b64encode(rng.randbytes(750_000)).decode()
    dotted = ".".join("ab" for _ in range(300_000))
    docs = spark.createDataFrame([(1, f"x {token} mail ann@example.com"), (3, f"{dotted} 1 bob@example.net")], "doc_id long, text string")
    began = time.perf_counter()
    out = {r.doc_id: r for r in pii.pseudonymize(docs, "k").collect()}
    assert time.perf_counter() - began < 60  # most of it is planning
    assert all(r.n_email == 1 for r in out.values())
    assert "ann@example.com" not in out[1].text and token in out[1].text and dotted in out[3].text and "bob@" not in out[3].text


def test_addresses_begin_where_they_did(spark):
    rng = random.Random(6)
    texts = ["a@b.com1z@y.org", "a@b.com.z@y.org", ".x@y.com", "--a.b@c.de", "a@b@c.com", "...", "é.k@l.io", "a..b@c.org;d@e.fr"]
    texts += ["".join(rng.choice("ab1.-+@ c") + rng.choice(["", "", "com", ".de", "@"]) for _ in range(rng.randint(1, 30))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.regexp_extract_all("t", F.lit(pii.EMAIL), F.lit(0)).alias("found"))
    for r in df.collect():
        assert list(r.found) == re.findall(PLAIN, r.t), r.t
