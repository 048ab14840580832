"""The registered queries of this subpackage, op1 to op13 and the pipeline, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .alignment import align_tokenizers
from .common import read
from .decontaminate import contamination
from .divergence import audit_sources
from .lines import duplicate_lines
from .multi_index import nearest
from .neighbours import near_vectors
from .packing import pack
from .pii import pseudonymize
from .secrets import scan
from .sharding import shard_by_bytes
from .simhash import near_duplicates
from .spans import dedup_substrings
from .toxicity import score_documents


#: For the registered query only; a real key is passed by the caller.
PSEUDONYM_KEY = "registered-query"


def tokenizer_path() -> str:
    """The vocabulary file that packing uses; on a cluster it lies at the same place on every machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_path() -> str:
    """The vocabulary of pieces that alignment compares with that of packing."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), tokenizer_path())


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_lines(read(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymize(read(spark, sf_dir, "documents").select("doc_id", "text"), key=PSEUDONYM_KEY)


def op6_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(read(spark, sf_dir, "documents"))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(read(spark, sf_dir, "documents"), tokenizer_path(), piece_path())


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_simhash": op2_simhash,
    "op3_packing": op3_packing,
    "op4_lines": op4_lines,
    "op5_pii": op5_pii,
    "op6_vectors": op6_vectors,
    "op7_toxicity": op7_toxicity,
    "op8_decontaminate": op8_decontaminate,
    "op9_shards": op9_shards,
    "op10_substrings": op10_substrings,
    "op11_index": op11_index,
    "op12_alignment": op12_alignment,
    "op13_divergence": op13_divergence,
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_TERMS = _WORDS.replace(r"\x00-\x2F\x3A-\x60", r"\x00-\x40\x5B-\x60")

#: DuckDB SQL; the other queries are compared with plain versions in tests.
ORACLE: dict[str, str] = {
    "op8_decontaminate": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, ws[k:k + 9] AS p FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS k FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT len(p) AS l FROM win),
places AS (SELECT doc_id, ws, l, unnest(range(1, len(ws) - l + 2)) AS k FROM d, sizes WHERE len(ws) >= l),
hits AS (SELECT doc_id, k, l, item_id FROM places JOIN win ON ws[k:k + l - 1] = p),
words AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + l)) AS w FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op13_divergence": f"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_TERMS} AS ws FROM documents),
t AS (SELECT id, lang, source, unnest(ws) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS ln FROM t GROUP BY 1, 2 HAVING count(DISTINCT id) >= 30),
langs AS (SELECT lang, count(*) AS v, sum(ln) AS lt FROM kept GROUP BY 1),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
totals AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY 1, 2),
g AS (SELECT lang, source, coalesce(total, 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN totals USING (lang, source)),
p AS (SELECT lang, source, term, coalesce(n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(n, 0) + 5) // (total + 5 * v) AS p, 1 + 1000000000::HUGEINT * (ln + 5) // (lt + 5 * v) AS q
  FROM g JOIN langs USING (lang) JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
apart AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p AS x JOIN p AS y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3),
pairs AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g AS x JOIN g AS y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN apart AS a ON a.lang = x.lang AND a.source = x.source AND a.item = y.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50""",
}
