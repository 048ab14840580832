"""The pipeline's stages in order, each on what the one before it kept, and the registered queries' columns."""

import corpus_pipeline
from convolens.llm import queries as registered


def test_stages(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, left = docs.columns, docs
    kept = [left.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, sf_dir).cache()
        assert left.columns == columns, name
        kept.append(left.count())
    assert kept == sorted(kept, reverse=True) and kept[-1] < kept[0] and kept[-1] > kept[0] / 3
    ids = {r["doc_id"] for r in left.select("doc_id").collect()}
    out = corpus_pipeline.run(spark, sf_dir)
    assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == ids


def test_contract_columns(spark, sf_dir):
    want = {
        "op1_secrets": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
        "op2_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
        "op6_vectors": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
        "op7_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
        "op9_shards": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    }
    for name, columns in want.items():
        assert columns.items() <= dict(registered.QUERIES[name](spark, sf_dir).dtypes).items(), name


def test_oracles(spark, sf_dir):
    from ..compare import connect, differences

    db = connect(sf_dir)
    for name, sql in registered.ORACLE.items():
        assert differences(registered.QUERIES[name](spark, sf_dir), db, sql) == [], name
