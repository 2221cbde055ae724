"""The pipeline on the smallest tables: what each stage keeps, against brute force."""

import hashlib

import corpus_pipeline as P
from lattica.llm import common, mixing, quality
from tests.llm.test_near_duplicates import brute_kept
from tests.llm.test_operators import brute_passages


def test_stages(spark, sf, tmp_path):
    common.ship(spark)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    seen = {}
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, sf)
        if k < len(P.STAGES) - 1:
            assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = (before, docs)

    before, after = seen["quality_rules"]
    good = {r["doc_id"] for r in quality.judge(before, spark.read.parquet(f"{sf}/labels.parquet")).where("kept").select("own.doc_id").collect()}
    assert {r["doc_id"] for r in after.collect()} == good

    before, after = seen["near_duplicates"]
    assert sorted(r["doc_id"] for r in after.collect()) == brute_kept({r["doc_id"]: r["text"] for r in before.collect()})

    before, after = seen["repeated_passages"]
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    want = brute_passages(texts, 100)
    for r in after.collect():
        n = len(r["text"].encode())
        assert n <= want[r["doc_id"]][0] - want[r["doc_id"]][1] and r["n_chars"] == len(r["text"])
        if not want[r["doc_id"]][1]:
            assert r["text"] == texts[r["doc_id"]]
    assert after.count() == len(texts)

    before, after = seen["mixed_sources"]
    assert after.count() == mixing.mix(before).agg({"copies": "sum"}).first()[0]

    before, after = seen["encoded"]
    want = sorted((r["doc_id"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in before.collect())
    assert sorted((r["doc_id"], r["decoded_sha256"]) for r in after.collect()) == want


def test_run(spark, sf):
    assert P.run(spark, sf).count() > 0
