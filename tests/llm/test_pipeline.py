import zlib

from pyspark.sql import functions as F

import corpus_pipeline
from parcelloom.llm.shared import written
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    counts = []
    seen = []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = written(stage(spark, docs, SF))
        counts.append(docs.count())
        seen.append(docs)
        assert docs.columns == (names if n < 4 else ["doc_id", "start", "n_tokens", "ids_crc32"])
    assert counts[0] < 200 and counts[1] < counts[0] and counts[2] <= counts[1] and counts[4] == counts[3]
    rows = [(r["doc_id"], r["text"]) for r in seen[1].collect()]
    groups = brute.jaccard(rows, 5, 80, 100)
    assert all(root == i for i, (_, root, _) in groups.items())  # no two left are near
    from tokenizers import Tokenizer

    import numpy as np
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((r["doc_id"], zlib.crc32(np.array([*t.encode(r["text"], add_special_tokens=False).ids, 2], "<u4").tobytes())) for r in seen[3].collect())
    assert sorted((r["doc_id"], r["ids_crc32"]) for r in seen[4].collect()) == want


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_an_empty_table_goes_through(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF))
        assert docs.count() == 0


def test_odd_rows_go_through_all_stages(spark, tmp_path):
    """Nulls, repeated rows, very long texts and columns with operators' own names."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plain = docs.where("doc_id < 60")
    long = " ".join(r["text"] for r in docs.where("lang = 'en' and n_chars > 300").dropDuplicates(["text"]).orderBy("doc_id").collect())
    assert len(long) > 100_000
    odd = [(None, None, None, None, None)] * 3 + [(10**9, None, None, None, None), (10**9 + 1, "", "en", "x", 0), (10**9 + 2, long, "en", "x", 1), (10**9 + 2, long, "en", "x", 1), (None, long + " end", "en", None, 2)]
    docs = plain.unionByName(spark.createDataFrame(odd, plain.schema))
    for n, name in enumerate(("_h", "_row", "_copies", "block", "c0", "_out", "rows", "text_crc32", "shard")):
        docs = docs.withColumn(name, F.lit(n))
    names = docs.columns
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = written(stage(spark, docs, SF))
        assert docs.columns == (names if n < 4 else ["doc_id", "start", "n_tokens", "ids_crc32"])
        if n == 0:  # only the long texts have words enough
            assert docs.where("doc_id is null").count() == 1 and docs.where(f"doc_id = {10**9 + 2}").count() == 2
    assert docs.count() > 10


def test_stages_keep_rows_without_ids(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (10**9, None, None, None, None), (10**9 + 1, "", "en", "x", 0)], docs.schema)
    docs = docs.limit(20).unionByName(odd)
    for _, stage in corpus_pipeline.STAGES[1:]:
        docs = written(stage(spark, docs, SF))
    assert docs.where("doc_id is null").count() <= 3 and docs.count() > 10
