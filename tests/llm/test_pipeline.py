"""The pipeline's stages on planted cases, and on small tables."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_on_small_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    benchmark = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        docs = corpus_pipeline.checkpointed(out)
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(rows) <= set(before) and len(rows) > 0.6 * len(before)
    assert not any(b in t for b in benchmark for t in rows.values())
    assert {"slot", "seat", "block", "on_target"} <= set(docs.columns)


def test_stages_on_odd_rows(spark, sf, tmp_path):
    pick = random.Random(1)
    prose = lambda: " ".join(f"q{pick.randrange(900)}" for _ in range(60))
    same, item = prose(), "In 1995 Maria Lopez drove a car for 120 km from the old harbour to the small station and back again in 3 hours"
    rows = [(1, same, "en", "a", 1), (2, same, "en", "a", 1), (2, same, "en", "a", 1), (3, None, None, None, None), (4, "", "en", "a", 0), (5, prose() + " " + item, "en", "b", 1), (None, prose(), "en", "b", 1), (6, prose(), "en", "b", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    extra = {"score": F.lit(9), "sig": F.lit("s"), "kept": F.lit(None).cast("string"), "block": F.lit(1), "contaminated": F.lit(True), "t": F.lit(2)}
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, schema).withColumns(extra)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
            assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        docs = corpus_pipeline.checkpointed(out)
        if name == "n-gram Jaccard join":
            assert sorted((r["doc_id"] or 0) for r in docs.collect()) == [0, 1, 3, 4, 5, 6]
    got = sorted((r["doc_id"] or 0) for r in docs.collect())
    assert got == [0, 1, 3, 4, 6]
