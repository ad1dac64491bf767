"""The pipeline, stage by stage."""

import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, data):
    from moltable.llm import minhash, mixing

    data = f"{data}/../sf0.01"  # the smallest tables have a dozen bad documents
    docs = spark.read.parquet(f"{data}/documents.parquet")
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["quality classifier", "near-duplicate removal", "secret scans", "source mixing", "packing"]
    quality, near, scan, mix, pack = (f for _, f in pipeline.STAGES)
    kept = quality(spark, docs, data)
    labels = spark.read.parquet(f"{data}/labels.parquet")
    good = labels.where("quality = 1").join(docs, "doc_id").count()
    assert kept.columns == docs.columns and kept.join(labels.where("quality = 1"), "doc_id").count() >= 0.99 * good
    assert kept.join(labels.where("quality = 0"), "doc_id").count() <= 0.05 * labels.where("quality = 0").count()
    single = near(spark, docs, data)
    found = minhash.near_duplicates(docs, 0.8)
    assert {r[0] for r in single.select("doc_id").collect()} == {r[0] for r in found.where("kept").select("doc_id").collect()}
    secret = docs.limit(1).withColumn("text", F.lit("x password=abcdefgh123 y"))
    assert [r["text"] for r in scan(spark, secret, data).collect()] == ["x [SECRET] y"]
    assert scan(spark, docs, data).count() == docs.count()
    copies = {r["doc_id"]: r["mix"]["copies"] for r in mixing.mix_sources(docs).collect()}
    mixed = mix(spark, docs, data)
    assert mixed.columns == docs.columns
    assert {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {d: n for d, n in copies.items() if n}
    assert pack(spark, docs, data).agg(F.sum(F.length("ids") / 4 - F.col("length"))).first()[0] == 0


def test_empty_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").where("false")
    for _, step in pipeline.STAGES:
        assert step(spark, docs, data).count() == 0


EXTRA = ["quality", "clean", "secret_spans", "base_spans", "mix", "copy", "size", "row", "text_", "label", "kept", "a.b"]


def test_odd_rows_and_clashing_columns(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    long = " ".join(f"word{i % 911} and line {i}" + "\n" * (i % 7 == 0) for i in range(60_000))
    odd = [(None, "no id but words enough to be read"), (10**6, None), (10**6 + 1, ""), (10**6 + 2, long), (10**6 + 3, "same row"), (10**6 + 3, "same row")]
    rows = spark.createDataFrame([(i, t, "en", None, len(t or "")) for i, t in odd], docs.schema)
    given = docs.unionByName(rows).select("*", *[F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string")).alias(c) for c in EXTRA])
    for name, step in pipeline.STAGES[:-1]:
        out = step(spark, given, data)
        assert out.columns == given.columns and [f.dataType for f in out.schema] == [f.dataType for f in given.schema]
        got = out.collect()
        assert all(r[c] == (None if r["doc_id"] is None else f"{c}-{r['doc_id']}") for r in got for c in EXTRA)
        kept = [r["doc_id"] for r in got if r["doc_id"] is None or r["doc_id"] >= 10**6]
        if name in ("near-duplicate removal", "secret scans"):
            assert sorted(kept, key=str) == sorted((i for i, _ in odd), key=str)
            assert {r["text"] for r in got} >= {None, "", long, "same row"}
        assert kept.count(10**6 + 3) % 2 == 0
    name, step = pipeline.STAGES[-1]
    pieces = step(spark, given, data)
    whole = pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("of"), F.count_if(F.col("start") == 0).alias("rows"))
    assert whole.where("n <> of * rows").isEmpty() and {r["doc_id"] for r in whole.collect()} >= {i for i, _ in odd}
