"""The pipeline's stages on their own input, and as a whole."""

import corpus_pipeline as P
import pyarrow as pa
from pyspark.sql import functions as F


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_stages(spark, sf):
    assert [n for n, _ in P.STAGES] == ["language", "lines", "near", "benchmark", "pack"]
    every = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in P.STAGES:
        out = stage(spark, every.limit(0), sf)
        assert out.count() == 0
        if name != "pack":
            assert out.columns == every.columns


def test_language_stage_keeps_what_has_a_language(spark, sf):
    every = spark.read.parquet(f"{sf}/documents.parquet")
    junk = docs(spark, [(-1, None), (-2, ""), (-3, "123 ... 456")])
    kept = {r.doc_id for r in P.known_language(spark, every.unionByName(junk), sf).collect()}
    assert kept == {r.doc_id for r in every.collect()}


def test_near_stage_keeps_one(spark, sf):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(3, text), (1, text + " more"), (2, text), (7, "other words of no group at all"), (7, "other words of no group at all"), (8, None), (9, "")]
    got = sorted((r.doc_id, r.text) for r in P.one_of_each_group(spark, docs(spark, rows), sf).fillna("", ["text"]).collect())
    assert got == [(1, text + " more"), (7, "other words of no group at all"), (8, ""), (9, "")]


def test_benchmark_stage(spark, sf):
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    clean = spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'de'").limit(50)
    given = clean.unionByName(docs(spark, [(-5, f"some words before. {item} and after")]))
    kept = {r.doc_id for r in P.without_benchmark(spark, given, sf).collect()}
    assert -5 not in kept and len(kept) >= 0.9 * clean.count()


def test_run(spark, sf):
    got = P.run(spark, sf)
    full = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert full.where("n <> end or n > 2048").count() == 0
    assert got.count() > 100


def test_stages_take_few_bytes_at_once(spark, sf, monkeypatch):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, empty = spark.conf.get(setting), spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    long = spark.range(0, 2000, 1, 1).select(F.repeat(F.lit("word "), 2000).alias("text"))
    try:
        for _, stage in P.STAGES:
            spark.conf.set(setting, before)
            stage(spark, empty, sf)
            got = [r.n for r in long.mapInArrow(sizes, "n long").collect()]
            assert sum(got) >= 20_000_000 and max(got) < 6_000_000
    finally:
        spark.conf.set(setting, before)
    monkeypatch.setattr(P, "STAGES", P.STAGES[:1])
    P.run(spark, sf)
    assert spark.conf.get(setting) == before
