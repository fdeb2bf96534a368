import corpus_pipeline
from pyspark.sql import functions as F

from snapstride.llm import near_dedup, quality
from snapstride.llm.scratch import staged
from test_dedup import line_brute

SF = "/root/testdata/sf0.01"


def test_stages_one_by_one(spark, documents):
    kept = {r.doc_id for r in quality.quality(documents, spark.read.parquet(f"{SF}/labels.parquet")).filter("kept").collect()}
    a = staged(corpus_pipeline.quality_stage(spark, documents, SF), "a")
    assert {r.doc_id for r in a.collect()} == kept

    b = staged(corpus_pipeline.lines_stage(spark, a, SF), "b")
    want = line_brute([(r.doc_id, r.text) for r in a.collect()])
    assert {r.doc_id: r.text for r in b.collect()} == {d: x[0] for d, x in want.items()}
    assert b.filter(F.length("text") != F.col("n_chars")).count() == 0

    c = staged(corpus_pipeline.near_stage(spark, b, SF), "c")
    classes = {r.doc_id: r.class_id for r in near_dedup.near_classes(b).collect()}
    assert sorted(r.doc_id for r in c.collect()) == sorted(set(classes.values()))

    d = staged(corpus_pipeline.mix_stage(spark, c, SF), "d")
    counts = {r.doc_id: r["count"] for r in d.groupBy("doc_id").count().collect()}
    assert set(counts) <= set(classes.values()) and set(counts.values()) <= {1, 2}

    e = corpus_pipeline.pack_stage(spark, d, SF)
    assert e.agg(F.sum("length")).first()[0] == sum(n * counts[i] for i, n in e.select("doc_id", "doc_tokens").distinct().collect())
    assert all(x.columns == documents.columns for x in (a, b, c, d))


def test_repeated_and_missing_ids_in_stages(spark):
    a, b = (" ".join(f"{k}{i}" for i in range(80)) for k in "ab")
    rows = [(1, a), (1, a), (1, b), (2, f"{a} x"), (None, a), (None, b), (None, "c d e"), (3, None), (3, None)]
    df = spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, source string")
    kept = corpus_pipeline.near_stage(spark, df, SF)
    assert sorted(map(str, kept.select("doc_id", "text").collect())) == sorted(map(str, spark.createDataFrame([(1, a), (1, b), (None, "c d e"), (3, None), (3, None)], "doc_id long, text string").collect()))
    twice = spark.createDataFrame([(7, "one two three", "s")] * 40 + [(None, "one two", "t")] * 20, "doc_id long, text string, source string")
    sizes = {r.source: r.n for r in corpus_pipeline.mix_stage(spark, twice, SF).groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()}
    assert sizes["t"] in range(78, 81) or sizes["s"] + sizes["t"] in range(236, 245)


def test_run_on_empty_and_odd_tables(spark, odd, empty, tmp_path):
    for name, df in (("odd", odd), ("empty", empty)):
        path = tmp_path / name
        df.write.parquet(f"file://{path}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"file://{path}/labels.parquet")
        rows = corpus_pipeline.run(spark, f"file://{path}")
        assert (rows.count() > 0) == (name == "odd")
