"""The pipeline keeps what it should, stage by stage, on the smallest tables."""

import corpus_pipeline


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    (_, lang), (_, near), (_, clean), (_, mix), (_, shard) = corpus_pipeline.STAGES
    one = lang(spark, docs, sf)
    assert one.columns == columns and one.count() == docs.where("text rlike '\\\\p{L}'").count()
    two = near(spark, one, sf)
    assert two.columns == columns and two.count() <= one.select("text").distinct().count() <= before
    three = clean(spark, two, sf)
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left = three.collect()
    assert three.columns == columns and not any(t in r.text for t in items for r in left)
    four = mix(spark, three, sf)
    assert four.columns == columns
    five = shard(spark, four, sf)
    assert five.count() == four.count() and set(columns) < set(five.columns)


def test_language_stage_uses_the_model(spark):
    """Texts of which nothing is known go; if nothing can be learned, lettered texts stay."""
    texts = ["the cat and the dog", "a cat", "кошка и собака", "cat кошка", "12 !!", "", None]
    known = spark.createDataFrame([(k, t, "en" if k < 9 else None) for k, t in enumerate(texts, 7)], "doc_id long, text string, lang string")
    language = dict(corpus_pipeline.STAGES)["language ID"]
    assert sorted(r.text for r in language(spark, known, "").collect()) == sorted([*texts[:2], texts[3]])
    nothing = known.selectExpr("doc_id", "text", "cast(null as string) as lang")
    left = language(spark, nothing, "")
    assert left.columns == nothing.columns and sorted(r.text for r in left.collect()) == sorted(texts[:4])
