"""The pipeline's stages keep clean documents and their columns, and act on the others."""

import corpus_pipeline
from fotolith.llm import pii


def test_pipeline(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = {r["doc_id"]: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, sf_dir), name)
        assert docs.columns == list(corpus_pipeline.COLUMNS)
    kept = docs.collect()
    assert len({r["doc_id"] for r in kept}) == len(kept) > 0.6 * len(before)
    assert len({r["text"] for r in kept}) == len(kept)
    clean = pii.personal_spans(docs.select("doc_id", "text")).where("size(base) > 0").count()
    assert clean == 0 and all(r["n_chars"] == len(r["text"]) for r in kept)
    coded = corpus_pipeline.tokens(spark, docs, sf_dir).collect()
    assert len(coded) == len(kept) and all(r["n_tokens"] == len(r["ids"]) > 0 for r in coded)


def test_stages_on_repeated_ids_nulls_and_no_rows(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.where("length(text) > 200").orderBy("doc_id").limit(12).collect()
    odd = [tuple(r) for r in rows] + [tuple(rows[0]), (rows[1]["doc_id"], rows[2]["text"], rows[2]["lang"], "other1", 3), (None, rows[3]["text"], "en", "a1", 1), (10**6, None, None, None, None), (10**6 + 1, "", "en", "a1", 0)]
    df = spark.createDataFrame(odd, docs.schema).withColumn("version", corpus_pipeline.F.lit("clash"))
    known = corpus_pipeline.written(corpus_pipeline.languages(spark, df, sf_dir), "a")
    assert known.count() == len(rows) + 2  # neither the rows without an id, nor those without text
    one = corpus_pipeline.written(corpus_pipeline.near_duplicates(spark, known, sf_dir), "b").collect()
    assert len({r["doc_id"] for r in one}) == len(one) <= len(rows)
    again = corpus_pipeline.near_duplicates(spark, known.repartition(7), sf_dir).collect()
    assert sorted(one) == sorted(again)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), sf_dir).count() == 0, name
