"""The registered queries of this subpackage: each applies its operator, with production parameters,
to its whole table, and derives the contract's columns from what the operator returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fotolith.llm import bpe, decontaminate, html_text, jaccard, language, lm, pii, secrets, token_files, topk


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shown(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def number(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.encode_to_files(table(spark, sf_dir, "documents"), vocabulary())


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_spans(table(spark, sf_dir, "documents"))
    counts = [number(F.col("base"), k).alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(shown(F.col("base")), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_spans(table(spark, sf_dir, "documents"))
    counts = [number(F.col("base"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(shown(F.col("base")), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.page_text(table(spark, sf_dir, "pages"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tables with text of unknown language: documents, and pages with their markup and address."""
    documents = table(spark, sf_dir, "documents")
    model = language.fit(documents)
    some = language.document_languages(documents, model).withColumn("page_id", F.lit(None).cast("long"))
    more = language.page_languages(table(spark, sf_dir, "pages"), model).withColumn("doc_id", F.lit(None).cast("long"))
    return some.unionByName(more).select("doc_id", "page_id", "lang", "confidence", "text_lang", "accepted")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), width=4, num=85, den=100)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.bpe_round_trip(table(spark, sf_dir, "documents"), vocabulary())
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_lm_scoring, op3_token_files, op4_personal_data, op5_exact_top_k, op6_secret_scan, op7_html_text, op8_language_id, op9_jaccard_join, op10_bpe)}

ORACLE_SQL = {
    "op5_exact_top_k": """
WITH v AS (
  SELECT vec_id AS id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS c FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.id AS query_id, d.id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.c) + 1), lambda i: q.c[i] * d.c[i])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.id % 20 = 0 AND d.id <> q.id AND len(q.c) = len(d.c)
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
""",
}
