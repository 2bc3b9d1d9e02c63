"""The corpus pipeline: language, near duplicates, benchmark passages, personal data, tokens.

Each stage takes (spark, documents, sf_dir) and returns a DataFrame; the runner writes it as Parquet
and gives what it reads back to the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fotolith.llm import bpe, decontaminate, jaccard, language, pii
from fotolith.llm.queries import table, vocabulary
from fotolith.llm.shared import written

#: Near duplicates share runs of five words to a similarity of 0.8.
WORDS, SHARE = 5, (80, 100)
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents in no known language; `lang` becomes the language found. Rows with a null
    doc_id are rejected, as later stages can't name them.

    Only the rows that change are joined, by their key and a hash of the row, so that texts aren't
    shuffled as long as these rows are few, and equal keys keep apart.
    """
    version = F.xxhash64("text", "lang", "source")
    found = language.document_languages(docs, version=version, was=F.col("lang"))
    other = ~F.col("accepted") | ~F.col("lang").eqNullSafe(F.col("was"))
    changes = written(found.where(other & F.col("doc_id").isNotNull()).select("doc_id", "version", F.col("lang").alias("_lang"), "accepted").distinct(), "changes")
    both = docs.where("doc_id is not null").withColumn("version", version).join(changes, ["doc_id", "version"], "left")
    return both.where(F.coalesce("accepted", F.lit(True))).withColumn("lang", F.coalesce("_lang", "lang")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the least doc_id; of repeated ids the row whose
    hash is least."""
    groups = jaccard.jaccard_components(docs, WORDS, *SHARE)
    go = written(groups.where("doc_id <> component_id").select("doc_id").distinct(), "copies")
    docs = docs.where("doc_id is not null")
    again = written(docs.select("doc_id", F.xxhash64(*COLUMNS).alias("row")).groupBy("doc_id").agg(F.count("*").alias("rows"), F.min("row").alias("row")).where("rows > 1").drop("rows"), "repeated")
    one = docs.join(go, "doc_id", "left_anti").join(again, "doc_id", "left").where(F.col("row").isNull() | (F.xxhash64(*COLUMNS) == F.col("row"))).select(*COLUMNS)
    if not again.take(1):
        return one
    rows = one.join(again.select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return one.join(again.select("doc_id"), "doc_id", "left_anti").unionByName(rows)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that overlap a benchmark item."""
    found = decontaminate.leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become marks of their kind; n_chars follows."""
    found = pii.personal_spans(docs.select(*COLUMNS), carry=("text", "lang", "source"))
    text = pii.redact(F.col("text"), F.col("spans"))
    return found.withColumn("text", text).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with a checksum of the decoded text."""
    coded = bpe.bpe_round_trip(docs, vocabulary())
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.col("ids").alias("ids"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language_id", languages), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("personal_data", personal_data), ("bpe", tokens)]

#: Language ID, the join and the tokens can't be said in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
