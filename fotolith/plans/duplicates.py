"""Exact copies: identical bytes and length (D2, C4, D4, E2 for exact copies).

The adapters map driver tables to the domain: a document is a photograph file, its language the job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fotolith.sources.tables import table


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("lang").alias("job_id"), F.col("doc_id").alias("asset_id"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("byte_length"))


def families(a: DataFrame, keys: tuple[str, ...] = ("sha256", "byte_length")) -> DataFrame:
    """One row a family of at least two different ids with the same bytes: canonical (least id), size.
    Rows without bytes have no family. Repeated ids go first, by key and id, so that no task gathers a
    family; counts and minima are combined before the shuffle."""
    one = a.select(*keys, "asset_id").where(F.col(keys[0]).isNotNull()).distinct()
    found = one.groupBy(*keys).agg(F.min("asset_id").alias("canonical_id"), F.count("*").alias("family_size"))
    return found.where("family_size >= 2")


def exact_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = families(assets(spark, sf_dir))
    return f.select("sha256", "byte_length", "canonical_id", "family_size", (F.col("byte_length") * (F.col("family_size") - 1)).alias("wasted_bytes"))


def exact_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy with its family: collapsed to the canonical copy, then attached again."""
    a = assets(spark, sf_dir)
    out = a.join(families(a), ["sha256", "byte_length"])
    return out.select("asset_id", "canonical_id", "family_size", (F.col("asset_id") != F.col("canonical_id")).alias("redundant"))


def duplicate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per job: assets, families that reach it, extra copies, assets without a copy."""
    a = assets(spark, sf_dir)
    m = a.join(families(a), ["sha256", "byte_length"], "left")
    return m.groupBy("job_id").agg(
        F.count("*").alias("assets"),
        F.countDistinct("canonical_id").alias("families"),
        F.count_if(F.col("asset_id") != F.col("canonical_id")).alias("extra_copies"),
        F.count_if(F.col("canonical_id").isNull()).alias("unique_assets"),
    )


QUERIES = {f.__name__: f for f in (exact_families, exact_membership, duplicate_counts)}

_ASSETS = "a AS (SELECT lang AS job_id, doc_id AS asset_id, sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS byte_length FROM documents)"
_FAMILIES = f"{_ASSETS}, f AS (SELECT sha256, byte_length, min(asset_id) AS canonical_id, count(DISTINCT asset_id) AS family_size FROM a WHERE sha256 IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT asset_id) >= 2)"
ORACLE_SQL = {
    "exact_families": f"WITH {_FAMILIES} SELECT *, byte_length * (family_size - 1) AS wasted_bytes FROM f",
    "exact_membership": f"WITH {_FAMILIES} SELECT asset_id, canonical_id, family_size, asset_id <> canonical_id AS redundant FROM a JOIN f USING (sha256, byte_length)",
    "duplicate_counts": f"""WITH {_FAMILIES} SELECT job_id, count(*) AS assets, count(DISTINCT canonical_id) AS families,
        count(*) FILTER (WHERE asset_id <> canonical_id) AS extra_copies, count(*) FILTER (WHERE canonical_id IS NULL) AS unique_assets
        FROM a LEFT JOIN f USING (sha256, byte_length) GROUP BY 1""",
}
