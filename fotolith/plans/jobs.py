"""Jobs, assets and warnings: counts, filters, pages, sorts.

Adapter: a customer is a job, an order an asset of it, an event a warning of the job `user_id`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fotolith.functions.scalars import ascii_fold, natural_key, slug
from fotolith.sources.tables import table

CATEGORIES = ("click", "error", "purchase", "signup", "view")


def job_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets and warnings by category of every job: two pre-aggregates, no correlated subqueries."""
    jobs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("job_id"), F.col("c_name").alias("name"))
    assets = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("job_id")).agg(F.count("*").alias("assets"))
    warnings = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("job_id")).agg(*[F.count_if(F.col("event_type") == c).alias(f"n_{c}") for c in CATEGORIES])
    out = jobs.join(assets, "job_id", "left").join(warnings, "job_id", "left")
    return out.fillna(0, ["assets", *[f"n_{c}" for c in CATEGORIES]])


def visible_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without internal jobs; in LIKE each `_` is a wildcard."""
    jobs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("job_id"), F.col("c_name").alias("name"))
    return jobs.where(~F.col("name").like("__stomer%0__"))


def warning_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("category")).agg(F.count("*").alias("warnings"), F.countDistinct("user_id").alias("jobs"))


def job_page(spark: SparkSession, sf_dir: str, offset: int = 40, limit: int = 20) -> DataFrame:
    """One page of jobs, latest first; the limit is held to 1..100."""
    last = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("job_id")).agg(F.max("o_orderdate").alias("updated_at"))
    return last.orderBy(F.desc("updated_at"), "job_id").offset(offset).limit(min(max(limit, 1), 100))


def asset_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sort keys of file names: caseless in ASCII, and natural, with a slug."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("asset_id"), F.concat_ws("_", "p_name", "p_brand", F.col("p_size").cast("string")).alias("filename"))
    return parts.select("asset_id", ascii_fold(F.col("filename")).alias("folded"), natural_key(F.col("filename")).alias("natural"), slug(F.col("filename")).alias("slug"))


def latest_per_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest asset of each job by time, then id: a maximum of a struct, combined before the shuffle."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("job_id")).agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("x"))
    return o.select("job_id", F.col("x.o_orderkey").alias("asset_id"), F.col("x.o_orderdate").alias("updated_at"))


QUERIES = {f.__name__: f for f in (job_counts, visible_jobs, warning_categories, job_page, asset_order, latest_per_job)}
_FILE = "concat_ws('_', p_name, p_brand, CAST(p_size AS VARCHAR))"
ORACLE_SQL = {
    "job_counts": "SELECT c_custkey AS job_id, c_name AS name, coalesce(assets, 0) AS assets, "
    + ", ".join(f"coalesce(n_{c}, 0) AS n_{c}" for c in CATEGORIES)
    + " FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS assets FROM orders GROUP BY 1) a ON o_custkey = c_custkey LEFT JOIN (SELECT user_id, "
    + ", ".join(f"count(*) FILTER (WHERE event_type = '{c}') AS n_{c}" for c in CATEGORIES)
    + " FROM events GROUP BY 1) w ON user_id = c_custkey",
    "visible_jobs": "SELECT c_custkey AS job_id, c_name AS name FROM customer WHERE c_name NOT LIKE '__stomer%0__'",
    "warning_categories": "SELECT event_type AS category, count(*) AS warnings, count(DISTINCT user_id) AS jobs FROM events GROUP BY 1",
    "job_page": "SELECT o_custkey AS job_id, max(o_orderdate) AS updated_at FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20 OFFSET 40",
    "asset_order": f"""SELECT p_partkey AS asset_id, lower({_FILE}) AS folded,
        array_to_string(list_transform(regexp_extract_all(lower({_FILE}), '([0-9]+|[^0-9]+)', 1), lambda r: CASE WHEN regexp_matches(r, '^[0-9]') THEN lpad(CAST(length(ltrim(r, '0')) AS VARCHAR), 4, '0') || ltrim(r, '0') ELSE r END), '') AS "natural",
        substr(regexp_replace(regexp_replace(lower({_FILE}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80) AS slug FROM part""",
    "latest_per_job": "SELECT o_custkey AS job_id, o_orderkey AS asset_id, o_orderdate AS updated_at FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
}
