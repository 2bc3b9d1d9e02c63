"""Ratings: event-sourced user state over machine ratings, histogram.

Adapter: an event is a rating event of the asset `user_id` (value in steps of 20 gives 1 to 5, an
error clears the rating); an order line's quantity and discount give the machine's score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fotolith.functions.scalars import stars
from fotolith.sources.tables import table


def rating_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    rating = F.when(F.col("event_type") != "error", F.least(F.lit(5), F.floor(F.col("value") / 20) + 1)).cast("int")
    return e.select("event_id", F.col("user_id").alias("asset_id"), rating.alias("user_rating"), F.col("ts").alias("created_at"))


def user_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each asset counts, also when it clears the rating."""
    last = rating_events(spark, sf_dir).groupBy("asset_id").agg(F.max(F.struct("created_at", "event_id", "user_rating")).alias("x"))
    return last.select("asset_id", F.col("x.event_id").alias("event_id"), F.col("x.user_rating").alias("user_rating"))


def assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.col("l_quantity") * 2 - F.col("l_discount") * 100 + 10
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("asset_id")).agg(F.round(F.avg(score), 4).alias("score"), F.max("l_shipdate").alias("analysed_at"))
    return lines.withColumn("ai_rating", stars(F.col("score")))


def effective_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user's rating, else the machine's unless it is stale."""
    stale = F.col("analysed_at") < F.lit("1998-12-01").cast("timestamp")
    a = assessments(spark, sf_dir).join(user_state(spark, sf_dir).select("asset_id", "user_rating"), "asset_id", "left")
    return a.select("asset_id", "score", "user_rating", F.coalesce("user_rating", F.when(~stale, F.col("ai_rating"))).alias("rating"), stale.alias("stale"))


def rating_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of 0 (none) to 5, each with a row."""
    spine = spark.range(6).select(F.col("id").cast("int").alias("rating"))
    found = effective_ratings(spark, sf_dir).groupBy(F.coalesce("rating", F.lit(0)).alias("rating")).agg(F.count("*").alias("assets"))
    return spine.join(found, "rating", "left").select("rating", F.coalesce("assets", F.lit(0)).cast("long").alias("assets"))


QUERIES = {f.__name__: f for f in (user_state, effective_ratings, rating_histogram)}
_E = "e AS (SELECT event_id, user_id AS asset_id, CAST(CASE WHEN event_type <> 'error' THEN least(5, floor(value / 20) + 1) END AS INTEGER) AS user_rating, ts FROM events), u AS (SELECT asset_id, event_id, user_rating FROM e QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY ts DESC, event_id DESC) = 1)"
_R = f"""{_E}, a AS (SELECT l_suppkey AS asset_id, round(avg(l_quantity * 2 - l_discount * 100 + 10), 4) AS score, max(l_shipdate) AS analysed_at FROM lineitem GROUP BY 1),
r AS (SELECT asset_id, score, user_rating, analysed_at < TIMESTAMP '1998-12-01' AS stale,
  coalesce(user_rating, CASE WHEN analysed_at >= TIMESTAMP '1998-12-01' THEN CASE WHEN score < 20 THEN 1 WHEN score < 40 THEN 2 WHEN score < 65 THEN 3 WHEN score < 88 THEN 4 ELSE 5 END END) AS rating FROM a LEFT JOIN u USING (asset_id))"""
ORACLE_SQL = {
    "user_state": f"WITH {_E} SELECT * FROM u",
    "effective_ratings": f"WITH {_R} SELECT asset_id, score, user_rating, rating, stale FROM r",
    "rating_histogram": f"WITH {_R} SELECT CAST(g AS INTEGER) AS rating, count(asset_id) AS assets FROM range(6) t(g) LEFT JOIN r ON coalesce(r.rating, 0) = g GROUP BY 1",
}
