"""Groups: preferred set, representative, references, kinds.

Adapter: an order is a group, its lines the members; quantity gives the score, discount the warmth,
tax the luminance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fotolith.functions.scalars import clamp
from fotolith.sources.tables import table

NEAR_BEST, REFERENCES, WITHIN = 1.0, 3, 2.5


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("group_id"), F.col("l_linenumber").alias("asset_id"), F.col("l_quantity").alias("score"),
        (1 - F.col("l_discount")).alias("confidence"), F.col("l_discount").alias("warm"), (F.col("l_tax") * 2).alias("luminance"), F.col("l_returnflag").alias("kind"),
    )


def preferred_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members within 1.0 of the group's best score."""
    m = members(spark, sf_dir).withColumn("relative", F.max("score").over(Window.partitionBy("group_id")) - F.col("score"))
    return m.where(F.col("relative") <= NEAR_BEST).select("group_id", "asset_id", "relative")


def representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One member a group: the least of (how far from the best, id), as a minimum of a struct."""
    m = members(spark, sf_dir).groupBy("group_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "asset_id")).alias("x"), F.count("*").alias("size"))
    return m.select("group_id", F.col("x.asset_id").alias("asset_id"), "size")


def reference_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most three a group, within 2.5 of its best, by score, confidence, id."""
    w = Window.partitionBy("group_id").orderBy(F.desc("score"), F.desc("confidence"), "asset_id")
    m = members(spark, sf_dir).withColumn("rank", F.row_number().over(w)).withColumn("best", F.max("score").over(Window.partitionBy("group_id")))
    return m.where((F.col("rank") <= REFERENCES) & (F.col("score") >= F.col("best") - WITHIN)).select("group_id", "asset_id", "rank", "score")


def group_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind folded over a group, its least confidence, and whether its luminance spans a bracket."""
    m = members(spark, sf_dir).groupBy("group_id")
    kind = F.when(F.bool_or(F.col("kind") == "R"), "similar").when(F.bool_and(F.col("kind") == "N"), "burst").otherwise("near_duplicate")
    return m.agg(kind.alias("kind"), F.min("confidence").alias("confidence"), ((F.max("luminance") - F.min("luminance")) > 0.12).alias("bracket"))


def focus_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members whose detail is below 0.7 of their group's median."""
    m = members(spark, sf_dir)
    mid = m.groupBy("group_id").agg(F.median("score").alias("mid"))
    return m.join(mid, "group_id").where(F.col("score") < 0.7 * F.col("mid")).select("group_id", "asset_id", "score", "mid")


def scene_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Technical score of a non-portrait: start, bonus, texture, level and clipping, then stars."""
    x = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("group_id"), F.col("l_linenumber").alias("asset_id"), (F.col("l_quantity") / 50).alias("detail"), F.col("l_discount").alias("clip"), (F.col("l_tax") * 100).alias("level"))
    low, clipped = F.col("detail") < 0.2, F.col("clip") > 0.08
    total = F.lit(82.0) + F.when(low, -12).otherwise(7) - F.when(F.col("level") > 3, F.least(F.col("level"), F.lit(6))).otherwise(0) - F.when(clipped, 8).otherwise(0)
    reasons = F.array(F.when(low, "low_texture"), F.when(F.col("level") > 3, "tilted"), F.when(clipped, "clipped"))
    score = F.round(clamp(total, 0, 100), 6)
    return x.select("group_id", "asset_id", score.alias("score"), F.array_join(F.filter(reasons, lambda r: r.isNotNull()), ",").alias("reasons"), F.when(low, 0.55).otherwise(0.72).alias("confidence"))


QUERIES = {f.__name__: f for f in (preferred_members, representatives, reference_candidates, group_kinds, focus_review, scene_scores)}
_M = "m AS (SELECT l_orderkey AS group_id, l_linenumber AS asset_id, l_quantity AS score, 1 - l_discount AS confidence, l_discount AS warm, l_tax * 2 AS luminance, l_returnflag AS kind FROM lineitem)"
ORACLE_SQL = {
    "preferred_members": f"WITH {_M} SELECT group_id, asset_id, max(score) OVER (PARTITION BY group_id) - score AS relative FROM m QUALIFY max(score) OVER (PARTITION BY group_id) - score <= 1.0",
    "representatives": f"WITH {_M} SELECT group_id, asset_id, count(*) OVER (PARTITION BY group_id) AS size FROM m QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY score DESC, asset_id) = 1",
    "reference_candidates": f"WITH {_M}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY group_id ORDER BY score DESC, confidence DESC, asset_id) AS INTEGER) AS rank, max(score) OVER (PARTITION BY group_id) AS best FROM m) SELECT group_id, asset_id, rank, score FROM r WHERE rank <= 3 AND score >= best - 2.5",
    "group_kinds": f"WITH {_M} SELECT group_id, CASE WHEN bool_or(kind = 'R') THEN 'similar' WHEN bool_and(kind = 'N') THEN 'burst' ELSE 'near_duplicate' END AS kind, min(confidence) AS confidence, max(luminance) - min(luminance) > 0.12 AS bracket FROM m GROUP BY 1",
    "focus_review": f"WITH {_M}, d AS (SELECT group_id, median(score) AS mid FROM m GROUP BY 1) SELECT group_id, asset_id, score, mid FROM m JOIN d USING (group_id) WHERE score < 0.7 * mid",
    "scene_scores": """SELECT l_orderkey AS group_id, l_linenumber AS asset_id, round(greatest(0, least(100, 82.0 + CASE WHEN l_quantity / 50 < 0.2 THEN -12 ELSE 7 END - CASE WHEN l_tax * 100 > 3 THEN least(l_tax * 100, 6) ELSE 0 END - CASE WHEN l_discount > 0.08 THEN 8 ELSE 0 END)), 6) AS score,
        concat_ws(',', CASE WHEN l_quantity / 50 < 0.2 THEN 'low_texture' END, CASE WHEN l_tax * 100 > 3 THEN 'tilted' END, CASE WHEN l_discount > 0.08 THEN 'clipped' END) AS reasons,
        CASE WHEN l_quantity / 50 < 0.2 THEN 0.55 ELSE 0.72 END AS confidence FROM lineitem""",
}
