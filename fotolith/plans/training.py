"""Learning: leak-free split, weighted statistics, errors, linear prediction and its fit
(E8, D16-D18, M1, M2, M5, M7).

Adapter: an order line is an example, its order the scene; price is the target.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fotolith.functions.scalars import clamp
from fotolith.sources.tables import table

FEATURES = ("l_quantity", "l_discount", "l_tax")
SHARE = 20


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    weight = F.when(F.col("l_returnflag") == "N", 1.0).when(F.col("l_returnflag") == "A", 0.65).otherwise(0.2)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("scene"), F.col("l_linenumber").alias("example"), *FEATURES, (F.col("l_extendedprice") / 1000).alias("target"), weight.alias("weight"), F.col("l_shipdate"))


def scene_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes of each supplier nation's pool in hash order fill validation up to a share, never the
    last one. Pools bound the window; a single pool would be one task."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("scene"), F.col("o_custkey").alias("pool"))
    n = examples(spark, sf_dir).groupBy("scene").agg(F.count("*").alias("n")).join(o, "scene")
    w = Window.partitionBy("pool")
    order = w.orderBy(F.sha2(F.concat(F.lit("ds"), F.col("scene").cast("string")), 256))
    n = n.withColumn("before", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("rn", F.row_number().over(order))
    need = F.greatest(F.lit(1), F.ceil(F.sum("n").over(w) * SHARE / 100))
    return n.select("pool", "scene", F.when((F.col("before") < need) & (F.col("rn") < F.count("*").over(w)), "validation").otherwise("training").alias("split"))


def feature_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted mean and deviation of each feature, in one aggregate."""
    x = examples(spark, sf_dir)
    stat = x.agg(F.sum("weight").alias("w"), *[F.sum(F.col("weight") * F.col(f)).alias(f"s_{f}") for f in FEATURES], *[F.sum(F.col("weight") * F.col(f) * F.col(f)).alias(f"q_{f}") for f in FEATURES])
    rows = [F.struct(F.lit(f).alias("feature"), F.round(F.col(f"s_{f}") / F.col("w"), 6).alias("mean"), F.round(F.sqrt(F.greatest(F.col(f"q_{f}") / F.col("w") - (F.col(f"s_{f}") / F.col("w")) ** 2, F.lit(1e-6))), 6).alias("scale")) for f in FEATURES]
    return stat.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def predictions(spark: SparkSession, sf_dir: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """A fixed linear rule: missing features have weights of their own, the result is clamped."""
    missing = F.col("l_tax") == 0
    raw = 0.5 + 1.4 * F.col("l_quantity") - 6 * F.col("l_discount") + F.when(missing, -0.25).otherwise(2 * F.col("l_tax"))
    share = F.when(missing, 2 / 3).otherwise(1.0)
    value = clamp(raw, 2, 60)
    confidence = 0.8 * (0.55 + 0.45 * share)
    level = F.when(share < 0.45, "insufficient").when(confidence >= 0.78, "high").when(confidence >= 0.58, "medium").otherwise("low")
    return examples(spark, sf_dir).select("scene", "example", F.round(value, 6).alias("value"), (raw != value).alias("bounded"), level.alias("level"), *carry)


def prediction_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean absolute error of the rule, and of the weighted mean, per split of the scenes."""
    split = scene_split(spark, sf_dir).select("scene", "split")
    p = predictions(spark, sf_dir, carry=("target", "weight")).join(split, "scene")
    return p.groupBy("split").agg(F.round(F.avg(F.abs(F.col("value") - F.col("target"))), 6).alias("mae"), F.count("*").alias("examples"), F.round(F.sum(F.col("weight") * F.col("target")) / F.sum("weight"), 6).alias("mean_target"))


def trained_weights(spark: SparkSession, sf_dir: str, epochs: int = 1200, rate: float = 0.025, decay: float = 0.08) -> DataFrame:
    """Weights by full-batch gradient descent. The gradients need the weighted Gram matrix alone: one
    aggregate, whose size doesn't grow with the rows, then the iteration on the driver."""
    x = examples(spark, sf_dir)
    terms = ["1", *FEATURES]
    col = lambda t: F.lit(1.0) if t == "1" else F.col(t)
    sums = [F.sum(F.col("weight") * col(a) * col(b)).alias(f"g{i}_{j}") for i, a in enumerate(terms) for j, b in enumerate(terms)]
    row = x.agg(*sums, *[F.sum(F.col("weight") * col(a) * F.col("target")).alias(f"y{i}") for i, a in enumerate(terms)]).first()
    n = len(terms)
    w = fit_linear(np.array([[row[f"g{i}_{j}"] or 0.0 for j in range(n)] for i in range(n)]), np.array([row[f"y{i}"] or 0.0 for i in range(n)]), epochs, rate, decay)
    return spark.createDataFrame([(t if t != "1" else "intercept", round(float(v), 6)) for t, v in zip(terms, w)], "term string, weight double")


def fit_linear(gram: np.ndarray, moment: np.ndarray, epochs: int, rate: float, decay: float) -> np.ndarray:
    """Gradient descent on standardised features, from sums; the first term is the intercept, which is
    not decayed. The step falls as 1 / (1 + epoch / 800); weights stay within 5000."""
    total = gram[0, 0]
    if total <= 0:
        return np.zeros(len(moment))
    mean = gram[0] / total
    scale = np.sqrt(np.maximum(np.diag(gram) / total - mean**2, 1e-6))
    mean[0], scale[0] = 0.0, 1.0
    g = (gram / total - np.outer(mean, gram[0] / total) - np.outer(gram[0] / total, mean) + np.outer(mean, mean)) / np.outer(scale, scale)
    y = (moment / total - mean * moment[0] / total) / scale
    w, keep = np.zeros(len(y)), np.r_[0.0, np.ones(len(y) - 1)]
    for epoch in range(epochs):
        w = np.clip(w - rate / (1 + epoch / 800) * (g @ w - y + decay * keep * w), -5000, 5000)
    return w


QUERIES = {f.__name__: f for f in (scene_split, feature_statistics, predictions, prediction_errors, trained_weights)}
_X = "x AS (SELECT l_orderkey AS scene, l_linenumber AS example, l_quantity, l_discount, l_tax, l_extendedprice / 1000 AS target, CASE l_returnflag WHEN 'N' THEN 1.0 WHEN 'A' THEN 0.65 ELSE 0.2 END AS weight FROM lineitem)"
_SPLIT = """n AS (SELECT scene, count(*) AS n FROM x GROUP BY 1), k AS (SELECT scene, n, o_custkey AS pool, sha256('ds' || CAST(scene AS VARCHAR)) AS h FROM n JOIN orders ON o_orderkey = scene),
b AS (SELECT pool, scene, coalesce(sum(n) OVER (PARTITION BY pool ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER (PARTITION BY pool ORDER BY h) AS rn, count(*) OVER (PARTITION BY pool) AS g, greatest(1, ceil(sum(n) OVER (PARTITION BY pool) * 20 / 100.0)) AS need FROM k),
s AS (SELECT pool, scene, CASE WHEN before < need AND rn < g THEN 'validation' ELSE 'training' END AS split FROM b)"""
_P = "r AS (SELECT scene, example, target, weight, 0.5 + 1.4 * l_quantity - 6 * l_discount + CASE WHEN l_tax = 0 THEN -0.25 ELSE 2 * l_tax END AS raw, l_tax = 0 AS missing FROM x), p AS (SELECT *, greatest(2, least(60, raw)) AS value FROM r)"
ORACLE_SQL = {
    "scene_split": f"WITH {_X}, {_SPLIT} SELECT * FROM s",
    "feature_statistics": f"WITH {_X} "
    + " UNION ALL ".join(f"SELECT '{f}' AS feature, round(sum(weight * {f}) / sum(weight), 6) AS mean, round(sqrt(greatest(sum(weight * {f} * {f}) / sum(weight) - (sum(weight * {f}) / sum(weight)) ** 2, 1e-6)), 6) AS scale FROM x" for f in FEATURES),
    "predictions": f"WITH {_X}, {_P} SELECT scene, example, round(value, 6) AS value, raw <> value AS bounded, CASE WHEN missing THEN 'medium' ELSE 'high' END AS level FROM p",
    "prediction_errors": f"WITH {_X}, {_P}, {_SPLIT} SELECT split, round(avg(abs(round(value, 6) - target)), 6) AS mae, count(*) AS examples, round(sum(weight * target) / sum(weight), 6) AS mean_target FROM p JOIN s USING (scene) GROUP BY 1",
}
