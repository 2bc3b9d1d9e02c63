"""What is measured of an image's pixels: luminance percentiles, zones and clipping, colour, tone curves
(D12-D14, H19, H25).

Adapter: an order line is a pixel, its supplier the image; discount, tax and quantity are its linear
red, green and blue. All are aggregates that combine before the shuffle; the percentiles come from at
most 4,096 counts an image, however many pixels it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fotolith.functions.scalars import clamp
from fotolith.sources.tables import table

#: Weights of luminance, percentiles, the hues that families of colour are nearest to.
LUMA, PERCENTILES, HUES = (0.2126, 0.7152, 0.0722), (0.01, 0.05, 0.25, 0.50, 0.75, 0.95, 0.99), (0, 30, 60, 120, 180, 240, 275, 315)


def luma(r: Column, g: Column, b: Column) -> Column:
    return r * LUMA[0] + g * LUMA[1] + b * LUMA[2]


def linear_to_srgb(v: Column) -> Column:
    v = clamp(v, 0.0, 1.0)
    return F.when(v <= 0.0031308, v * 12.92).otherwise(F.pow(v, 1 / 2.4) * 1.055 - 0.055)


def srgb_to_linear(v: Column) -> Column:
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, 2.4))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("image_id"), (F.col("l_discount") * 10).alias("r"), (F.col("l_tax") * 12.5).alias("g"), (F.col("l_quantity") / 50).alias("b"))
    return x.withColumn("l", clamp(luma(F.col("r"), F.col("g"), F.col("b")), 0.0, 1.0))


def luminance_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least of 4,096 levels that more pixels reach than floor(q * (n - 1))."""
    bins = pixels(spark, sf_dir).groupBy("image_id", F.floor(F.col("l") * 4095 + 0.5).alias("level")).agg(F.count("*").alias("n"))
    upto = bins.withColumn("sum", F.sum("n").over(Window.partitionBy("image_id").orderBy("level"))).withColumn("all", F.sum("n").over(Window.partitionBy("image_id")))
    each = [F.min(F.when(F.col("sum") > F.floor(F.lit(q) * (F.col("all") - 1)), F.col("level"))) / 4095 for q in PERCENTILES]
    return upto.groupBy("image_id").agg(*[e.alias(f"p{round(q * 100):02d}") for e, q in zip(each, PERCENTILES)])


def luminance_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of shadows, midtones and highlights, of five kinds of clipping, and the mean."""
    l, share = F.col("l"), lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    channel = (F.col("r") >= 0.99) | (F.col("g") >= 0.99) | (F.col("b") >= 0.99)
    parts = {"shadows": l < 0.1, "midtones": (l >= 0.1) & (l < 0.7), "highlights": l >= 0.7, "black_clip": l <= 0.001, "white_clip": l >= 0.99, "near_black": l <= 0.01, "near_white": l >= 0.95, "channel_clip": channel}
    return pixels(spark, sf_dir).groupBy("image_id").agg(*[share(c).alias(n) for n, c in parts.items()], F.avg("l").alias("mean"))


def hue_family(d: list[Column], most: Column, delta: Column, saturation: Column) -> Column:
    """0 to 7 for the nearest of HUES, the first of equals; 8 for what has little saturation."""
    turn = F.when(most == d[0], F.pmod((d[1] - d[2]) / delta, F.lit(6.0))).when(most == d[1], (d[2] - d[0]) / delta + 2).otherwise((d[0] - d[1]) / delta + 4)
    away = F.array(*[F.abs(F.pmod(turn * 60 - h + 180, F.lit(360.0)) - 180) for h in HUES])
    return F.when(saturation < 0.15, 8).otherwise(F.array_position(away, F.array_min(away)) - 1)


def colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean display colour, warmth and tint, chroma, saturation and its bands, shares of families."""
    x = pixels(spark, sf_dir).select("image_id", *[linear_to_srgb(F.col(c)).alias(c) for c in "rgb"])
    x = x.withColumn("most", F.greatest("r", "g", "b")).withColumn("delta", F.col("most") - F.least("r", "g", "b"))
    x = x.withColumn("sat", F.when(F.col("most") > 0, F.col("delta") / F.col("most")).otherwise(0.0))
    x = x.withColumn("family", hue_family([F.col(c) for c in "rgb"], F.col("most"), F.col("delta"), F.col("sat")))
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    means = x.groupBy("image_id").agg(
        *[F.avg(c).alias(c) for c in "rgb"], F.avg("delta").alias("chroma"), F.avg("sat").alias("saturation"), share(F.col("sat") < 0.15).alias("muted"), share(F.col("sat") >= 0.65).alias("vivid"),
        *[share(F.col("family") == k).alias(f"family_{k}") for k in range(9)],
    )
    return means.withColumn("warm", F.col("r") - F.col("b")).withColumn("green", F.col("g") - (F.col("r") + F.col("b")) / 2)


def curve_value(x: Column, points: Column) -> Column:
    """A tone curve of two points or more, in order of x: straight between them, the end pieces go on; a
    curve all of whose points are equal in x and y leaves the value (H25)."""
    i = F.greatest(F.lit(1), F.least(F.size(points) - 1, F.size(F.filter(points, lambda p: p["x"] < x))))
    a, b = F.get(points, i - 1), F.get(points, i)
    return F.when(F.forall(points, lambda p: p["x"] == p["y"]), x).otherwise(a["y"] + (x - a["x"]) * (b["y"] - a["y"]) / (b["x"] - a["x"]))


#: The adapter's curve.
CURVE = ((0.1, 0.0), (0.25, 0.2), (0.75, 0.85), (0.9, 1.0))


def toned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Luminance through a tone curve, back to linear light."""
    points = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in CURVE])
    x = pixels(spark, sf_dir).groupBy("image_id").agg(F.avg("l").alias("mean"), F.min("l").alias("least"))
    return x.select("image_id", *[srgb_to_linear(clamp(curve_value(linear_to_srgb(F.col(c)), points), 0.0, 1.0)).alias(c) for c in ("mean", "least")])


QUERIES = {f.__name__: f for f in (luminance_percentiles, luminance_zones, colours, toned)}
_P = "x AS (SELECT l_suppkey AS image_id, l_discount * 10 AS r, l_tax * 12.5 AS g, l_quantity / 50 AS b FROM lineitem), p AS (SELECT *, greatest(0.0, least(1.0, r * 0.2126 + g * 0.7152 + b * 0.0722)) AS l FROM x)"
_SRGB = "CASE WHEN greatest(0.0, least(1.0, {0})) <= 0.0031308 THEN greatest(0.0, least(1.0, {0})) * 12.92 ELSE pow(greatest(0.0, least(1.0, {0})), 1 / 2.4) * 1.055 - 0.055 END"
_LINE = " ".join(f"WHEN v <= {b[0]} THEN {a[1]} + (v - {a[0]}) * ({b[1]} - {a[1]}) / ({b[0]} - {a[0]})" for a, b in list(zip(CURVE, CURVE[1:]))[:-1])
_TONED = f"least(1.0, greatest(0.0, CASE {_LINE} ELSE 0.85 + (v - 0.75) * (1.0 - 0.85) / (0.9 - 0.75) END))"
ORACLE_SQL = {
    "luminance_percentiles": f"""WITH {_P}, b AS (SELECT image_id, CAST(floor(l * 4095 + 0.5) AS BIGINT) AS level, count(*) AS n FROM p GROUP BY 1, 2),
s AS (SELECT *, sum(n) OVER (PARTITION BY image_id ORDER BY level) AS upto, sum(n) OVER (PARTITION BY image_id) AS total FROM b)
SELECT image_id, {", ".join(f"min(level) FILTER (WHERE upto > floor({q} * (total - 1))) / 4095 AS p{round(q * 100):02d}" for q in PERCENTILES)} FROM s GROUP BY 1""",
    "luminance_zones": f"""WITH {_P} SELECT image_id, {", ".join(f"avg(CASE WHEN {c} THEN 1.0 ELSE 0.0 END) AS {n}" for n, c in (("shadows", "l < 0.1"), ("midtones", "l >= 0.1 AND l < 0.7"), ("highlights", "l >= 0.7"), ("black_clip", "l <= 0.001"), ("white_clip", "l >= 0.99"), ("near_black", "l <= 0.01"), ("near_white", "l >= 0.95"), ("channel_clip", "greatest(r, g, b) >= 0.99")))}, avg(l) AS mean FROM p GROUP BY 1""",
    "colours": f"""WITH {_P}, d AS (SELECT image_id, {", ".join(f"{_SRGB.format(c)} AS {c}" for c in "rgb")} FROM p), m AS (SELECT *, greatest(r, g, b) AS most, greatest(r, g, b) - least(r, g, b) AS delta FROM d),
s AS (SELECT *, CASE WHEN most > 0 THEN delta / most ELSE 0 END AS sat FROM m),
h AS (SELECT *, 60 * CASE WHEN delta = 0 THEN 0 WHEN most = r THEN CASE WHEN g < b THEN (g - b) / delta + 6 ELSE (g - b) / delta END WHEN most = g THEN (b - r) / delta + 2 ELSE (r - g) / delta + 4 END AS hue FROM s),
w AS (SELECT *, CASE WHEN sat < 0.15 THEN 8 ELSE (SELECT arg_min(k, least(abs(hue - c), 360 - abs(hue - c)) + k * 1e-9) FROM (VALUES {", ".join(f"({k}, {c})" for k, c in enumerate(HUES))}) t(k, c)) END AS family FROM h)
SELECT image_id, avg(r) AS r, avg(g) AS g, avg(b) AS b, avg(delta) AS chroma, avg(sat) AS saturation, avg(CASE WHEN sat < 0.15 THEN 1.0 ELSE 0.0 END) AS muted, avg(CASE WHEN sat >= 0.65 THEN 1.0 ELSE 0.0 END) AS vivid,
{", ".join(f"avg(CASE WHEN family = {k} THEN 1.0 ELSE 0.0 END) AS family_{k}" for k in range(9))}, avg(r) - avg(b) AS warm, avg(g) - (avg(r) + avg(b)) / 2 AS green FROM w GROUP BY 1""",
    "toned": f"""WITH {_P}, a AS (SELECT image_id, avg(l) AS mean, min(l) AS least_l FROM p GROUP BY 1), u AS (SELECT image_id, 'mean' AS k, {_SRGB.format("mean")} AS v FROM a UNION ALL SELECT image_id, 'least', {_SRGB.format("least_l")} FROM a),
t AS (SELECT image_id, k, {_TONED} AS v FROM u), f AS (SELECT image_id, k, CASE WHEN v <= 0.04045 THEN v / 12.92 ELSE pow((v + 0.055) / 1.055, 2.4) END AS v FROM t)
SELECT image_id, max(v) FILTER (WHERE k = 'mean') AS mean, max(v) FILTER (WHERE k = 'least') AS least FROM f GROUP BY 1""",
}
