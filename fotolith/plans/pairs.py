"""Training pairs: validation, eligibility, loss, guidance, versions, faces out of focus, calibrations
(B9, C16, D24, E9, E11, H10, H19, M6, M8, M10).

Adapter: an order line is a pair, its columns the measures of source and reference; an order is a face
group; a part is a lens calibration.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fotolith.functions.scalars import slug
from fotolith.plans.training import ORACLE_SQL as _TRAINING
from fotolith.plans.training import prediction_errors
from fotolith.sources.tables import table

#: What each photo type weighs.
WEIGHTS = {"portrait": {"blink": 32.0, "soft_face": 24.0, "framing": 6.0, "clipping": 10.0, "detail": 0.0, "level": 0.0}, "real_estate": {"blink": 0.0, "soft_face": 0.0, "framing": 0.0, "clipping": 14.0, "detail": 8.0, "level": 3.0}, "landscape": {"blink": 0.0, "soft_face": 0.0, "framing": 0.0, "clipping": 10.0, "detail": 4.0, "level": 2.0}}


def to_linear(v: Column) -> Column:
    """An sRGB value as linear light."""
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, 2.4))


def to_srgb(v: Column) -> Column:
    """Linear light as an sRGB value."""
    return F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(v, 1 / 2.4) - 0.055)


def luma(r: Column, g: Column, b: Column) -> Column:
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def geometry(aspect: Column, other: Column) -> Column:
    """How two frames' shapes relate (M8)."""
    delta = F.abs(F.log(aspect / other))
    return F.when(delta <= 0.025, "exact_or_near").when(delta <= 0.35, "crop_difference").otherwise("major_mismatch")


def status(shape: Column, structure: Column) -> Column:
    """What becomes of a pair with such shapes and such a correlation of their structure (M8)."""
    return F.when((shape == "major_mismatch") | (structure < 0.22), "rejected").when((shape == "crop_difference") | (structure < 0.52), "needs_review").otherwise("ready")


def total_loss(lum: Column, color: Column, saturation: Column, structure: Column) -> Column:
    """The weighted loss of a rendering."""
    return 0.48 * lum + 0.22 * color + 0.12 * saturation + 0.18 * structure


def guidance(count: Column) -> Column:
    """What a number of training pairs is good for."""
    return F.when(count <= 9, "experimental, at least 10").when(count <= 19, "experimental, more varied").when(count <= 50, "reasonable").otherwise("broader")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("dataset_id"), F.col("l_orderkey").alias("scene"), F.col("l_linenumber").alias("pair"), (1 + F.col("l_quantity") / 50).alias("aspect"), (F.col("l_discount") * 10).alias("structure"), F.col("l_tax").alias("tax"), F.col("l_returnflag").alias("flag"))
    return x.withColumn("geometry", geometry(F.col("aspect"), F.lit(1.5))).withColumn("status", status(F.col("geometry"), F.col("structure")))


def pair_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).groupBy("dataset_id", "geometry", "status").agg(F.count("*").alias("pairs"))


def dataset_guidance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of each dataset that may train, neither rejected nor excluded (flag R) and with a target of
    enough confidence (B9), and what so many are good for."""
    fit = (F.col("status") != "rejected") & (F.col("flag") != "R") & (F.col("tax") > 0)
    x = pairs(spark, sf_dir).groupBy("dataset_id").agg(F.count_if(fit).alias("eligible"), F.count("*").alias("pairs"))
    return x.withColumn("guidance", guidance(F.col("eligible")))


def render_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss of each line as a rendering against the first colours of its order: quantiles, balance of the
    mean colours, saturation and structure."""
    x = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("scene"), F.col("l_linenumber").alias("pair"), (F.col("l_quantity") / 100).alias("q50"), F.col("l_discount").alias("r"), F.col("l_tax").alias("g"), (F.col("l_extendedprice") / 200000).alias("b"))
    first = x.groupBy("scene").agg(F.min(F.struct("pair", "q50", "r", "g", "b")).alias("ref"))
    x = x.join(first, "scene")
    sums = F.greatest(F.col("r") + F.col("g") + F.col("b"), F.lit(1e-6)), F.greatest(F.col("ref.r") + F.col("ref.g") + F.col("ref.b"), F.lit(1e-6))
    half = F.abs(F.col("q50") - F.col("ref.q50"))
    lum = (half / 2 + half * 1.5 + half / 2) / 3.5
    color = sum((F.abs(F.col(c) / sums[0] - F.col(f"ref.{c}") / sums[1]) for c in "rgb"), F.lit(0.0)) / 3
    bright = lambda p: luma(*[to_linear(F.col(p + c)) for c in "rgb"])
    loss = total_loss(lum, color, F.abs(F.col("r") - F.col("ref.r")), F.abs(bright("") - bright("ref.")))
    return x.select("scene", "pair", F.round(loss, 6).alias("loss"), F.round(to_srgb(bright("")), 6).alias("luma"))


def soft_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces of an image far less sharp than its upper median, of those measured reliably; the spread and
    the softest (E9). An image's faces are few, so they are gathered into one array."""
    faces = table(spark, sf_dir, "lineitem").where("l_discount <= 0.08").select(F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("face"), (F.col("l_quantity") / 50).alias("sharpness"))
    x = faces.groupBy("image").agg(F.array_sort(F.collect_list(F.struct("sharpness", "face"))).alias("f")).where(F.size("f") > 1)
    mid = F.get("f", F.floor(F.size("f") / 2).cast("int"))["sharpness"]
    out = F.filter("f", lambda v: (mid > 0.05) & (v["sharpness"] < mid * 0.45))
    return x.select("image", F.array_join(F.array_sort(F.transform(out, lambda v: v["face"])).cast("array<string>"), ",").alias("outliers"), F.round(F.get("f", F.size("f") - 1)["sharpness"] - F.get("f", F.lit(0))["sharpness"], 6).alias("spread"), F.get("f", F.lit(0))["face"].alias("softest"))


def next_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next version of each style: one more than the greatest of its folders' numbers."""
    p = table(spark, sf_dir, "part").select(slug(F.col("p_name")).alias("style"), F.concat(slug(F.col("p_name")), F.when(F.col("p_size") % 5 == 0, F.lit("-draft")).otherwise(F.concat(F.lit("-v"), F.col("p_size").cast("string")))).alias("folder"))
    number = F.when(F.startswith("folder", F.concat("style", F.lit("-v"))), F.expr("try_cast(substring(folder, length(style) + 3) as int)"))
    return p.groupBy("style").agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("version"))


def overfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the validation error is far above the training error (M6)."""
    e = prediction_errors(spark, sf_dir).groupBy().agg(F.max(F.when(F.col("split") == "training", F.col("mae"))).alias("training"), F.max(F.when(F.col("split") == "validation", F.col("mae"))).alias("validation"))
    return e.select("training", "validation", ((F.col("validation") > 0) & (F.col("validation") > F.col("training") * 1.8 + 0.05)).alias("overfit"))


def calibrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibration of each shot: focal length within 0.05 and aperture within 0.06, if all matches agree
    (C16). A band join on cells of the focal length, each calibration in its own and both next cells."""
    shots = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("shot"), F.col("l_linenumber").alias("frame"), F.col("l_quantity").alias("focal"), (F.col("l_tax") * 100).alias("aperture"))
    lens = table(spark, sf_dir, "part").select((F.col("p_size") + F.col("p_partkey") % 3 * 0.04).alias("at"), (F.col("p_partkey") % 9).cast("double").alias("opening"), F.col("p_brand").alias("model"))
    lens = lens.groupBy("at", "opening").agg(F.min("model").alias("low"), F.max("model").alias("high"))  # what agrees is known before the join
    cells = lens.withColumn("cell", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor("at") + d)))
    met = shots.withColumn("cell", F.floor("focal")).join(cells, "cell").where((F.abs(F.col("at") - F.col("focal")) < 0.05) & (F.abs(F.col("opening") - F.col("aperture")) < 0.06))
    one = met.groupBy("shot", "frame", "focal", "aperture").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.count("*").alias("matches"))
    return one.where("low = high").select("shot", "frame", "focal", F.round("aperture", 6).alias("aperture"), F.col("low").alias("model")).distinct()


def type_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The photo types' weights as a dimension."""
    rows = [F.struct(F.lit(t).alias("photo_type"), *[F.lit(v).alias(k) for k, v in w.items()]) for t, w in WEIGHTS.items()]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("x")).select("x.*")


QUERIES = {f.__name__: f for f in (pair_validation, dataset_guidance, render_loss, soft_faces, next_versions, overfit, calibrations, type_weights)}
_P = """p AS (SELECT l_suppkey AS dataset_id, l_tax AS tax, l_returnflag AS flag, l_discount * 10 AS structure, abs(ln((1 + l_quantity / 50) / 1.5)) AS d FROM lineitem),
g AS (SELECT *, CASE WHEN d <= 0.025 THEN 'exact_or_near' WHEN d <= 0.35 THEN 'crop_difference' ELSE 'major_mismatch' END AS geometry FROM p),
s AS (SELECT *, CASE WHEN geometry = 'major_mismatch' OR structure < 0.22 THEN 'rejected' WHEN geometry = 'crop_difference' OR structure < 0.52 THEN 'needs_review' ELSE 'ready' END AS status FROM g)"""
_LIN = lambda c: f"CASE WHEN {c} <= 0.04045 THEN {c} / 12.92 ELSE pow(({c} + 0.055) / 1.055, 2.4) END"
_LUMA = lambda p: f"(0.2126 * {_LIN(p + 'r')} + 0.7152 * {_LIN(p + 'g')} + 0.0722 * {_LIN(p + 'b')})"
_SLUG = "coalesce(nullif(substr(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80), ''), 'style')"
ORACLE_SQL = {
    "pair_validation": f"WITH {_P} SELECT dataset_id, geometry, status, count(*) AS pairs FROM s GROUP BY 1, 2, 3",
    "dataset_guidance": f"WITH {_P}, c AS (SELECT dataset_id, count(*) FILTER (WHERE status <> 'rejected' AND flag <> 'R' AND tax > 0) AS eligible, count(*) AS pairs FROM s GROUP BY 1) SELECT *, CASE WHEN eligible <= 9 THEN 'experimental, at least 10' WHEN eligible <= 19 THEN 'experimental, more varied' WHEN eligible <= 50 THEN 'reasonable' ELSE 'broader' END AS guidance FROM c",
    "render_loss": f"""WITH x AS (SELECT l_orderkey AS scene, l_linenumber AS pair, l_quantity / 100 AS q50, l_discount AS r, l_tax AS g, l_extendedprice / 200000 AS b FROM lineitem), f AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY scene ORDER BY pair, q50, r, g, b) = 1)
SELECT x.scene, x.pair, round(0.48 * (abs(x.q50 - f.q50) / 2 + abs(x.q50 - f.q50) * 1.5 + abs(x.q50 - f.q50) / 2) / 3.5
  + 0.22 * ({" + ".join(f"abs(x.{c} / greatest(x.r + x.g + x.b, 1e-6) - f.{c} / greatest(f.r + f.g + f.b, 1e-6))" for c in "rgb")}) / 3 + 0.12 * abs(x.r - f.r) + 0.18 * abs({_LUMA("x.")} - {_LUMA("f.")}), 6) AS loss,
  round(CASE WHEN {_LUMA("x.")} <= 0.0031308 THEN {_LUMA("x.")} * 12.92 ELSE 1.055 * pow({_LUMA("x.")}, 1 / 2.4) - 0.055 END, 6) AS luma FROM x JOIN f USING (scene)""",
    "soft_faces": """WITH f AS (SELECT l_orderkey AS image, l_linenumber AS face, l_quantity / 50 AS s FROM lineitem WHERE l_discount <= 0.08), n AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY s, face) - 1 AS k, count(*) OVER (PARTITION BY image) AS n FROM f), m AS (SELECT image, s AS mid FROM n WHERE k = n // 2 AND n > 1)
SELECT image, coalesce(string_agg(CAST(face AS VARCHAR), ',' ORDER BY face) FILTER (WHERE mid > 0.05 AND s < mid * 0.45), '') AS outliers, round(max(s) - min(s), 6) AS spread, min(face) FILTER (WHERE k = 0) AS softest FROM n JOIN m USING (image) GROUP BY image""",
    "next_versions": f"WITH p AS (SELECT {_SLUG} AS style, CASE WHEN p_size % 5 <> 0 THEN p_size END AS v FROM part) SELECT style, coalesce(max(v), 0) + 1 AS version FROM p GROUP BY 1",
    "overfit": f"WITH e AS ({_TRAINING['prediction_errors']}), o AS (SELECT max(mae) FILTER (WHERE split = 'training') AS training, max(mae) FILTER (WHERE split = 'validation') AS validation FROM e) SELECT *, validation > 0 AND validation > training * 1.8 + 0.05 AS overfit FROM o",
    "calibrations": """WITH s AS (SELECT l_orderkey AS shot, l_linenumber AS frame, l_quantity AS focal, l_tax * 100 AS aperture FROM lineitem), l AS (SELECT p_size + p_partkey % 3 * 0.04 AS at_, CAST(p_partkey % 9 AS DOUBLE) AS opening, min(p_brand) AS low, max(p_brand) AS high FROM part GROUP BY 1, 2)
SELECT shot, frame, focal, round(aperture, 6) AS aperture, min(low) AS model FROM s JOIN l ON abs(at_ - focal) < 0.05 AND abs(opening - aperture) < 0.06 GROUP BY shot, frame, focal, aperture HAVING min(low) = max(high)""",
    "type_weights": " UNION ALL ".join(f"SELECT '{t}' AS photo_type, " + ", ".join(f"CAST({v} AS DOUBLE) AS {k}" for k, v in w.items()) for t, w in WEIGHTS.items()),
}
