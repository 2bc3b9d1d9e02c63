"""Batch context: light keys and distances, scene evidence, sequences, references, notes, candidates
(B8, C8, C9, D9, D10, H12-H18).

Adapter: an order is a scene and an explicit visual group, its lines the frames; discount gives the
warmth, tax the tint, quantity the median luminance, price the dynamic range; the order's number gives
the photo type. For scene evidence an event is a frame, its user the job, a second a millisecond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fotolith.functions.scalars import clamp, exposure_ev
from fotolith.sources.tables import table

#: Weights of colour, structure, exposure, subject and mixed light by photo type.
LIGHT = {"portrait": (0.30, 0.15, 0.15, 0.30, 0.10), "real_estate": (0.25, 0.20, 0.20, 0.10, 0.25), "landscape": (0.40, 0.25, 0.20, 0.05, 0.10)}
#: Longest gap in milliseconds and least similarity of a scene by photo type.
SCENES = {"portrait": (180_000, 0.94), "real_estate": (900_000, 0.95), "landscape": (1_800_000, 0.96)}
TYPES = ("portrait", "real_estate", "landscape")


def by_type(kind: Column, values: dict[str, float]) -> Column:
    out = F.lit(None)
    for name, v in values.items():
        out = F.when(kind == name, F.lit(v)).otherwise(out)
    return out


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.get(F.array(*map(F.lit, TYPES)), (F.col("l_orderkey") % 3).cast("int"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("group_id"), F.col("l_linenumber").alias("asset_id"), kind.alias("photo_type"), (F.col("l_discount") * 4 - 0.2).alias("warm"), (F.col("l_tax") * 4 - 0.16).alias("tint"),
        (F.col("l_extendedprice") / 100000).alias("range"), (F.col("l_quantity") / 50).alias("median"), (F.col("l_linenumber") / 8).alias("saturation"), F.when(F.col("l_tax") > 0, F.col("l_quantity") / 60).alias("subject"),
        F.when(F.col("l_discount") > 0, F.col("l_discount") * 5).alias("mixed"), F.col("l_discount").alias("highlight"), F.col("l_tax").alias("shadow"), F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("quantity"),
    )


def light_key(warm: Column, tint: Column, span: Column) -> list[Column]:
    """The cell of a frame's light."""
    return [F.round(warm / 0.25).cast("int"), F.round(tint / 0.25).cast("int"), F.round(span / 0.30).cast("int")]


def lighting_distance(a: dict[str, Column], b: dict[str, Column], kind: Column) -> Column:
    """Weighted difference of two frames' light; what either lacks counts a fixed amount."""
    gap = lambda name: F.abs(a[name] - b[name])
    terms = (
        gap("warm") / 0.30 + gap("tint") / 0.30, gap("range") / 0.40 + gap("saturation") / 0.45, F.abs(exposure_ev(a["median"]) - exposure_ev(b["median"])) / 3.0,
        F.coalesce(F.when(a["subject"].isNotNull() & b["subject"].isNotNull(), F.least(F.abs(exposure_ev(a["subject"]) - exposure_ev(b["subject"])) / 2.0, F.lit(2.0))), F.lit(0.25)), F.coalesce(gap("mixed") / 0.50, F.lit(0.15)),
    )
    return sum((t * by_type(kind, {k: w[i] for k, w in LIGHT.items()}) for i, t in enumerate(terms)), F.lit(0.0))


def light_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frame's cell and exposure value, and what its light suggests: backlight from the subject's
    exposure below the frame's, mixed light from the cast's variation (H18)."""
    x = frames(spark, sf_dir)
    a, b, c = light_key(F.col("warm"), F.col("tint"), F.col("range"))
    backlit = clamp(-(exposure_ev(F.col("subject")) - exposure_ev(F.col("median"))) / 3, 0, 1)
    return x.select("group_id", "asset_id", a.alias("warm_cell"), b.alias("tint_cell"), c.alias("range_cell"), F.round(exposure_ev(F.col("median")), 6).alias("ev"), F.round(backlit, 6).alias("backlit"), F.round(clamp(F.col("highlight") / 0.25, 0, 1), 6).alias("mixed"))


NAMES = ("warm", "tint", "range", "saturation", "median", "subject", "mixed")


def light_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frame's distance from the first of its group: one aggregate of a struct, joined back."""
    x = frames(spark, sf_dir)
    first = x.groupBy("group_id").agg(F.min(F.struct("asset_id", *NAMES)).alias("first"))
    x = x.join(first, "group_id")
    d = lighting_distance({n: F.col(n) for n in NAMES}, {n: F.col(f"first.{n}") for n in NAMES}, F.col("photo_type"))
    return x.select("group_id", "asset_id", F.round(d, 6).alias("distance"))


def scene_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours in a job's order of capture: metadata alone says that they are one scene if they are at
    most two seconds apart, of like aspect and orientation, of one camera and no other lens (H12); and
    whether the gap is within the scene limit of the job's photo type (H13)."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), F.col("event_type").alias("camera"), (1.5 + F.floor("value") % 3 * 0.02).alias("aspect"), F.when(F.floor("value") % 2 == 0, F.lit("wide")).alias("lens"), F.when(F.col("value") > 95, "tall").otherwise("wide").alias("orientation"))
    order = Window.partitionBy("job_id").orderBy("at", "event_id")
    before = lambda c: F.lag(c).over(order)
    e = e.select("job_id", "event_id", (F.col("at") - before("at")).alias("gap"), "aspect", "camera", "lens", "orientation", *[before(c).alias(f"{c}_before") for c in ("event_id", "aspect", "camera", "lens", "orientation")]).where("event_id_before is not null")
    lens = F.coalesce(F.col("lens") == F.col("lens_before"), F.lit(True))
    one = (F.abs("gap") <= 2000) & (F.abs(F.col("aspect") / F.col("aspect_before") - 1) <= 0.03) & (F.col("orientation") == F.col("orientation_before")) & (F.col("camera") == F.col("camera_before")) & lens
    kind = F.get(F.array(*map(F.lit, TYPES)), (F.col("job_id") % 3).cast("int"))
    return e.select("job_id", "event_id", "event_id_before", F.when(one, F.lit(0.68)).alias("confidence"), (F.col("gap") <= by_type(kind, {k: v[0] for k, v in SCENES.items()})).alias("within"), by_type(kind, {k: v[1] for k, v in SCENES.items()}).alias("least"))


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind of each explicit group of two or more: a bracket if a member looks like one or, of real
    estate, the exposures span 0.55; else a burst if any member is, else repeated frames (D10)."""
    x = frames(spark, sf_dir).withColumn("ev", exposure_ev(F.col("median")))
    g = x.groupBy("group_id", "photo_type").agg(F.count("*").alias("frames"), F.bool_or(F.col("highlight") >= 0.10).alias("like"), (F.max("ev") - F.min("ev")).alias("span"), F.bool_or(F.col("flag") == "N").alias("burst"))
    bracket = F.col("like") | ((F.col("photo_type") == "real_estate") & (F.col("span") >= 0.55))
    return g.where("frames > 1").select("group_id", "frames", F.when(bracket, "exposure_bracket").when(F.col("burst"), "burst").otherwise("repeated_frames").alias("kind"))


def fit_frames(x: DataFrame) -> DataFrame:
    """Frames fit to be a technical reference: no severe reason, enough score and confidence, little
    clipping; without an assessment (flag A) the clipping gives the score."""
    assessed = F.col("flag") != "A"
    score = F.when(assessed, F.col("quantity") * 2).otherwise(clamp(75 - (F.col("highlight") + F.col("shadow")) * 80, 0, 100))
    x = x.withColumn("score", F.round(score, 6)).withColumn("confidence", F.round(F.when(assessed, 1 - F.col("highlight") * 6).otherwise(F.lit(0.45)), 6)).withColumn("assessed", assessed)
    severe = assessed & (F.col("quantity") < 4)
    return x.where(~severe & (F.col("score") >= 65) & (F.col("confidence") >= 0.45) & (F.col("highlight") <= 0.35) & (F.col("shadow") <= 0.50))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Technical reference candidates."""
    return fit_frames(frames(spark, sf_dir)).select("group_id", "asset_id", "score", "confidence", "assessed")


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frame's scene, its lighting group (the cell within the scene), and its reference: the first
    candidate of the lighting group, else of the scene (C8, C9). Best candidates are minima of a struct."""
    a, b, c = light_key(F.col("warm"), F.col("tint"), F.col("range"))
    x = frames(spark, sf_dir).withColumn("light", F.concat_ws(":", a, b, c))
    best = F.min(F.struct((-F.col("score")).alias("s"), (-F.col("confidence")).alias("c"), "asset_id"))["asset_id"]
    found = fit_frames(x)
    scene, light = found.groupBy("group_id").agg(best.alias("scene_ref")), found.groupBy("group_id", "light").agg(best.alias("light_ref"))
    x = x.select("group_id", "asset_id", "light").join(light, ["group_id", "light"], "left").join(scene, "group_id", "left")
    return x.select("group_id", "asset_id", "light", F.coalesce("light_ref", "scene_ref").alias("reference_id"), F.col("light_ref").isNotNull().alias("by_light"))


def consistency_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frame's deviation from its group's medians (D9) and the ordered notes on it (H17): reference,
    exposure, the two colour axes or neither, bracket, partial evidence."""
    x = frames(spark, sf_dir).withColumn("ev", exposure_ev(F.col("median")))
    mid = x.groupBy("group_id").agg(*[F.median(c).alias(f"mid_{c}") for c in ("ev", "warm", "tint")])
    best = candidates(spark, sf_dir).groupBy("group_id").agg(F.min(F.struct((-F.col("score")).alias("s"), (-F.col("confidence")).alias("c"), "asset_id"))["asset_id"].alias("reference_id"))
    bracket = sequences(spark, sf_dir).where("kind = 'exposure_bracket'").select("group_id", F.lit(True).alias("bracket"))
    x = x.join(mid, "group_id").join(best, "group_id", "left").join(bracket, "group_id", "left")
    ev, warm, tint = (F.round(F.col(c) - F.col(f"mid_{c}"), 6) for c in ("ev", "warm", "tint"))
    off = lambda d, low, high: F.when(d < -0.08, low).when(d > 0.08, high)
    notes = F.array_compact(F.array(
        F.when(F.col("reference_id") == F.col("asset_id"), "exposure_reference"), F.when(ev < -0.30, "darker_than_group").when(ev > 0.30, "brighter_than_group").otherwise("near_exposure_median"),
        off(warm, "cooler_than_group", "warmer_than_group"), off(tint, "more_magenta_than_group", "greener_than_group"), F.when((F.abs(warm) <= 0.08) & (F.abs(tint) <= 0.08), "near_white_balance_median"),
        F.when(F.col("bracket"), "bracket_member"), F.when(F.col("flag") == "A", "partial_evidence"),
    ))
    return x.select("group_id", "asset_id", ev.alias("delta_ev"), warm.alias("delta_warm"), tint.alias("delta_tint"), F.array_join(notes, ",").alias("notes"))


QUERIES = {f.__name__: f for f in (light_keys, light_distances, scene_evidence, sequences, candidates, memberships, consistency_notes)}
_T = "CASE {} % 3 WHEN 0 THEN 'portrait' WHEN 1 THEN 'real_estate' ELSE 'landscape' END"
_F = f"""f AS (SELECT l_orderkey AS group_id, l_linenumber AS asset_id, {_T.format("l_orderkey")} AS photo_type, l_discount * 4 - 0.2 AS warm, l_tax * 4 - 0.16 AS tint, l_extendedprice / 100000 AS range, l_quantity / 50 AS median, l_linenumber / 8 AS saturation,
  CASE WHEN l_tax > 0 THEN l_quantity / 60 END AS subject, CASE WHEN l_discount > 0 THEN l_discount * 5 END AS mixed, l_discount AS highlight, l_tax AS shadow, l_returnflag AS flag, l_quantity AS quantity, log2(l_quantity / 50 + 0.005) AS ev,
  concat_ws(':', CAST(round((l_discount * 4 - 0.2) / 0.25) AS INTEGER), CAST(round((l_tax * 4 - 0.16) / 0.25) AS INTEGER), CAST(round(l_extendedprice / 100000 / 0.30) AS INTEGER)) AS light FROM lineitem)"""
_C = f"""{_F}, y AS (SELECT *, round(CASE WHEN flag <> 'A' THEN quantity * 2 ELSE greatest(0, least(100, 75 - (highlight + shadow) * 80)) END, 6) AS score, round(CASE WHEN flag <> 'A' THEN 1 - highlight * 6 ELSE 0.45 END, 6) AS confidence FROM f),
c AS (SELECT * FROM y WHERE NOT (flag <> 'A' AND quantity < 4) AND score >= 65 AND confidence >= 0.45 AND highlight <= 0.35 AND shadow <= 0.50)"""
_Q = "q AS (SELECT group_id, count(*) AS frames, CASE WHEN bool_or(highlight >= 0.10) OR (any_value(photo_type) = 'real_estate' AND max(ev) - min(ev) >= 0.55) THEN 'exposure_bracket' WHEN bool_or(flag = 'N') THEN 'burst' ELSE 'repeated_frames' END AS kind FROM f GROUP BY 1 HAVING count(*) > 1)"
_W = lambda i: "CASE a.photo_type " + " ".join(f"WHEN '{k}' THEN {w[i]}" for k, w in LIGHT.items()) + " END"
ORACLE_SQL = {
    "light_keys": f"WITH {_F} SELECT group_id, asset_id, CAST(split_part(light, ':', 1) AS INTEGER) AS warm_cell, CAST(split_part(light, ':', 2) AS INTEGER) AS tint_cell, CAST(split_part(light, ':', 3) AS INTEGER) AS range_cell, round(ev, 6) AS ev, CASE WHEN subject IS NOT NULL THEN round(greatest(0, least(1, -(log2(subject + 0.005) - ev) / 3)), 6) ELSE round(greatest(0, least(1, NULL)), 6) END AS backlit, round(greatest(0, least(1, highlight / 0.25)), 6) AS mixed FROM f",
    "light_distances": f"""WITH {_F}, z AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY asset_id, warm, tint, range, saturation, median, subject NULLS FIRST, mixed NULLS FIRST) = 1)
SELECT a.group_id, a.asset_id, round((abs(a.warm - b.warm) / 0.30 + abs(a.tint - b.tint) / 0.30) * {_W(0)} + (abs(a.range - b.range) / 0.40 + abs(a.saturation - b.saturation) / 0.45) * {_W(1)} + abs(a.ev - b.ev) / 3.0 * {_W(2)}
  + CASE WHEN a.subject IS NULL OR b.subject IS NULL THEN 0.25 ELSE least(abs(log2(a.subject + 0.005) - log2(b.subject + 0.005)) / 2.0, 2.0) END * {_W(3)} + coalesce(abs(a.mixed - b.mixed) / 0.50, 0.15) * {_W(4)}, 6) AS distance FROM f a JOIN z b USING (group_id)""",
    "scene_evidence": f"""WITH e AS (SELECT user_id AS job_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, event_type AS camera, 1.5 + floor(value) % 3 * 0.02 AS aspect, CASE WHEN floor(value) % 2 = 0 THEN 'wide' END AS lens, CASE WHEN value > 95 THEN 'tall' ELSE 'wide' END AS orientation FROM events),
p AS (SELECT *, t - lag(t) OVER w AS gap, lag(event_id) OVER w AS event_id_before, lag(aspect) OVER w AS ab, lag(camera) OVER w AS cb, lag(lens) OVER w AS lb, lag(orientation) OVER w AS ob, {_T.format("job_id")} AS photo_type FROM e WINDOW w AS (PARTITION BY job_id ORDER BY t, event_id))
SELECT job_id, event_id, event_id_before, CASE WHEN gap <= 2000 AND abs(aspect / ab - 1) <= 0.03 AND orientation = ob AND camera = cb AND coalesce(lens = lb, true) THEN 0.68 END AS confidence,
  gap <= CASE photo_type WHEN 'portrait' THEN 180000 WHEN 'real_estate' THEN 900000 ELSE 1800000 END AS within, CASE photo_type WHEN 'portrait' THEN 0.94 WHEN 'real_estate' THEN 0.95 ELSE 0.96 END AS least FROM p WHERE event_id_before IS NOT NULL""",
    "sequences": f"WITH {_F}, {_Q} SELECT * FROM q",
    "candidates": f"WITH {_C} SELECT group_id, asset_id, score, round(confidence, 6) AS confidence, flag <> 'A' AS assessed FROM c",
    "memberships": f"""WITH {_C}, k AS (SELECT *, round(confidence, 6) AS rc FROM c), s AS (SELECT group_id, asset_id AS r FROM k QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY score DESC, rc DESC, asset_id) = 1), l AS (SELECT group_id, light, asset_id AS r FROM k QUALIFY row_number() OVER (PARTITION BY group_id, light ORDER BY score DESC, rc DESC, asset_id) = 1)
SELECT f.group_id, f.asset_id, f.light, coalesce(l.r, s.r) AS reference_id, l.r IS NOT NULL AS by_light FROM f LEFT JOIN l ON l.group_id = f.group_id AND l.light = f.light LEFT JOIN s ON s.group_id = f.group_id""",
    "consistency_notes": f"""WITH {_C}, {_Q}, s AS (SELECT group_id, asset_id AS r FROM c QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY score DESC, round(confidence, 6) DESC, asset_id) = 1), m AS (SELECT group_id, median(ev) AS me, median(warm) AS mw, median(tint) AS mt FROM f GROUP BY 1),
d AS (SELECT f.group_id, f.asset_id, round(ev - me, 6) AS delta_ev, round(warm - mw, 6) AS delta_warm, round(tint - mt, 6) AS delta_tint, s.r, q.kind, f.flag FROM f JOIN m USING (group_id) LEFT JOIN s ON s.group_id = f.group_id LEFT JOIN q ON q.group_id = f.group_id)
SELECT group_id, asset_id, delta_ev, delta_warm, delta_tint, concat_ws(',', CASE WHEN r = asset_id THEN 'exposure_reference' END, CASE WHEN delta_ev < -0.30 THEN 'darker_than_group' WHEN delta_ev > 0.30 THEN 'brighter_than_group' ELSE 'near_exposure_median' END,
  CASE WHEN delta_warm < -0.08 THEN 'cooler_than_group' WHEN delta_warm > 0.08 THEN 'warmer_than_group' END, CASE WHEN delta_tint < -0.08 THEN 'more_magenta_than_group' WHEN delta_tint > 0.08 THEN 'greener_than_group' END,
  CASE WHEN abs(delta_warm) <= 0.08 AND abs(delta_tint) <= 0.08 THEN 'near_white_balance_median' END, CASE WHEN kind = 'exposure_bracket' THEN 'bracket_member' END, CASE WHEN flag = 'A' THEN 'partial_evidence' END) AS notes FROM d""",
}
