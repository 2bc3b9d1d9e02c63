"""Look-alikes: the pair classifier as a column expression, and greedy anchor groups by it (H7, C5, F4, F8
and of H6 the comparison of hashes).

Adapter: the first 64 components of a vector, scaled to 0.4..0.6, are an 8 x 8 luminance grid; half of the
first 48, scaled to 0..1, the colour grid; every eighth component sets a byte of the difference hash; the
label is the job, `vec_id` in seconds the capture time (none for every 11th), its remainders the rest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fotolith.functions.scalars import clamp, hamming64
from fotolith.sources.tables import table

#: Fixed values. Anchors that a new frame is held against, newest first, and members of a group.
ANCHORS, MEMBERS = 64, 32
#: Fixed values of the classifier: what any match, a burst and a near duplicate may differ by.
ASPECT, CONTRAST, APART = 0.03, 0.008, 8
ANY = {"hash": 14, "shape": 0.075, "color": 0.20}
BURST = {"hash": 10, "shape": 0.055}
NEAR = {"hash": 3, "shape": 0.02, "color": 0.04}
CONFIDENCE = {"burst": 0.9, "near_duplicate": 0.7, "similar": 0.5}


def descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("job_id"), F.col("vec_id").alias("asset_id"), F.slice(F.col("embedding").cast("array<double>"), 1, 64).alias("v"))
    e = e.withColumn("scaled", F.transform("v", lambda x: (x - F.array_min("v")) / (F.array_max("v") - F.array_min("v"))))
    hexed = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.when(F.get("scaled", i * 8) > 0.5, "ff").otherwise("00")), "")
    i = F.col("asset_id")
    return e.select(
        "job_id", "asset_id", F.transform("scaled", lambda x: 0.4 + 0.2 * x).alias("grid"), F.transform(F.slice("scaled", 1, 48), lambda x: x / 2).alias("color"), hexed.alias("hash"),
        (1.5 + F.when(i % 4 == 0, 0.06).otherwise(0.0)).alias("aspect"), F.when(i % 11 != 0, i).alias("taken"), F.when(i % 3 != 0, i % 2).alias("camera"),
    )


def mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def contrast(a: Column) -> Column:
    return mean(F.transform(a, lambda x: F.abs(x - mean(a))))


def shape_distance(a: Column, b: Column) -> Column:
    """Mean difference of two grids, each less its own mean."""
    return mean(F.zip_with(F.transform(a, lambda x: x - mean(a)), F.transform(b, lambda x: x - mean(b)), lambda p, q: F.abs(p - q)))


def classified(pairs: DataFrame) -> DataFrame:
    """With kind, score and confidence of the pair (columns of either side end in _a and _b); only pairs
    that match. Flat frames match nothing: a flat hash proves no relationship."""
    c = lambda name, side: F.col(f"{name}_{side}")
    p = pairs.where(F.abs(c("aspect", "a") / c("aspect", "b") - 1) <= ASPECT).withColumn("h", hamming64(c("hash", "a"), c("hash", "b"))).where(F.col("h") <= ANY["hash"])
    p = p.withColumn("shape", shape_distance(c("grid", "a"), c("grid", "b"))).withColumn("hue", mean(F.zip_with(c("color", "a"), c("color", "b"), lambda x, y: F.abs(x - y))))
    p = p.where((F.least(contrast(c("grid", "a")), contrast(c("grid", "b"))) >= CONTRAST) & (F.col("shape") <= ANY["shape"]) & (F.col("hue") <= ANY["color"]))
    close, same = F.abs(c("taken", "a") - c("taken", "b")) <= APART, c("camera", "a") == c("camera", "b")
    burst = F.coalesce(close & same, F.lit(False)) & (F.col("h") <= BURST["hash"]) & (F.col("shape") <= BURST["shape"])
    near = (F.col("h") <= NEAR["hash"]) & (F.col("shape") <= NEAR["shape"]) & (F.col("hue") <= NEAR["color"]) & F.coalesce(close, F.lit(True)) & F.coalesce(same, F.lit(True))
    p = p.withColumn("kind", F.when(burst, "burst").when(near, "near_duplicate").otherwise("similar"))
    confidence = F.when(F.col("kind") == "burst", CONFIDENCE["burst"]).when(F.col("kind") == "near_duplicate", CONFIDENCE["near_duplicate"]).otherwise(CONFIDENCE["similar"])
    return p.withColumn("score", clamp(1 - (F.col("h") / 64 + F.col("shape") + F.col("hue")) / 3, 0.0, 1.0)).withColumn("confidence", confidence)


def lookalike_pairs(spark: SparkSession, sf_dir: str, places: int = 8) -> DataFrame:
    """Matches among the frames of a job that are at most so many places apart (matches further apart are
    those of the anchor groups): a band join. Places are cut into cells as wide as the band, each frame
    meets its own and the next cell, so the join is on equal keys and no job's frames are all paired."""
    d = descriptors(spark, sf_dir)
    left = d.select(*(F.col(c).alias(f"{c}_a") for c in d.columns)).withColumn("cell", F.floor(F.col("asset_id_a") / places))
    right = d.select(*(F.col(c).alias(f"{c}_b") for c in d.columns)).withColumn("cell", F.explode(F.array(F.floor(F.col("asset_id_b") / places), F.floor(F.col("asset_id_b") / places) - 1)))
    pairs = left.join(right.withColumnRenamed("job_id_b", "job_id_a"), ["job_id_a", "cell"]).where(f"asset_id_b > asset_id_a and asset_id_b - asset_id_a <= {places}")
    return classified(pairs).select(F.col("job_id_a").alias("job_id"), F.col("asset_id_a").alias("a"), F.col("asset_id_b").alias("b"), F.col("h").cast("int").alias("hash_bits"), F.round("shape", 6).alias("shape"), F.round("hue", 6).alias("color"), "kind", F.round("score", 6).alias("score"), "confidence")


class Anchors:
    """The newest anchors of a job: all that its next frame depends on."""

    def __init__(self):
        self.ids: list = []
        self.sizes = np.zeros(0, int)
        self.data: dict[str, np.ndarray] = {}

    def kinds(self, f: dict) -> np.ndarray:
        """What the frame is to each anchor: 0 nothing, 1 similar, 2 near, 3 burst."""
        d = self.data
        bits = np.bitwise_count(d["hash"] ^ f["hash"])
        shape, hue = np.abs(d["flat"] - f["flat"]).mean(axis=1), np.abs(d["color"] - f["color"]).mean(axis=1)
        ok = (np.abs(d["aspect"] / f["aspect"] - 1) <= ASPECT) & (np.minimum(d["contrast"], f["contrast"]) >= CONTRAST) & (bits <= ANY["hash"]) & (shape <= ANY["shape"]) & (hue <= ANY["color"])
        apart, same, other = np.abs(d["taken"] - f["taken"]), d["camera"] == f["camera"], d["camera"] != f["camera"]
        unknown = np.isnan(d["camera"]) | np.isnan(f["camera"])
        burst = (apart <= APART) & same & (bits <= BURST["hash"]) & (shape <= BURST["shape"])
        near = (bits <= NEAR["hash"]) & (shape <= NEAR["shape"]) & (hue <= NEAR["color"]) & ~(apart > APART) & ~(other & ~unknown)
        return np.where(ok, np.where(burst, 3, np.where(near, 2, 1)), 0)

    def join(self, frame: int, f: dict) -> tuple[int, str | None]:
        """The anchor of the next frame, and what it is to it: the newest that matches and has room, or itself."""
        if self.ids:
            kinds = np.where(self.sizes < MEMBERS, self.kinds(f), 0)
            found = np.flatnonzero(kinds)
            if len(found):
                self.sizes[found[-1]] += 1
                return self.ids[found[-1]], ("similar", "near_duplicate", "burst")[kinds[found[-1]] - 1]
        self.ids = [*self.ids, frame][-ANCHORS:]
        self.sizes = np.append(self.sizes, 1)[-ANCHORS:]
        self.data = {k: np.concatenate([self.data[k], np.asarray(v)[None]])[-ANCHORS:] if self.data else np.asarray(v)[None] for k, v in f.items()}
        return frame, None


def features(grid: list[float], color: list[float], hexed: str, aspect: float, taken: float | None, camera: float | None) -> dict:
    """A frame as the anchors hold it; what is unknown is not a number."""
    flat = np.array(grid, float)
    flat = flat - flat.mean()
    number = lambda x: np.float64(np.nan if x is None else x)
    return {"flat": flat, "color": np.array(color, float), "hash": np.uint64(int(hexed, 16)), "aspect": np.float64(aspect), "contrast": np.abs(flat).mean(), "taken": number(taken), "camera": number(camera)}


def anchor_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of each job in order of capture, unknown times first, then id. The order makes it sequential
    within a job; its frames come sorted, batch by batch, and a task holds a batch and the newest anchors."""

    def run(batches):
        job, anchors = object(), Anchors()
        for b in batches:
            out = []
            for j, frame, *rest in zip(*(b.column(x).to_pylist() for x in ("job_id", "asset_id", "grid", "color", "hash", "aspect", "taken", "camera"))):
                if j != job:
                    job, anchors = j, Anchors()
                out.append(anchors.join(frame, features(*rest)))
            yield pa.RecordBatch.from_arrays([b.column("job_id"), b.column("asset_id"), pa.array([a for a, _ in out], pa.int64()), pa.array([k for _, k in out], pa.string())], ["job_id", "asset_id", "anchor_id", "kind"])

    d = descriptors(spark, sf_dir).withColumn("job_id", F.col("job_id").cast("int")).withColumn("asset_id", F.col("asset_id").cast("long"))
    d = d.repartition("job_id").sortWithinPartitions(F.col("job_id"), F.col("taken").asc_nulls_first(), F.col("asset_id"))
    groups = d.mapInArrow(run, "job_id int, asset_id long, anchor_id long, kind string")
    return groups.withColumn("group_size", F.count("*").over(Window.partitionBy("job_id", "anchor_id")))


QUERIES = {f.__name__: f for f in (lookalike_pairs, anchor_groups)}
ORACLE_SQL = {
    "lookalike_pairs": """WITH e AS (SELECT label AS job_id, vec_id, list_transform(embedding[1:64], lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
s AS (SELECT job_id, vec_id, list_transform(v, lambda x: (x - list_min(v)) / (list_max(v) - list_min(v))) AS s FROM e),
g AS (SELECT job_id, vec_id, s, list_transform(s, lambda x: 0.4 + 0.2 * x) AS lum, 1.5 + CASE WHEN vec_id % 4 = 0 THEN 0.06 ELSE 0.0 END AS aspect, CASE WHEN vec_id % 11 <> 0 THEN vec_id END AS taken, CASE WHEN vec_id % 3 <> 0 THEN vec_id % 2 END AS camera FROM s),
c AS (SELECT *, list_transform(lum, lambda x: x - list_avg(lum)) AS flat FROM g), d AS (SELECT *, list_avg(list_transform(flat, lambda x: abs(x))) AS contrast FROM c),
p AS (SELECT a.job_id, a.vec_id AS a, b.vec_id AS b, CAST(list_sum(list_transform(range(0, 8), lambda i: CASE WHEN (a.s[8 * i + 1] > 0.5) <> (b.s[8 * i + 1] > 0.5) THEN 8 ELSE 0 END)) AS INTEGER) AS h,
  list_avg(list_transform(range(1, 65), lambda i: abs(a.flat[i] - b.flat[i]))) AS shape, list_avg(list_transform(range(1, 49), lambda i: abs(a.s[i] / 2 - b.s[i] / 2))) AS hue, abs(a.taken - b.taken) <= 8 AS close, a.camera = b.camera AS same, least(a.contrast, b.contrast) AS contrast
  FROM d a JOIN d b ON a.job_id = b.job_id AND b.vec_id > a.vec_id AND b.vec_id - a.vec_id <= 8 AND abs(a.aspect / b.aspect - 1) <= 0.03),
k AS (SELECT *, CASE WHEN coalesce(close AND same, false) AND h <= 10 AND shape <= 0.055 THEN 'burst' WHEN h <= 3 AND shape <= 0.02 AND hue <= 0.04 AND coalesce(close, true) AND coalesce(same, true) THEN 'near_duplicate' ELSE 'similar' END AS kind FROM p WHERE contrast >= 0.008 AND h <= 14 AND shape <= 0.075 AND hue <= 0.20)
SELECT job_id, a, b, h AS hash_bits, round(shape, 6) AS shape, round(hue, 6) AS color, kind, round(greatest(0, least(1, 1 - (h / 64 + shape + hue) / 3)), 6) AS score, CASE kind WHEN 'burst' THEN 0.9 WHEN 'near_duplicate' THEN 0.7 ELSE 0.5 END AS confidence FROM k""",
}
