"""Queries over a job see the whole job, and the pair classifier says what its rules say."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fotolith.plans import similarity


def plain(a, b):
    """The pair classifier, number by number."""
    if abs(a["aspect"] / b["aspect"] - 1) > 0.03:
        return None
    shape = sum(abs((x - sum(a["grid"]) / 64) - (y - sum(b["grid"]) / 64)) for x, y in zip(a["grid"], b["grid"])) / 64
    color = sum(abs(x - y) for x, y in zip(a["color"], b["color"])) / 48
    h = bin(int(a["hash"], 16) ^ int(b["hash"], 16)).count("1")
    if min(sum(abs(x - sum(d["grid"]) / 64) for x in d["grid"]) / 64 for d in (a, b)) < 0.008 or h > 14 or shape > 0.075 or color > 0.20:
        return None
    gap = None if a["taken"] is None or b["taken"] is None else abs(a["taken"] - b["taken"])
    same = None if a["camera"] is None or b["camera"] is None else a["camera"] == b["camera"]
    if gap is not None and gap <= 8 and same and h <= 10 and shape <= 0.055:
        return "burst"
    return "near_duplicate" if h <= 3 and shape <= 0.02 and color <= 0.04 and (gap is None or gap <= 8) and same is not False else "similar"


BASE = {"job_id": 1, "asset_id": 1, "grid": [0.4 + 0.003 * k for k in range(64)], "color": [0.1] * 48, "hash": "00ff00ff00ff00ff", "aspect": 1.5, "taken": 10, "camera": 0}
#: What the second frame has else, and what the pair is then.
CASES = [
    ({}, "burst"), ({"taken": 19}, "similar"), ({"taken": None}, "near_duplicate"), ({"camera": 1}, "similar"), ({"camera": None}, "near_duplicate"), ({"aspect": 1.56}, None), ({"hash": "00ff00ff00ff0000"}, "burst"),
    ({"hash": "00ff00ff00000000"}, None), ({"hash": "00ff00ff00ff00f8", "taken": None}, "near_duplicate"), ({"hash": "00ff00ff00ff00f0", "taken": None}, "similar"), ({"color": [0.31] * 48}, None), ({"color": [0.15] * 48, "taken": None}, "similar"),
    ({"grid": [0.5] * 64}, None), ({"grid": [0.4 + 0.003 * k + (0.06 if k % 2 else 0) for k in range(64)]}, "burst"), ({"grid": [0.4 + 0.003 * k + (0.13 if k % 2 else 0) for k in range(64)]}, "similar"), ({"grid": [0.4 + 0.003 * k + (0.16 if k % 2 else 0) for k in range(64)]}, None),
]
SCHEMA = "job_id int, asset_id int, grid array<double>, color array<double>, hash string, aspect double, taken int, camera int"


def test_pairs_are_classified(spark):
    rows = [[BASE[c] for c in BASE] + [(BASE | {"asset_id": k} | other)[c] for c in BASE] for k, (other, _) in enumerate(CASES)]
    names = [s.split() for s in SCHEMA.split(", ")]
    df = spark.createDataFrame(rows, ", ".join(f"{n}_{side} {t}" for side in "ab" for n, t in names))
    got = {r["asset_id_b"]: r["kind"] for r in similarity.classified(df).collect()}
    one = lambda d: {k: v for k, v in d.items() if k not in ("job_id", "asset_id")}
    for k, (other, want) in enumerate(CASES):
        assert got.get(k) == want == plain(BASE, BASE | other), (k, other)
        anchors = similarity.Anchors()
        anchors.join(0, similarity.features(*one(BASE).values()))
        assert anchors.join(1, similarity.features(*one(BASE | other).values()))[1] == want, (k, other)


def test_anchors_are_carried_through_a_job(spark, tmp_path):
    rng = np.random.default_rng(0)
    kinds = rng.random((90, 64))
    frames = [(int(t), job, [float(x) for x in kinds[rng.integers(90)]]) for job in (1, 2) for t in range(0, 2100, 7)]
    spark.createDataFrame(frames, "vec_id long, label int, embedding array<float>").repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = [r.asDict() for r in similarity.descriptors(spark, str(tmp_path)).collect()]
    want = {}
    for job in (1, 2):
        groups = []
        for f in sorted((r for r in rows if r["job_id"] == job), key=lambda r: (r["taken"] is not None, r["taken"] or 0, r["asset_id"])):
            found = [(g, k) for g in groups[-64:] if len(g) < 32 and (k := plain(g[0], f))]
            found[-1][0].append(f) if found else groups.append([f])
            want[job, f["asset_id"]] = (found[-1][0] if found else groups[-1], found[-1][1] if found else None)
    got = {(r["job_id"], r["asset_id"]): (r["anchor_id"], r["group_size"], r["kind"]) for r in similarity.anchor_groups(spark, str(tmp_path)).collect()}
    assert got == {k: (g[0]["asset_id"], len(g), kind) for k, (g, kind) in want.items()}
    assert len({g for g, _, _ in got.values()}) < 0.8 * len(got)


def test_a_family_larger_than_a_group_makes_two():
    anchors, f = similarity.Anchors(), similarity.features(*[BASE[k] for k in BASE if k not in ("job_id", "asset_id")])
    assert sorted({anchors.join(k, f)[0] for k in range(40)}) == [0, 32]


@pytest.mark.parametrize(
    "function, cases",
    [
        ("normal_stem", {"IMG_1_edited.jpg": "img1", "a-final.tif": "a", "accredited.jpg": "accredited", "credit.jpg": "credit", "semifinal.raw": "semifinal", "x edit.jpg": "x", "_edit.jpg": None, "Été-1.jpg": "t1", "a_final_edited.jpg": "afinal", "b_.jpg": "b"}),
        ("safe_stem", {'a<b>:"c"': "abc", " ..x. ": "x", "???": "photo", "": "photo", "a/b\\c|d": "abcd"}),
        ("slug", {"My  Style!": "my-style", "--": "style", "": "style"}),
    ],
)
def test_names(spark, function, cases):
    from fotolith.functions import scalars

    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r[0]: r[1] for r in df.select("t", getattr(scalars, function)(F.col("t"))).collect()} == cases


def test_times_and_classes(spark):
    from fotolith.functions import scalars

    cases = {"2024-05-06T07:08:09Z": 1714979289000, "2024-05-06T07:08:09.25+02:00": 1714972089250, "2024:05:06 07:08:09": 1714979289000, "2024-05-06 07:08:09.123456": 1714979289123, "2024": None, "2024-05-06": None, "2024:05-06 07:08:09": None, "x": None, "2024:13:06 07:08:09": None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r[0]: r[1] for r in df.select("t", F.unix_millis(scalars.capture_time(F.col("t")))).collect()} == cases
    edges = {0.0249: "strongly_underexposed", 0.025: "underexposed", 0.10: "balanced", 0.55: "overexposed", 0.7999: "overexposed", 0.80: "strongly_overexposed"}
    df = spark.createDataFrame([(k,) for k in edges], "x double")
    assert {r[0]: r[1] for r in df.select("x", scalars.exposure_class(F.col("x"))).collect()} == edges


def test_families_hold_different_ids(spark):
    from fotolith.plans.duplicates import families

    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, "b"), (3, "b"), (4, None), (5, None)], "asset_id long, sha256 string").withColumn("byte_length", F.lit(1))
    assert [tuple(r) for r in families(df).select("sha256", "canonical_id", "family_size").collect()] == [("b", 2, 2)]
