"""Files, state and measurement against plain versions and literal cases."""

import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from fotolith.plans import measure, state
from fotolith.sources import files


def test_photographs_of_folders(spark, tmp_path):
    for name in ("a.CR3", "deep/er/b.jpeg", "deep/c.txt", "deep/.png", "d.tar.heic", "e"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * len(name))
    rows = {os.path.basename(r["path"]): r for r in files.scanned(spark, str(tmp_path)).collect()}
    assert {k: (r["file_type"], r["family"], r["length"]) for k, r in rows.items()} == {"a.CR3": ("cr3", "camera_raw", 5), "b.jpeg": ("jpeg", "jpeg", 14), "d.tar.heic": ("heic", "heif", 10)}
    r = rows["b.jpeg"]
    assert r["asset_id"] == hashlib.sha256(str(tmp_path / "deep/er/b.jpeg").encode()).hexdigest()
    assert r["fingerprint"] == hashlib.sha256(f"{r['asset_id']}:14:{r['mtime_ns']}".encode()).hexdigest()


def test_optics_numbers(spark):
    cases = {"85 mm": 85.0, "f/2.8": 2.8, " f/f/4 x": 4.0, "1e2": 100.0, ".5": 0.5, "5.": 5.0, "+3": 3.0, "0": None, "-1": None, "inf": None, "nan": None, "5f": None, "1d": None, "1e999": None, "": None, " ": None, None: None, "mm 3": None}
    df = spark.createDataFrame(list(enumerate(cases)), "k int, t string")
    got = dict(df.select("k", files.optics_number(F.col("t"))).collect())
    assert [got[k] for k in range(len(cases))] == list(cases.values())


def test_an_id_stands_for_one_row(spark):
    df = lambda *rows: spark.createDataFrame(rows, "id string, payload string")
    kept = df(("a", "1"), ("b", None))
    assert sorted(state.append_if_absent(kept, df(("a", "1"), ("c", "3"), ("c", "3"), ("b", None)), "id").collect()) == [("a", "1"), ("b", None), ("c", "3")]
    assert sorted(state.append_if_absent(kept, df(), "id").collect()) == [("a", "1"), ("b", None)]
    for bad in (df(("a", "2")), df(("b", "1")), df(("c", "1"), ("c", "2"))):
        with pytest.raises(ValueError):
            state.append_if_absent(kept, bad, "id")


def test_edits_need_the_stored_generation(spark):
    stored = spark.createDataFrame([("a", 2, "old"), ("b", 1, "old"), ("c", 1, "old")], "asset_id string, generation int, payload string")
    edits = spark.createDataFrame([("a", 1, 1, "early"), ("a", 2, 2, "one"), ("a", 3, 2, "two"), ("a", 4, 3, "three"), ("b", 1, 2, "x"), ("z", 1, 1, "x")], "asset_id string, place int, expected int, payload string")
    assert sorted(map(tuple, state.committed(stored, edits).collect())) == [("a", 3, "one", 3), ("b", 1, "old", 1), ("c", 1, "old", 0)]


def test_runs_that_were_going_are_interrupted(spark):
    cases = {'{"status":"queued","stage":"x","completed":3}': '{"status":"interrupted","stage":"Gone","completed":3}', '{"status":"complete","stage":"x","more":[1]}': '{"status":"complete","stage":"x","more":[1]}', "not json": "not json", None: None}
    df = spark.createDataFrame(list(enumerate(cases)), "k int, t string")
    got = dict(df.select("k", state.recovered(F.col("t"), "Gone")).collect())
    assert [got[k] for k in range(len(cases))] == list(cases.values())


def plain_suppressed(faces):
    kept = []
    for f in sorted(faces, key=lambda f: (-f[0], f[1], f[2])):
        def apart(k):
            w = max(0.0, min(f[2] + f[3], k[2] + k[3]) - max(f[2], k[2]))
            h = max(0.0, min(f[1] + f[4], k[1] + k[4]) - max(f[1], k[1]))
            return w * h / max(0.0001, f[3] * f[4] + k[3] * k[4] - w * h) < 0.3

        if len(kept) < 64 and all(apart(k) for k in kept):
            kept.append(f)
    return kept


@pytest.mark.parametrize("size", [0.25, 0.01])
def test_overlapping_faces_are_suppressed(spark, size):
    g = np.random.default_rng(3)
    images = [[(round(float(g.random()), 1), *(float(v) for v in g.random(2)), float(size * (0.5 + g.random())), float(size * (0.5 + g.random()))) for _ in range(n)] for n in (0, 1, 40, 300)]
    df = spark.createDataFrame(list(enumerate(images)), "k int, faces array<struct<confidence:double,y:double,x:double,width:double,height:double>>")
    got = {r[0]: [tuple(f) for f in r[1]] for r in df.select("k", state.suppressed(F.col("faces"))).collect()}
    for k, faces in enumerate(images):
        assert got[k] == plain_suppressed(faces)
    assert size > 0.1 or len(got[3]) == 64


def test_curves(spark):
    curves = {((0.0, 0.0), (0.5, 0.7), (1.0, 1.0)): lambda x: 1.4 * x if x <= 0.5 else 0.7 + 0.6 * (x - 0.5), ((0.2, 0.0), (0.8, 1.2)): lambda x: (x - 0.2) * 2, ((0.0, 0.0), (0.3, 0.3)): lambda x: x}
    xs = [-0.5, 0.0, 0.2, 0.5, 0.6, 1.0, 1.5]
    df = spark.createDataFrame([(x, list(c)) for c in curves for x in xs], "x double, p array<struct<x:double,y:double>>")
    got = [r[0] for r in df.select(measure.curve_value(F.col("x"), F.col("p"))).collect()]
    assert got == pytest.approx([f(x) for f in curves.values() for x in xs])


def test_hues_go_to_the_nearest_family(spark):
    """Pure hues, and 45 degrees, which is as far from 30 as from 60, to the first."""
    import colorsys

    hues = [0, 14, 16, 31, 44, 46, 100, 150.5, 239, 258, 276, 296, 340, 359]
    want = [min(range(8), key=lambda k: abs((h - measure.HUES[k] + 180) % 360 - 180)) for h in hues]
    df = spark.createDataFrame([(*colorsys.hsv_to_rgb(h / 360, 0.8, 0.9),) for h in hues] + [(0.5, 0.5, 0.5), (0.0, 0.0, 0.0)], "r double, g double, b double")
    most, least = F.greatest("r", "g", "b"), F.least("r", "g", "b")
    sat = F.when(most > 0, (most - least) / most).otherwise(0.0)
    got = [r[0] for r in df.select(measure.hue_family([F.col(c) for c in "rgb"], most, F.nullif(most - least, F.lit(0.0)), sat)).collect()]
    assert got == want + [8, 8]


def test_display_light_and_back(spark):
    df = spark.range(0, 101).select((F.col("id") / 100).alias("v"))
    for v, back in df.select("v", measure.srgb_to_linear(measure.linear_to_srgb(F.col("v")))).collect():
        assert back == pytest.approx(v, abs=1e-6)
