"""State kept between runs: files' identities, append-only assessments and their pointer, edits checked by
generation, staleness, recovery, selections and snapshots, faces (A2, A3, A16, C1, C14, C17, C18, C22, G1s,
H20, H26, I5, I7, I10 with B11).

Adapter: an order is an assessment, a job or an edited document, its customer the asset or job; an order
line is a file, an edit or a face. Each query's docstring says what stands for what.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fotolith.functions.scalars import clamp
from fotolith.plans.revisions import _S, matched_stems
from fotolith.sources.files import identified, optics_number
from fotolith.sources.tables import table


def photographs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats and identities of the parts' files, whose extension the container names."""
    ext = F.element_at(F.split(F.col("p_type"), " "), -1)
    path = F.concat(F.lit("/catalogue/"), "p_brand", F.lit("/"), F.col("p_partkey").cast("string"), F.lit("."), F.when(F.col("p_size") < 10, "CR3").when(F.col("p_size") < 20, "Jpeg").when(F.col("p_size") < 30, "tif").when(F.col("p_size") < 40, "heic").otherwise(ext))
    return identified(table(spark, sf_dir, "part").select(path.alias("path"), F.col("p_size").cast("long").alias("length"), F.when(F.col("p_size") > 5, F.col("p_partkey") * 1000).alias("mtime_ns")))


def optics_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = {"focal": F.concat(F.col("l_quantity").cast("string"), F.lit(" mm")), "aperture": F.concat(F.lit("f/"), (F.col("l_discount") * 100).cast("int").cast("string")), "distance": F.when(F.col("l_linestatus") == "F", F.lit("inf m")).otherwise(F.concat(F.col("l_linenumber").cast("string"), F.lit("e1")))}
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[optics_number(t).alias(n) for n, t in texts.items()])


def append_conflicts(kept: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Ids that would stand for different rows, in `kept` and `new` or in `new` alone: one aggregate that
    combines before the shuffle, so a key's rows never meet in one task."""
    columns = [F.col(c) for c in kept.columns if c != key]
    both = kept.select(key, F.struct(*columns).alias("row"), F.lit(0).alias("new")).unionByName(new.select(key, F.struct(*columns).alias("row"), F.lit(1).alias("new")))
    return both.groupBy(key).agg(F.min("row").alias("a"), F.max("row").alias("b"), F.max("new").alias("new")).where((F.col("new") == 1) & ~F.col("a").eqNullSafe(F.col("b"))).select(key)


def append_if_absent(kept: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """`kept` with the rows of `new` whose id it lacks, each once; a conflict is an error."""
    found = append_conflicts(kept, new, key).limit(1).collect()
    if found:
        raise ValueError(f"{key} {found[0][0]} cannot be used again for another row")
    return kept.unionByName(new.join(kept.select(key), key, "left_anti").dropDuplicates([key]).select(*kept.columns))


def _assessments(spark: SparkSession, sf_dir: str, where: str, payload: Column) -> DataFrame:
    return table(spark, sf_dir, "orders").where(where).select(F.col("o_orderkey").alias("assessment_id"), F.col("o_custkey").alias("asset_id"), F.col("o_orderdate").alias("created_at"), payload.alias("payload"))


def _waves(spark: SparkSession, sf_dir: str, revised: bool) -> tuple[DataFrame, DataFrame]:
    """Kept: finished and open orders; new: open and pending ones, of which dear ones may be revised."""
    same = F.col("o_orderpriority")
    return _assessments(spark, sf_dir, "o_orderstatus <> 'P'", same), _assessments(spark, sf_dir, "o_orderstatus <> 'F'", F.when(F.col("o_totalprice") > 200000, "revised").otherwise(same) if revised else same)


def assessment_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return append_conflicts(*_waves(spark, sf_dir, True), "assessment_id")


def appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    return append_if_absent(*_waves(spark, sf_dir, False), "assessment_id")


def current_assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pointer of each asset, moved by the last new assessment, with what it points to."""
    kept, new = _waves(spark, sf_dir, False)
    last = lambda d, wave: d.select("asset_id", F.struct(F.lit(wave).alias("wave"), "created_at", "assessment_id").alias("at"))
    pointer = last(kept, 0).unionByName(last(new, 1)).groupBy("asset_id").agg(F.max("at")["assessment_id"].alias("assessment_id"))
    return pointer.join(append_if_absent(kept, new, "assessment_id").drop("asset_id"), "assessment_id").select("asset_id", "assessment_id", "created_at", "payload")


def rematched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Automatic pairs, with the id of the pair before that is the same on both sides; then the manual ones
    before that meet none of them on either side (C14).

    Adapter: before, each part of a size up to 30 was paired with itself, larger ones by hand with the
    next part. Manual pairs are one to one, as a dataset keeps them.
    """
    auto, p = matched_stems(spark, sf_dir).select("source_id", "reference_id"), table(spark, sf_dir, "part")
    old = p.select(F.col("p_partkey").alias("source_id"), F.when(F.col("p_size") <= 30, F.col("p_partkey")).otherwise(F.col("p_partkey") + 1).alias("reference_id"), F.concat(F.lit("pair-"), F.col("p_partkey").cast("string")).alias("pair_id"), (F.col("p_size") > 30).alias("manual"))
    reused = auto.join(old.drop("manual"), ["source_id", "reference_id"], "left").select("source_id", "reference_id", "pair_id", F.lit(False).alias("manual"))
    rest = old.where("manual").join(auto.select("source_id"), "source_id", "left_anti").join(auto.select("reference_id"), "reference_id", "left_anti")
    return reused.unionByName(rest.select("source_id", "reference_id", "pair_id", "manual"))


def stable_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a job's members and fingerprints are the same in two snapshots (C18). Adapter: before, the
    customer had no pending orders; now it has all."""
    now = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job_id"), F.col("o_orderkey").alias("asset_id"), F.col("o_orderpriority").alias("fingerprint"), (F.col("o_orderstatus") != "P").alias("was"))
    both = now.select("job_id", "asset_id", "fingerprint", F.lit(1).alias("side")).unionByName(now.where("was").select("job_id", "asset_id", "fingerprint", F.lit(-1).alias("side")))
    each = both.groupBy("job_id", "asset_id", "fingerprint").agg(F.sum("side").alias("more"))
    return each.groupBy("job_id").agg((F.max(F.abs("more")) == 0).alias("stable"))


def selection_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the ids asked for are those kept as selected, each once (C22, G1s). Adapter: a supplier's
    lines ask for their parts; parts of the supplier's shipped lines are selected."""
    x = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("job_id"), F.col("l_partkey").alias("asset_id"), F.when(F.col("l_linestatus") == "F", 1).otherwise(0).alias("kept"))
    each = x.groupBy("job_id", "asset_id").agg(F.count("*").alias("asked"), F.max("kept").alias("kept"))
    return each.groupBy("job_id").agg(F.sum(F.when(F.col("asked") > 1, 1).otherwise(0)).alias("repeated"), F.sum(F.when(F.col("kept") == 0, 1).otherwise(0)).alias("not_kept")).withColumn("equal", (F.col("repeated") == 0) & (F.col("not_kept") == 0))


#: What an assessment was made of, all of which must be as now.
IDENTITY = ("source_fingerprint", "engine_version", "model_versions", "source_analysis_id", "feature_version", "analysis_version", "cache_key")


def stale(was: str, now: str) -> Column:
    """Whether structs `was` and `now` differ in any part of the identity, versions of features only where
    there are some, the stamp of copies only where there is one (I5)."""
    differ = lambda c: ~F.col(f"{was}.{c}").eqNullSafe(F.col(f"{now}.{c}"))
    only = {"feature_version": "feature_version", "analysis_version": "feature_version", "duplicate_stamp": "duplicate_stamp"}
    out = F.lit(False)
    for c in (*IDENTITY, "duplicate_stamp"):
        out = out | (differ(c) & F.col(f"{was}.{only[c]}").isNotNull() if c in only else differ(c))
    return out


def stale_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rating in effect: the user's, else the assessment's unless it is stale. Adapter: a line is an
    assessment, whose columns give what it was made of."""
    q, d, t, n = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax"), F.col("l_linenumber")
    was = F.struct(F.col("l_partkey").alias("source_fingerprint"), F.lit(3).alias("engine_version"), F.col("l_returnflag").alias("model_versions"), F.when(n > 1, n).alias("source_analysis_id"), F.when(d > 0.01, 2).alias("feature_version"), F.lit(1).alias("analysis_version"), F.col("l_suppkey").alias("cache_key"), F.when(t > 0.02, F.col("l_shipdate")).alias("duplicate_stamp"))
    now = F.struct((F.col("l_partkey") + F.when(q > 48, 1).otherwise(0)).alias("source_fingerprint"), F.lit(3).alias("engine_version"), F.when((F.col("l_returnflag") == "A") & (q < 3), "B").otherwise(F.col("l_returnflag")).alias("model_versions"), F.when((n > 1) & (n < 7), n).alias("source_analysis_id"), F.when(q > 46, 3).otherwise(2).alias("feature_version"), F.lit(1).alias("analysis_version"), F.col("l_suppkey").alias("cache_key"), F.when(t < 0.08, F.col("l_shipdate")).alias("duplicate_stamp"))
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", was.alias("was"), now.alias("now"), F.when(F.col("l_linestatus") == "F", n % 6).alias("user_rating"), F.ceil(q / 10).cast("int").alias("ai_rating"))
    x = x.withColumn("stale", stale("was", "now"))
    return x.select("l_orderkey", "l_linenumber", "stale", F.coalesce("user_rating", F.when(~F.col("stale"), F.col("ai_rating"))).alias("effective_rating"))


def committed(stored: DataFrame, edits: DataFrame) -> DataFrame:
    """A batch of edits of documents (asset_id, place, expected, payload) against (asset_id, generation,
    payload): of those that expect the generation stored, the first is written, which makes the next
    generation; all others are conflicts (I7). At one place the least payload comes first. An edit of a document that isn't stored is one, too."""
    wins = edits.join(stored.select("asset_id", "generation"), "asset_id").where("expected = generation").groupBy("asset_id").agg(F.min(F.struct("place", F.col("payload").alias("to"))).alias("edit"))
    n = edits.groupBy("asset_id").agg(F.count("*").alias("edits"))
    x = stored.join(wins, "asset_id", "left").join(n, "asset_id", "left")
    won = F.col("edit").isNotNull()
    return x.select("asset_id", (F.col("generation") + won.cast("int")).alias("generation"), F.when(won, F.col("edit.to")).otherwise(F.col("payload")).alias("payload"), (F.coalesce("edits", F.lit(0)) - won.cast("int")).alias("conflicts"))


def committed_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter: an order is a document of generation 2, its lines edits that expect the per cent of their
    discount."""
    stored = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("asset_id"), F.lit(2).alias("generation"), F.col("o_orderpriority").alias("payload"))
    edits = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("asset_id"), F.col("l_linenumber").alias("place"), F.round(F.col("l_discount") * 100).cast("int").alias("expected"), F.col("l_returnflag").alias("payload"))
    return committed(stored, edits)


def recovered(payload: Column, stage: str) -> Column:
    """A run's JSON text with its status set to interrupted if it was queued or running; other fields stay
    (B11, I10)."""
    fields = F.from_json(payload, "status string, stage string, completed long")
    running = F.get_json_object(payload, "$.status").isin("queued", "running")
    return F.when(running, F.to_json(fields.withField("status", F.lit("interrupted")).withField("stage", F.lit(stage)))).otherwise(payload)


def recovered_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter: an order is a run, its status that of the order."""
    status = F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "O", "running").otherwise("queued")
    payload = F.to_json(F.struct(status.alias("status"), F.col("o_orderpriority").alias("stage"), F.col("o_custkey").alias("completed")))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), recovered(payload, "Interrupted; cached context remains available.").alias("payload"))


def face_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of a face inside the image, its share, and how far it is from the nearest edge; faces that
    are not finite, empty or outside go (H20). Adapter: a line is a face of its order."""
    x = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("face"), (F.col("l_discount") * 12 - 0.1).alias("x"), (F.col("l_tax") * 12 - 0.1).alias("y"), (F.col("l_quantity") / 100).alias("w"), ((51 - F.col("l_quantity")) / 100 - 0.05).alias("h"))
    finite = lambda c: F.coalesce(F.abs(F.col(c)) < float("inf"), F.lit(False))
    x = x.where(finite("x") & finite("y") & finite("w") & finite("h") & (F.col("w") > 0) & (F.col("h") > 0))
    x = x.select("image_id", "face", clamp(F.col("x"), 0.0, 1.0).alias("left"), clamp(F.col("y"), 0.0, 1.0).alias("top"), clamp(F.col("x") + F.col("w"), 0.0, 1.0).alias("right"), clamp(F.col("y") + F.col("h"), 0.0, 1.0).alias("bottom"), (F.col("w") * F.col("h")).alias("area")).where("right > left and bottom > top")
    width, height = F.col("right") - F.col("left"), F.col("bottom") - F.col("top")
    return x.select("image_id", "face", "left", "top", width.alias("width"), height.alias("height"), clamp(width * height / F.col("area"), 0.0, 1.0).alias("visible"), F.least("left", "top", 1 - F.col("right"), 1 - F.col("bottom")).alias("edge"))


def suppressed(faces: Column, most: int = 64, overlap: float = 0.3) -> Column:
    """Of an image's faces (confidence, y, x, width, height), best first, those that overlap none kept
    before by 0.3 of their union, at most 64 (C17). A detector gives at most 5,000."""
    order = F.array_sort(faces, lambda a, b: F.when(a["confidence"] != b["confidence"], F.signum(b["confidence"] - a["confidence"]).cast("int")).when(a["y"] != b["y"], F.signum(a["y"] - b["y"]).cast("int")).otherwise(F.signum(a["x"] - b["x"]).cast("int")))

    def apart(a: Column, b: Column) -> Column:
        side = lambda at, size: F.greatest(F.lit(0.0), F.least(a[at] + a[size], b[at] + b[size]) - F.greatest(a[at], b[at]))
        shared = side("x", "width") * side("y", "height")
        return shared / F.greatest(F.lit(0.0001), a["width"] * a["height"] + b["width"] * b["height"] - shared) < overlap

    return F.aggregate(order, F.filter(faces, lambda _: F.lit(False)), lambda kept, f: F.when((F.size(kept) < most) & F.forall(kept, lambda k: apart(f, k)), F.concat(kept, F.array(f))).otherwise(kept))


QUERIES = {f.__name__: f for f in (photographs, optics_numbers, assessment_conflicts, appended, current_assessments, rematched, stable_jobs, selection_checks, stale_ratings, committed_edits, recovered_runs, face_boxes)}
_KEPT = "SELECT o_orderkey AS assessment_id, o_custkey AS asset_id, o_orderdate AS created_at, o_orderpriority AS payload FROM orders"
_CLIP = "greatest(0.0, least(1.0, {0}))"
_ALL = f"all_rows AS ({_KEPT} WHERE o_orderstatus <> 'P' UNION {_KEPT} WHERE o_orderstatus <> 'F')"
_PATH = "'/catalogue/' || p_brand || '/' || CAST(p_partkey AS VARCHAR) || '.' || CASE WHEN p_size < 10 THEN 'CR3' WHEN p_size < 20 THEN 'Jpeg' WHEN p_size < 30 THEN 'tif' WHEN p_size < 40 THEN 'heic' ELSE split_part(p_type, ' ', -1) END"
_OLD = "old AS (SELECT p_partkey AS source_id, CASE WHEN p_size <= 30 THEN p_partkey ELSE p_partkey + 1 END AS reference_id, 'pair-' || CAST(p_partkey AS VARCHAR) AS pair_id, p_size > 30 AS manual FROM part)"
ORACLE_SQL = {
    "photographs": f"""WITH p AS (SELECT {_PATH} AS path, CAST(p_size AS BIGINT) AS length, CASE WHEN p_size > 5 THEN p_partkey * 1000 END AS mtime_ns FROM part), e AS (SELECT *, lower(regexp_extract(path, '[^.]*$')) AS file_type, sha256(path) AS asset_id FROM p)
SELECT path, length, mtime_ns, file_type, CASE WHEN file_type = 'cr3' THEN 'camera_raw' WHEN file_type = 'jpeg' THEN 'jpeg' WHEN file_type = 'tif' THEN 'tiff' ELSE 'heif' END AS family, asset_id,
sha256(asset_id || ':' || CAST(length AS VARCHAR) || ':' || coalesce(CAST(mtime_ns AS VARCHAR), 'unknown')) AS fingerprint FROM e WHERE file_type IN ('cr3', 'jpeg', 'tif', 'heic')""",
    "optics_numbers": "SELECT l_orderkey, l_linenumber, nullif(l_quantity, 0) AS focal, nullif(CAST(CAST(trunc(l_discount * 100) AS INTEGER) AS DOUBLE), 0) AS aperture, CASE WHEN l_linestatus <> 'F' THEN CAST(l_linenumber * 10 AS DOUBLE) END AS distance FROM lineitem",
    "assessment_conflicts": "SELECT o_orderkey AS assessment_id FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 200000",
    "appended": f"WITH {_ALL} SELECT assessment_id, asset_id, created_at, payload FROM all_rows",
    "current_assessments": f"WITH {_ALL} SELECT a.asset_id, a.assessment_id, a.created_at, a.payload FROM all_rows a JOIN orders o ON o.o_orderkey = a.assessment_id QUALIFY row_number() OVER (PARTITION BY a.asset_id ORDER BY o.o_orderstatus <> 'F' DESC, a.created_at DESC, a.assessment_id DESC) = 1",
    "rematched": f"WITH {_S}, {_OLD} SELECT p.source_id, p.reference_id, old.pair_id, false AS manual FROM p LEFT JOIN old USING (source_id, reference_id) UNION ALL SELECT source_id, reference_id, pair_id, manual FROM old WHERE manual AND source_id NOT IN (SELECT source_id FROM p) AND reference_id NOT IN (SELECT reference_id FROM p)",
    "stable_jobs": "SELECT o_custkey AS job_id, count(*) FILTER (WHERE o_orderstatus = 'P') = 0 AS stable FROM orders GROUP BY 1",
    "selection_checks": "WITH e AS (SELECT l_suppkey AS job_id, l_partkey, count(*) AS asked, bool_or(l_linestatus = 'F') AS kept FROM lineitem GROUP BY 1, 2) SELECT job_id, count(*) FILTER (WHERE asked > 1) AS repeated, count(*) FILTER (WHERE NOT kept) AS not_kept, bool_and(asked = 1 AND kept) AS equal FROM e GROUP BY 1",
    "stale_ratings": """WITH s AS (SELECT *, l_quantity > 48 OR (l_returnflag = 'A' AND l_quantity < 3) OR l_linenumber >= 7 OR (l_discount > 0.01 AND l_quantity > 46) OR (l_tax > 0.02 AND l_tax >= 0.08) AS stale FROM lineitem)
SELECT l_orderkey, l_linenumber, stale, coalesce(CASE WHEN l_linestatus = 'F' THEN l_linenumber % 6 END, CASE WHEN NOT stale THEN CAST(ceil(l_quantity / 10) AS INTEGER) END) AS effective_rating FROM s""",
    "committed_edits": """WITH e AS (SELECT l_orderkey AS asset_id, count(*) AS n, min({'place': l_linenumber, 'payload': l_returnflag}) FILTER (WHERE CAST(round(l_discount * 100) AS INTEGER) = 2).payload AS won, count(*) FILTER (WHERE CAST(round(l_discount * 100) AS INTEGER) = 2) > 0 AS wins FROM lineitem GROUP BY 1)
SELECT o_orderkey AS asset_id, CASE WHEN coalesce(wins, false) THEN 3 ELSE 2 END AS generation, CASE WHEN coalesce(wins, false) THEN won ELSE o_orderpriority END AS payload, coalesce(n, 0) - CASE WHEN coalesce(wins, false) THEN 1 ELSE 0 END AS conflicts FROM orders LEFT JOIN e ON asset_id = o_orderkey""",
    "recovered_runs": """SELECT o_orderkey AS run_id, '{"status":"' || CASE WHEN o_orderstatus = 'F' THEN 'complete' ELSE 'interrupted' END || '","stage":"' || CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE 'Interrupted; cached context remains available.' END || '","completed":' || CAST(o_custkey AS VARCHAR) || '}' AS payload FROM orders""",
    "face_boxes": f"""WITH x AS (SELECT l_orderkey AS image_id, l_linenumber AS face, l_discount * 12 - 0.1 AS x, l_tax * 12 - 0.1 AS y, l_quantity / 100 AS w, (51 - l_quantity) / 100 - 0.05 AS h FROM lineitem),
c AS (SELECT *, {_CLIP.format("x")} AS l, {_CLIP.format("y")} AS t, {_CLIP.format("x + w")} AS r, {_CLIP.format("y + h")} AS b FROM x WHERE w > 0 AND h > 0)
SELECT image_id, face, l AS left, t AS top, r - l AS width, b - t AS height, {_CLIP.format("(r - l) * (b - t) / (w * h)")} AS visible, least(l, t, 1 - r, 1 - b) AS edge FROM c WHERE r > l AND b > t""",
}
