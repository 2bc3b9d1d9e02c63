"""Edit documents: numbering, retention, change detection, upserts, matching of names
(E4, E5, C10-C12, D20, D21, H3, and of A15 the upsert).

Adapter: a customer's orders are the revisions of one document, the price their payload.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fotolith.functions.scalars import normal_stem
from fotolith.sources.tables import table


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("asset_id"), F.col("o_orderkey").alias("revision_id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderstatus").alias("payload"))
    return o.withColumn("revision", F.row_number().over(Window.partitionBy("asset_id").orderBy("created_at", "revision_id")))


def retained(spark: SparkSession, sf_dir: str, keep: int = 200) -> DataFrame:
    """The first revision and the latest keep - 1."""
    latest = F.row_number().over(Window.partitionBy("asset_id").orderBy(F.desc("revision")))
    return revisions(spark, sf_dir).withColumn("age", latest).where((F.col("revision") == 1) | (F.col("age") <= keep - 1)).select("asset_id", "revision_id", "revision")


def changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisions whose payload differs from the one before: an equal one makes no new row."""
    before = F.lag("payload").over(Window.partitionBy("asset_id").orderBy("revision"))
    return revisions(spark, sf_dir).withColumn("before", before).where(~F.col("payload").eqNullSafe(F.col("before"))).select("asset_id", "revision_id", "revision", "payload")


def next_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisions(spark, sf_dir).groupBy("asset_id").agg((F.max("revision") + 1).alias("next_revision"))


def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest wins among old and new rows of an asset: a maximum of a struct, no sort of a key's rows."""
    rows = revisions(spark, sf_dir).where("revision in (1, 3)").select("asset_id", F.when(F.col("revision") == 3, 1).otherwise(0).alias("wave"), "payload")
    return rows.groupBy("asset_id").agg(F.max(F.struct("wave", "payload")).alias("x")).select("asset_id", "x.wave", "x.payload")


def unanimous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets all of whose revisions have one payload."""
    g = revisions(spark, sf_dir).groupBy("asset_id").agg(F.countDistinct("payload").alias("kinds"), F.min("payload").alias("payload"), F.count("*").alias("revisions"))
    return g.where("kinds = 1").select("asset_id", "payload", "revisions")


def stems(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Sources: every part, by name, size and brand; references: every part under its edited name, which
    for sizes over 40 is another."""
    p, size = table(spark, sf_dir, "part"), F.col("p_size").cast("string")
    left = p.select(F.col("p_partkey").alias("source_id"), normal_stem(F.concat("p_name", size, "p_brand", F.lit(".raw"))).alias("stem"))
    right = p.select(F.col("p_partkey").alias("reference_id"), normal_stem(F.concat("p_name", size, F.when(F.col("p_size") > 40, F.lit("x")).otherwise(F.lit("")), "p_brand", F.lit("_edit.jpg"))).alias("stem"))
    return left, right


def _only(side: DataFrame, key: str) -> DataFrame:
    return side.groupBy("stem").agg(F.count("*").alias("n"), F.min(key).alias(key)).where("n = 1").select("stem", key)


def matched_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs whose stem is unique on both sides."""
    left, right = stems(spark, sf_dir)
    return _only(left, "source_id").join(_only(right, "reference_id"), "stem")


def ambiguous_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources whose stem is on the other side, but not unique on both."""
    left, right = stems(spark, sf_dir)
    return left.join(right, "stem", "left_semi").join(matched_stems(spark, sf_dir).select("source_id"), "source_id", "left_anti").select("source_id", "stem")


def unmatched_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = stems(spark, sf_dir)
    return left.join(right, "stem", "left_anti").select("source_id", "stem")


def unmatched_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = stems(spark, sf_dir)
    return right.join(left, "stem", "left_anti").select("reference_id", "stem")


def match_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the match and whether the first and the last of both sides, by id, have one stem (D21):
    each side is one aggregate of structs."""
    left, right = stems(spark, sf_dir)
    side = lambda d, key, name: d.agg(F.count("*").alias(name), F.min(F.struct(key, "stem"))["stem"].alias(f"{name}_first"), F.max(F.struct(key, "stem"))["stem"].alias(f"{name}_last"))
    one = side(left, "source_id", "sources").crossJoin(side(right, "reference_id", "refs"))  # one row each
    one = one.crossJoin(matched_stems(spark, sf_dir).agg(F.count("*").alias("matched"))).crossJoin(ambiguous_sources(spark, sf_dir).agg(F.count("*").alias("ambiguous")))
    fallback = (F.col("matched") == 0) & (F.col("ambiguous") == 0) & (F.col("sources") == F.col("refs")) & (F.col("sources") > 0)
    return one.select("sources", "refs", "matched", "ambiguous", (F.col("sources_first") == F.col("refs_first")).alias("start_aligned"), (F.col("sources_last") == F.col("refs_last")).alias("end_aligned"), fallback.alias("order_fallback"))


QUERIES = {f.__name__: f for f in (retained, changed, next_numbers, upserted, unanimous, matched_stems, ambiguous_sources, unmatched_sources, unmatched_references, match_summary)}
_V = "v AS (SELECT o_custkey AS asset_id, o_orderkey AS revision_id, o_orderstatus AS payload, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS revision FROM orders)"
_STEM = "nullif(regexp_replace(regexp_replace(regexp_replace(lower(trim({0})), '[_ -](edited|edit|final)$', ''), '[_ -]+$', ''), '[^a-z0-9]', '', 'g'), '')"
_S = f"""l AS (SELECT p_partkey AS source_id, {_STEM.format("p_name || CAST(p_size AS VARCHAR) || p_brand")} AS stem FROM part), r AS (SELECT p_partkey AS reference_id, {_STEM.format("p_name || CAST(p_size AS VARCHAR) || CASE WHEN p_size > 40 THEN 'x' ELSE '' END || p_brand || '_edit'")} AS stem FROM part),
p AS (SELECT stem, source_id, reference_id FROM (SELECT stem, min(source_id) AS source_id FROM l GROUP BY 1 HAVING count(*) = 1) a JOIN (SELECT stem, min(reference_id) AS reference_id FROM r GROUP BY 1 HAVING count(*) = 1) b USING (stem)),
g AS (SELECT source_id, stem FROM l WHERE stem IN (SELECT stem FROM r) AND source_id NOT IN (SELECT source_id FROM p))"""
ORACLE_SQL = {
    "retained": f"WITH {_V} SELECT asset_id, revision_id, revision FROM v QUALIFY revision = 1 OR row_number() OVER (PARTITION BY asset_id ORDER BY revision DESC) <= 199",
    "changed": f"WITH {_V} SELECT asset_id, revision_id, revision, payload FROM v QUALIFY payload IS DISTINCT FROM lag(payload) OVER (PARTITION BY asset_id ORDER BY revision)",
    "next_numbers": f"WITH {_V} SELECT asset_id, max(revision) + 1 AS next_revision FROM v GROUP BY 1",
    "upserted": f"WITH {_V} SELECT asset_id, CASE WHEN revision = 3 THEN 1 ELSE 0 END AS wave, payload FROM v WHERE revision IN (1, 3) QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY revision DESC) = 1",
    "unanimous": f"WITH {_V} SELECT asset_id, min(payload) AS payload, count(*) AS revisions FROM v GROUP BY 1 HAVING count(DISTINCT payload) = 1",
    "matched_stems": f"WITH {_S} SELECT stem, source_id, reference_id FROM p",
    "ambiguous_sources": f"WITH {_S} SELECT source_id, stem FROM g",
    "unmatched_sources": f"WITH {_S} SELECT source_id, stem FROM l WHERE stem NOT IN (SELECT stem FROM r)",
    "unmatched_references": f"WITH {_S} SELECT reference_id, stem FROM r WHERE stem NOT IN (SELECT stem FROM l)",
    "match_summary": f"WITH {_S}, a AS (SELECT count(*) AS sources, arg_min(stem, source_id) AS f, arg_max(stem, source_id) AS t FROM l), b AS (SELECT count(*) AS refs, arg_min(stem, reference_id) AS f, arg_max(stem, reference_id) AS t FROM r), c AS (SELECT count(*) AS matched FROM p), d AS (SELECT count(*) AS ambiguous FROM g) SELECT sources, refs, matched, ambiguous, a.f = b.f AS start_aligned, a.t = b.t AS end_aligned, matched = 0 AND ambiguous = 0 AND sources = refs AND sources > 0 AS order_fallback FROM a, b, c, d",
}
