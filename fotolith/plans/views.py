"""Items of a culling view: issues, review counts, the shown member of a group, relationship, filters,
order and selection (B4-B7, B15, D5, D3's selected count, E2, F7).

Adapter: an order line is a photograph, its order the visual group, its supplier the job; lines of one
part and quantity are byte-identical copies; quantity gives the score, other columns the reasons.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fotolith.functions.scalars import stars
from fotolith.plans.duplicates import families
from fotolith.sources.tables import table

#: Reason codes with their severity, in order, and when the adapter gives them.
REASONS = (("severe_subject_softness", "major", "l_quantity < 4"), ("eyes_closed", "review", "l_tax >= 0.08"), ("clipping", "issue", "l_discount >= 0.09"), ("tilted", "info", "l_tax > 0.05"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a photograph. Group and family facts are aggregates joined back, which combine before the
    shuffle and whose join Spark can split, so that a hot group is never one window's partition."""
    reasons = F.filter(F.array(*[F.when(F.expr(when), F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for code, severity, when in REASONS]), lambda r: r.isNotNull())
    x = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("job_id"), F.col("l_orderkey").alias("group_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("asset_id"), F.concat_ws("_", F.lit("IMG"), "l_partkey", "l_linenumber").alias("filename"),
        F.col("l_partkey").alias("sha256"), F.col("l_quantity").alias("byte_length"), F.col("l_quantity").alias("score"), (F.col("l_linestatus") == "F").alias("selected"), reasons.alias("reasons"),
        F.when(F.col("l_returnflag") == "R", "similar").when(F.col("l_returnflag") == "A", "near_duplicate").otherwise("burst").alias("kind"),
    )
    groups = x.groupBy("group_id").agg(F.max("score").alias("best"), F.count("*").alias("group_size"))
    x = x.join(groups, "group_id").join(families(x), ["sha256", "byte_length"], "left")
    grouped, family = F.col("group_size") > 1, F.col("canonical_id").isNotNull()
    return x.select(
        "job_id", F.when(grouped, F.col("group_id")).alias("group_id"), "asset_id", "filename", "score", stars(F.col("score") * 2).alias("rating"), "selected", "reasons", F.when(grouped, F.col("kind")).alias("kind"),
        F.when(grouped, F.col("best") - F.col("score")).alias("relative"), "canonical_id", F.when(family, "exact").when(grouped, F.col("kind")).otherwise("unique").alias("relationship"),
    )


def issues(reasons: Column) -> Column:
    """Severe softness makes blurry, closed eyes closed_eyes."""
    has = lambda code: F.exists(reasons, lambda r: r["code"] == code)
    return F.array_compact(F.array(F.when(has("severe_subject_softness"), "blurry"), F.when(has("eyes_closed"), "closed_eyes")))


def to_review(reasons: Column) -> Column:
    """Reasons of severity review, issue or major."""
    return F.size(F.filter(reasons, lambda r: r["severity"].isin("review", "issue", "major"))).cast("long")


def own(items: DataFrame) -> Column:
    """Whether an item is no redundant copy of another."""
    return F.col("canonical_id").isNull() | (F.col("canonical_id") == F.col("asset_id"))


def shown(items: DataFrame) -> DataFrame:
    """With `preferred`: of each near or burst group one item that is no redundant copy, the least of how
    far it is from the best, filename, id (E2)."""
    of = items.where(F.col("kind").isin("near_duplicate", "burst") & own(items))
    best = of.groupBy("group_id").agg(F.min(F.struct(F.coalesce("relative", F.lit(float("inf"))).alias("r"), "filename", "asset_id"))["asset_id"].alias("winner"))
    return items.join(best, "group_id", "left").withColumn("preferred", F.coalesce(F.col("winner") == F.col("asset_id"), F.lit(False))).drop("winner")


def matches(relationship: str) -> Column:
    """The relationship filter."""
    return {"all": F.lit(True), "exact": F.col("relationship") == "exact", "near_similar": F.col("group_id").isNotNull(), "preferred": F.col("preferred"), "unique": F.col("relationship") == "unique"}[relationship]


def filtered(items: DataFrame, ratings: tuple[int, ...] = (), selected_only: bool = False, relationship: str = "all", hide_duplicates: bool = False, hide_blurry: bool = False, hide_closed_eyes: bool = False) -> DataFrame:
    """The view filter over shown items (B6); no ratings mean any."""
    keep = matches(relationship)
    if ratings:
        keep &= F.col("rating").isin(*ratings)
    if selected_only:
        keep &= F.col("selected")
    if hide_duplicates:
        keep &= own(items) & (F.col("preferred") | ~F.coalesce(F.col("kind").isin("near_duplicate", "burst"), F.lit(False)))
    for hide, issue in ((hide_blurry, "blurry"), (hide_closed_eyes, "closed_eyes")):
        if hide:
            keep &= ~F.array_contains(issues(F.col("reasons")), issue)
    return items.where(keep)


def item_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = items(spark, sf_dir)
    return x.select("asset_id", F.array_join(issues(F.col("reasons")), ",").alias("issues"), to_review(F.col("reasons")).alias("review_count"))


def shown_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(items(spark, sf_dir)).where("preferred").select("group_id", "asset_id", "kind")


def relationship_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of each job that each relationship filter keeps."""
    names = ("all", "exact", "near_similar", "preferred", "unique")
    return shown(items(spark, sf_dir)).groupBy("job_id").agg(*[F.count_if(matches(n)).alias(f"n_{n}") for n in names], F.count_if("selected").alias("selected_count"))


def view_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job's view of items rated 2 or more without duplicates and blurry ones, by rating (none counts
    as 0), then filename, then id."""
    x = filtered(shown(items(spark, sf_dir)), ratings=(2, 3, 4, 5), hide_duplicates=True, hide_blurry=True)
    order = Window.partitionBy("job_id").orderBy(F.coalesce("rating", F.lit(0)).desc(), "filename", "asset_id")
    return x.select("job_id", "asset_id", "rating", F.row_number().over(order).alias("place"))


def selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot: every item's flag, rated 3 or more and no redundant exact copy."""
    x = items(spark, sf_dir)
    return x.select("job_id", "asset_id", (F.col("rating").isin(3, 4, 5) & own(x)).alias("selected"))


QUERIES = {f.__name__: f for f in (item_issues, shown_members, relationship_counts, view_order, selection)}
_HAS = {code: f"({when})" for code, _, when in REASONS}
_I = f"""b AS (SELECT *, l_orderkey * 10 + l_linenumber AS asset_id, count(*) OVER (PARTITION BY l_orderkey) AS gs, max(l_quantity) OVER (PARTITION BY l_orderkey) AS best, count(DISTINCT l_orderkey * 10 + l_linenumber) OVER (PARTITION BY l_partkey, l_quantity) AS fs FROM lineitem),
i AS (SELECT l_suppkey AS job_id, CASE WHEN gs > 1 THEN l_orderkey END AS group_id, asset_id, concat_ws('_', 'IMG', l_partkey, l_linenumber) AS filename, l_quantity AS score,
  CASE WHEN l_quantity < 10 THEN 1 WHEN l_quantity < 20 THEN 2 WHEN l_quantity < 32.5 THEN 3 WHEN l_quantity < 44 THEN 4 ELSE 5 END AS rating, l_linestatus = 'F' AS selected, {", ".join(f"{w} AS {c}" for c, w in _HAS.items())},
  CASE WHEN gs > 1 THEN CASE l_returnflag WHEN 'R' THEN 'similar' WHEN 'A' THEN 'near_duplicate' ELSE 'burst' END END AS kind, CASE WHEN gs > 1 THEN best - l_quantity END AS relative,
  CASE WHEN fs > 1 THEN min(asset_id) OVER (PARTITION BY l_partkey, l_quantity) END AS canonical_id FROM b),
o AS (SELECT *, coalesce(canonical_id = asset_id, true) AS own FROM i),
w AS (SELECT group_id, asset_id FROM o WHERE own AND kind IN ('near_duplicate', 'burst') QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY relative, filename, asset_id) = 1),
s AS (SELECT o.*, w.asset_id IS NOT NULL AS preferred, CASE WHEN canonical_id IS NOT NULL THEN 'exact' WHEN kind IS NOT NULL THEN kind ELSE 'unique' END AS relationship FROM o LEFT JOIN w ON w.group_id = o.group_id AND w.asset_id = o.asset_id)"""
ORACLE_SQL = {
    "item_issues": f"WITH {_I} SELECT asset_id, concat_ws(',', CASE WHEN severe_subject_softness THEN 'blurry' END, CASE WHEN eyes_closed THEN 'closed_eyes' END) AS issues, CAST(severe_subject_softness AS BIGINT) + CAST(eyes_closed AS BIGINT) + CAST(clipping AS BIGINT) AS review_count FROM i",
    "shown_members": f"WITH {_I} SELECT group_id, asset_id, kind FROM s WHERE preferred",
    "relationship_counts": f"WITH {_I} SELECT job_id, count(*) AS n_all, count(*) FILTER (WHERE relationship = 'exact') AS n_exact, count(group_id) AS n_near_similar, count(*) FILTER (WHERE preferred) AS n_preferred, count(*) FILTER (WHERE relationship = 'unique') AS n_unique, count(*) FILTER (WHERE selected) AS selected_count FROM s GROUP BY 1",
    "view_order": f"WITH {_I} SELECT job_id, asset_id, rating, CAST(row_number() OVER (PARTITION BY job_id ORDER BY rating DESC, filename, asset_id) AS INTEGER) AS place FROM s WHERE rating >= 2 AND own AND (preferred OR kind IS NULL OR kind NOT IN ('near_duplicate', 'burst')) AND NOT severe_subject_softness",
    "selection": f"WITH {_I} SELECT job_id, asset_id, rating >= 3 AND own AS selected FROM o",
}
