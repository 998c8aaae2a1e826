"""The driver's tables read as captures, pairs and reviews.

The tables hold no images, so a pair's measurements are stand-ins: digits of an
MD5 over the pair's ids and the metric's name, scaled so that every rule meets
both sides of its limits. ``PAIRS_SQL`` makes the same table in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pairs import neighbour_pairs

MAX_GAP = 3
#: metric -> (scale, power): scale * u**power for a u in [0, 1].
METRICS = {
    "feature_overlap": (0.6, 1), "registration_alignment_score": (1.0, 1), "inlier_ratio": (1.0, 1), "x_span": (1.0, 1), "y_span": (1.0, 1),
    "changed_fraction": (1.0, 1), "unmatched_ink_fraction": (0.02, 3), "unmatched_ink_union_fraction": (0.5, 3),
    "ink_mismatch_tiles_fraction": (0.9, 3), "largest_ink_component_fraction": (0.05, 2), "residual_tiles_changed_fraction": (0.5, 2),
    "occlusion_area_fraction": (0.9, 1), "occlusion_residual_capture": (1.0, 1), "occlusion_rectangularity": (1.0, 1),
    "occlusion_material_fraction": (1.0, 1), "occlusion_material_median": (0.08, 2), "outside_unmatched_ink_fraction": (0.05, 3),
    "outside_unmatched_ink_union_fraction": (0.3, 3), "outside_ink_mismatch_tiles_fraction": (0.6, 2),
    "inside_unmatched_ink_union_fraction": (1.0, 1), "occlusion_ink_mismatch_capture": (1.0, 1), "occlusion_localization_contrast": (0.6, 1),
}
#: whole-number metric -> how many values.
COUNTS = {"occlusion_candidate_count": 4, "full_page_occlusion_count": 3, "page_count": 3}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as captures: a sequence for every source and language, in order of doc_id."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("image_id"), F.concat_ws("-", "source", "lang").alias("sequence_id"), F.concat(F.lit("p"), (F.col("doc_id") % 7 / 5).cast("int").cast("string"), F.lit("x"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("path")
    )


def _digits(name: str) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(name), F.col("first_image_id"), F.col("second_image_id"))), 1, 6), 16, 10).cast("long")


def _unit(name: str) -> Column:
    return (_digits(name) % 1001) / F.lit(1000.0)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring captures with their measurements."""
    near = neighbour_pairs(images(spark, sf_dir), "sequence_id", ["image_id"], ["image_id", "path"], MAX_GAP)
    out = near.select(
        "sequence_id", F.col("a.image_id").alias("first_image_id"), F.col("b.image_id").alias("second_image_id"),
        F.col("a.path").alias("first_path"), F.col("b.path").alias("second_path"), F.col("gap").cast("int").alias("index_gap"),
    )
    # the measurements and rules cost far more than the pairs, which come in a task for every block of items
    out = out.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "first_image_id", "second_image_id")
    # one digest a metric is computed in a step of its own, as the powers use it again
    out = out.withColumns({f"_u_{name}": _unit(name) for name in METRICS})
    columns = {"registration_model": F.when(_digits("model") % 9 > 0, "affine"), "registration_fallback_used": _digits("fallback") % 5 == 0}
    columns["valid_fraction"] = F.lit(0.5) + F.lit(0.5) * F.sqrt(_unit("valid_fraction"))
    for name, (scale, power) in METRICS.items():
        value = F.lit(scale) * F.col(f"_u_{name}")
        for _ in range(power - 1):
            value = value * F.col(f"_u_{name}")
        columns[name] = value
    for name, n in COUNTS.items():
        columns[name] = (_digits(name) % n + (1 if name == "page_count" else 0)).cast("int")
    return out.withColumns(columns).drop(*(f"_u_{name}" for name in METRICS))


def _sql_digits(name: str) -> str:
    return f"CAST('0x' || substr(md5('{name}:' || first_image_id || ':' || second_image_id), 1, 6) AS BIGINT)"


def _sql_unit(name: str) -> str:
    return f"(({_sql_digits(name)} % 1001) / CAST(1000 AS DOUBLE))"


_SQL_METRICS = ",\n  ".join(
    [f"CAST({scale} AS DOUBLE)" + f" * {_sql_unit(name)}" * power + f" AS {name}" for name, (scale, power) in METRICS.items()]
    + [f"CAST({_sql_digits(name)} % {n} + {1 if name == 'page_count' else 0} AS INTEGER) AS {name}" for name, n in COUNTS.items()]
)
IMAGES_SQL = "SELECT doc_id AS image_id, source || '-' || lang AS sequence_id, 'p' || ((doc_id % 7) // 5) || 'x' || doc_id || '.jpg' AS path FROM documents"
#: CTEs ``images`` and ``pairs``.
PAIRS_SQL = f"""images AS ({IMAGES_SQL}), placed AS (
  SELECT *, row_number() OVER (PARTITION BY sequence_id ORDER BY image_id) AS n FROM images
), near AS (
  SELECT a.sequence_id, a.image_id AS first_image_id, b.image_id AS second_image_id, a.path AS first_path, b.path AS second_path,
         CAST(b.n - a.n AS INTEGER) AS index_gap
  FROM placed a JOIN placed b ON a.sequence_id = b.sequence_id AND b.n > a.n AND b.n <= a.n + {MAX_GAP}
), pairs AS (
  SELECT *, CASE WHEN {_sql_digits('model')} % 9 > 0 THEN 'affine' END AS registration_model,
  {_sql_digits('fallback')} % 5 = 0 AS registration_fallback_used,
  CAST(0.5 AS DOUBLE) + CAST(0.5 AS DOUBLE) * sqrt({_sql_unit('valid_fraction')}) AS valid_fraction,
  {_SQL_METRICS}
  FROM near
)"""


def scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with a score that leans to the truth, and a split by document."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit("score:"), F.col("doc_id").cast("string"))), 1, 6), 16, 10).cast("long")
    return table(spark, sf_dir, "labels").where("quality is not null").select(
        "doc_id", F.col("quality").cast("int").alias("truth"), (((h % 801) + F.when(F.col("quality") == 1, 200).otherwise(0)) / F.lit(1000.0)).alias("p"),
        F.element_at(F.array(*map(F.lit, ("development", "selection", "locked_audit"))), (h % 3 + 1).cast("int")).alias("split"),
        (h % 7 == 0).alias("contradiction"), (h % 4 + 1).cast("int").alias("index_gap"),
        F.when(h % 6 > 0, (h % 101) / F.lit(100.0)).alias("registration_alignment_score"),
    )


LABELS_SQL = """hashed AS (
  SELECT *, CAST('0x' || substr(md5('score:' || doc_id), 1, 6) AS BIGINT) AS h FROM labels WHERE quality IS NOT NULL
), scored AS (
  SELECT doc_id, quality AS truth, (h % 801 + CASE WHEN quality = 1 THEN 200 ELSE 0 END) / CAST(1000 AS DOUBLE) AS p,
         ['development', 'selection', 'locked_audit'][h % 3 + 1] AS split, h % 7 = 0 AS contradiction, CAST(h % 4 + 1 AS INTEGER) AS index_gap,
         CASE WHEN h % 6 > 0 THEN (h % 101) / CAST(100 AS DOUBLE) END AS registration_alignment_score
  FROM hashed
)"""
