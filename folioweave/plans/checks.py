"""Queries of the validation, report and image operators, and their SQL where there is any.

Runs, annotations and submissions are read from documents and line items, with
faults at fixed ids so that every check meets both sides. Images are drawn from
the table of regions, as the driver's tables hold none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import api
from ..operators import reports, validate
from .captures import LABELS_SQL, scored_labels, table

c = F.col


# --- runs, manifests, annotations


def run_validation(spark: SparkSession, d: str) -> DataFrame:
    """Documents as sources, images, clusters of four neighbouring ids and crops, with faults at some ids."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("none")).alias("folder"), F.coalesce("n_chars", F.lit(0)).cast("long").alias("n"))
    path = F.concat(F.lit("/"), "folder", F.lit("/"), c("doc_id").cast("string"))
    sources = docs.where("doc_id % 97 != 1").select(path.alias("path"), "folder", F.lit(100).alias("width"), F.lit(50).alias("height"), F.when(c("doc_id") % 89 == 2, "broken").alias("error"))
    images = docs.where("doc_id % 83 != 3").select(c("doc_id").cast("string").alias("image_id"), path.alias("path"), (c("doc_id") % 4).cast("int").alias("sequence_index"))
    clusters = docs.groupBy(F.concat("folder", F.lit("-"), F.floor(c("doc_id") / 16).cast("string")).alias("cluster_id")).agg(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")).alias("image_ids"))
    crops = docs.select(
        F.concat(F.lit("s"), (c("doc_id") - F.when(c("doc_id") % 101 == 4, 1).otherwise(0)).cast("string")).alias("submission_id"), path.alias("path"),
        F.array(F.lit(0), F.lit(0), (c("n") % 103).cast("int"), F.lit(50)).alias("bbox"), F.lit("crop").alias("crop_path"), (c("doc_id") % 79).cast("int").alias("crop_bytes"),
    )
    return validate.run_problems(sources, images, clusters, crops, max_size=3)


def manifest_rules(spark: SparkSession, d: str) -> DataFrame:
    rows = scored_labels(spark, d)
    accepted = F.floor(c("doc_id") / 3) % 2 == 0
    manifest = rows.select(
        F.floor(c("doc_id") / 3).cast("string").alias("original_cluster_id"), F.when(accepted & (c("doc_id") % 41 != 5), "accepted").otherwise("rejected").alias("review_decision"),
        F.when(accepted, "approved").otherwise("dissolved").alias("cluster_status"), F.when(accepted, "accepted_cluster").otherwise("rejected_singleton").alias("assignment_type"),
        accepted.alias("included_in_original_cluster"), F.when(accepted, F.floor(c("doc_id") / 3)).otherwise(1_000_000_000 + F.floor(c("doc_id") / 31)).cast("string").alias("assignment_id"),
        (c("doc_id") - F.when(c("doc_id") % 53 == 6, 1).otherwise(0)).cast("string").alias("image_id"), F.concat(F.lit("images/"), c("doc_id").cast("string")).alias("package_relative_path"),
    )
    files = rows.where("doc_id % 47 != 7").select(c("doc_id").cast("string").alias("path"))
    return validate.manifest_rule_problems(manifest, files=files)


def subtype_checks(spark: SparkSession, d: str) -> DataFrame:
    """Annotations of groups of two labels, faulty in one of several ways by their digits."""
    groups = scored_labels(spark, d).groupBy(F.floor(c("doc_id") / 2).cast("string").alias("original_cluster_id")).agg(F.array_sort(F.collect_list(c("doc_id").cast("string"))).alias("image_ids"), F.min("doc_id").alias("k"))
    first, last = F.get("image_ids", F.lit(0)), F.element_at("image_ids", -1)
    material, k = c("k") % 4 < 2, c("k")
    pick = lambda n, odd, plain: F.when(k % 23 == n, odd).otherwise(plain)
    listed = lambda x: F.to_json(F.when(material, F.array(x)).otherwise(F.array().cast("array<string>")))
    named = lambda x: F.when(material, x).otherwise("")
    rows = groups.select(
        "original_cluster_id", pick(1, F.to_json(F.reverse("image_ids")), F.to_json("image_ids")).alias("member_image_ids_json"), material.cast("string").alias("material_occlusion_metric_included"),
        pick(2, F.lit("same_clean"), F.when(material, "same_occluded").otherwise("same_clean")).alias("occlusion_subtype"), pick(3, F.lit(" "), F.lit("seen")).alias("evidence"), F.lit("").alias("uncertainty_notes"),
        F.lit("rule").alias("annotator_method"), pick(4, F.lit("uncertain_or_other"), F.when(material, "material_physical_occlusion").otherwise("same_document_state_or_content_change")).alias("visual_relationship_category"),
        pick(5, F.lit("sticker"), F.lit("none")).alias("visual_overlay_category"), pick(6, F.lit("low"), F.when(material, "high").otherwise("none")).alias("meaningful_hidden_content_risk"),
        F.when(material, "large").otherwise("none").alias("occlusion_size_category"), F.lit("easy").alias("registration_difficulty"),
        pick(7, F.lit("0x"), named(first)).alias("affected_image_id"), named(first).alias("occluded_image_id"), pick(8, F.lit(""), named(last)).alias("better_view_image_id"),
        listed(first).alias("affected_image_ids_json"), listed(first).alias("occluded_image_ids_json"), listed(last).alias("better_view_image_ids_json"),
    ).where("cast(original_cluster_id as long) % 61 != 9")
    return validate.subtype_problems(rows, groups)


def label_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Labels on pairs of neighbouring ids, half of which were compared."""
    rows = scored_labels(spark, d)
    images = rows.select(c("doc_id").cast("string").alias("image_id"), F.concat(F.lit("/x/"), c("doc_id").cast("string"), F.lit(".png")).alias("path"))
    name = lambda x: F.concat(x.cast("string"), F.lit(".png"))
    labels = rows.select(F.when(c("truth") == 1, "near_duplicates").otherwise("hard_negatives").alias("category"), name(c("doc_id") + 1).alias("first_filename"), name(c("doc_id")).alias("second_filename"), (c("truth") == 1).alias("expected_same_document"))
    compared = rows.where("doc_id % 2 = 0").select(c("doc_id").cast("string").alias("first_image_id"), (c("doc_id") + 1).cast("string").alias("second_image_id"), (c("p") >= 0.5).alias("same_document"))
    return validate.label_pairs(labels, images, compared).select("category", "first_filename", "second_filename", "expected_same_document", "actual_same_document", "found", "passed")


# --- reports


def state_calibration(spark: SparkSession, d: str) -> DataFrame:
    p, q = c("p"), c("index_gap") / F.lit(8.0)
    size = F.element_at(F.array(*map(F.lit, ("small", "medium", "large"))), (c("doc_id") % 3 + 1).cast("int"))
    rows = scored_labels(spark, d).select(
        (c("truth") == 1).alias("truth_same_document"), F.when(c("doc_id") % 5 > 0, c("doc_id") % 2 == 0).alias("material"), size.alias("size_category"), (p * (1 - q)).alias("same_clean_probability"),
        (p * q).alias("same_occluded_probability"), (1 - p).alias("different_document_probability"),
    )
    return reports.state_calibration(rows).withColumns({x: F.round(x, 6) for x in ("log_loss", "brier")})


def dispositions(spark: SparkSession, d: str) -> DataFrame:
    """Line items as submissions, parts as their sources."""
    rows = table(spark, d, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("submission_id"), c("l_partkey").cast("string").alias("path"),
        F.array(F.lit(0), F.lit(0), (c("l_quantity") * 2).cast("int"), (c("l_suppkey") % 60).cast("int")).alias("bbox"),
        F.when(c("l_linestatus") == "O", "page_state").otherwise("base_page").alias("kind"),
        F.when(c("l_returnflag") == "A", "partial_best_available").when(c("l_linenumber") == 7, "review_required").otherwise("complete").alias("completeness"),
        (F.lit(0.5) + c("l_discount")).alias("confidence"), F.lit("crop").alias("crop_path"), (c("l_orderkey") % 11).cast("int").alias("crop_bytes"),
    )
    sources = table(spark, d, "part").where("p_partkey % 13 != 0").select(c("p_partkey").cast("string").alias("path"), F.lit(100).alias("width"), F.lit(55).alias("height"))
    out = reports.recogniser_rows(rows, sources)
    return out.groupBy("disposition", "kind", F.array_join("review_reasons", "; ").alias("reasons")).agg(F.count("*").alias("n"))


def native_groups(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    ids = docs.select(c("doc_id").alias("image_id"))
    native = docs.where("doc_id % 3 != 0").select(c("doc_id").alias("image_id"), F.floor(c("doc_id") / 10).alias("cluster_id"))
    return reports.native_components(ids, native, ids)


def promotion(spark: SparkSession, d: str) -> DataFrame:
    rows = scored_labels(spark, d)
    wrong = F.when(c("contradiction") & (c("truth") == 0), "automatic_false_link").otherwise("correctly_separated")
    return reports.promotion_gates(rows.select(wrong.alias("status")))


# --- images


def drawn(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(images, contents): one sequence of three captures of each region's form: with its writing, again elsewhere, and under a sheet."""

    def form(name: str, shot: int) -> bytes:
        rng = np.random.default_rng(int(hashlib.md5(name.encode()).hexdigest()[:8], 16))
        page = np.full((600, 420), 238, np.uint8)
        page[[20, 21, 578, 579], 20:400] = 40
        page[70:550:45, 35:385] = 100
        for y in range(66, 560, 45):
            for x in range(40, 380, 9):
                if rng.random() < 0.6:
                    page[y - int(rng.integers(8, 20)) : y, x : x + 2] = 25
                    page[y - 2 : y, x : x + int(rng.integers(3, 7))] = 25
        if shot == 1:
            page = np.pad(page, ((6, 0), (0, 4)), constant_values=238)[:600, 4:]
        if shot == 2:
            page[150:390, 50:370] = 246
            page[[150, 151, 388, 389], 50:370] = 80
            page[150:390, [50, 51, 368, 369]] = 80
            for y in range(180, 380, 22):
                for x in range(64, 350, 8):
                    if rng.random() < 0.7:
                        page[y - int(rng.integers(6, 15)) : y, x : x + 2] = 20
        return b"P5\n420 600\n255\n" + page.tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, names, shots = (x.to_pylist() for x in batch.columns)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([form(n, s) for n, s in zip(names, shots)], pa.binary())], ["image_id", "content"])

    shots = table(spark, d, "region").select("r_name", "r_regionkey", F.explode(F.array(*map(F.lit, range(3)))).alias("shot"))
    number = c("r_regionkey") * 3 + c("shot")
    name = F.concat(F.lit("p"), F.lpad(number.cast("string"), 4, "0"), F.lit(".pgm"))
    images = shots.select(name.alias("image_id"), name.alias("path"), F.lit("drawn").alias("sequence_id"), number.cast("int").alias("sequence_index"), "r_name", "shot")
    # a page costs a second or so
    contents = images.select("image_id", "r_name", "shot").repartition(16, "image_id").mapInArrow(run, "image_id string, content binary")
    return images.drop("r_name", "shot"), contents


def image_groups(spark: SparkSession, d: str) -> DataFrame:
    """From drawn images to groups: decoding, registration, measurements, rules, constrained groups."""
    clusters = api.cluster_files(*drawn(spark, d))["clusters"]
    return clusters.select("cluster_id", "sequence_id", F.array_join("image_ids", ",").alias("images"), "representative_image_id")


def crop_submissions(spark: SparkSession, d: str) -> DataFrame:
    """From drawn images to submissions, in groups by their registrations."""
    found = api.crop_groups(*drawn(spark, d))["submissions"]
    return found.select("group_id", "submission_id", "image_id", "kind", "side", F.array_join(F.col("bbox").cast("array<string>"), ",").alias("bbox"), "completeness", "bucket")


QUERIES = {f.__name__: f for f in (run_validation, manifest_rules, subtype_checks, label_outcomes, state_calibration, dispositions, native_groups, promotion, image_groups, crop_submissions)}

SQL = {
    "run_validation": """
WITH d AS (
  SELECT doc_id, coalesce(source, 'none') AS folder, coalesce(n_chars, 0) AS n, '/' || coalesce(source, 'none') || '/' || doc_id AS path FROM documents
), src AS (SELECT * FROM d WHERE doc_id % 97 <> 1), img AS (SELECT *, doc_id % 4 AS i FROM d WHERE doc_id % 83 <> 3
), clu AS (SELECT *, folder || '-' || (doc_id // 16) AS cluster_id FROM d
), mem AS (
  SELECT c.cluster_id, count(*) AS n, count(DISTINCT s.folder) AS folders, list(i.i ORDER BY c.doc_id) AS seq
  FROM clu c LEFT JOIN img i USING (doc_id) LEFT JOIN src s ON s.path = i.path GROUP BY 1
), crop AS (
  SELECT 's' || (doc_id - CASE WHEN doc_id % 101 = 4 THEN 1 ELSE 0 END) AS sid, path, n % 103 AS x1, doc_id % 79 AS bytes FROM d
)
SELECT path AS subject, 'source image in no sequence' AS problem FROM src WHERE path NOT IN (SELECT path FROM img)
UNION ALL SELECT path, 'image that is no source' FROM img WHERE path NOT IN (SELECT path FROM src)
UNION ALL SELECT cluster_id, 'cluster is too large' FROM mem WHERE n > 3
UNION ALL SELECT cluster_id, 'cluster spans folders' FROM mem WHERE folders <> 1
UNION ALL SELECT cluster_id, 'members out of order' FROM mem WHERE seq <> list_sort(seq, 'ASC', 'NULLS LAST')
UNION ALL SELECT path, 'image cannot be decoded' FROM src WHERE doc_id % 89 = 2
UNION ALL SELECT sid, 'submission id twice' FROM crop GROUP BY sid HAVING count(*) > 1
UNION ALL SELECT sid, 'crop of an unknown source' FROM crop WHERE path NOT IN (SELECT path FROM src)
UNION ALL SELECT sid, 'crop outside its source' FROM crop WHERE path IN (SELECT path FROM src) AND NOT (x1 > 0 AND x1 <= 100)
UNION ALL SELECT sid, 'crop file missing or empty' FROM crop WHERE bytes = 0""",
    "manifest_rules": f"""
WITH {LABELS_SQL}, m AS (
  SELECT CAST(doc_id // 3 AS VARCHAR) AS g, (doc_id // 3) % 2 = 0 AS approved, (doc_id // 3) % 2 = 0 AND doc_id % 41 <> 5 AS accepted,
    CASE WHEN (doc_id // 3) % 2 = 0 THEN doc_id // 3 ELSE 1000000000 + doc_id // 31 END AS assignment,
    doc_id - CASE WHEN doc_id % 53 = 6 THEN 1 ELSE 0 END AS image, doc_id FROM scored
), grp AS (
  SELECT g, count(DISTINCT accepted) AS kinds, min(CASE WHEN accepted THEN 'accepted' ELSE 'rejected' END) AS first, count(DISTINCT assignment) AS ids, count(*) AS n, bool_or(approved <> accepted) AS wrong
  FROM m GROUP BY g
)
SELECT g AS original_cluster_id, 'decisions are mixed' AS problem FROM grp WHERE kinds <> 1
UNION SELECT g, 'a row contradicts its decision' FROM grp WHERE wrong
UNION SELECT g, 'accepted group without one shared assignment' FROM grp WHERE first = 'accepted' AND ids <> 1
UNION SELECT g, 'rejected group without assignments of their own' FROM grp WHERE first = 'rejected' AND ids <> n
UNION SELECT g, 'an assignment spans groups' FROM m WHERE assignment IN (SELECT assignment FROM m GROUP BY 1 HAVING count(DISTINCT g) > 1)
UNION SELECT min(g), 'an image in several rows' FROM m GROUP BY image HAVING count(*) > 1
UNION SELECT g, 'an image file is missing' FROM m WHERE doc_id % 47 = 7""",
    "subtype_checks": f"""
WITH {LABELS_SQL}, g AS (
  SELECT CAST(doc_id // 2 AS VARCHAR) AS g, list(CAST(doc_id AS VARCHAR) ORDER BY CAST(doc_id AS VARCHAR)) AS ids, min(doc_id) AS k FROM scored GROUP BY 1
), a AS (
  SELECT *, k % 4 < 2 AS material, k % 23 AS fault, ids[1] AS first, ids[len(ids)] AS last, CAST(g AS BIGINT) % 61 = 9 AS bare FROM g
)
SELECT g AS original_cluster_id, p AS problem FROM (
  SELECT g, unnest([
    CASE WHEN bare THEN 'group without annotation' END,
    CASE WHEN NOT bare AND fault = 1 AND list_reverse(ids) <> ids THEN 'members differ from the group' END,
    CASE WHEN NOT bare AND fault = 2 AND material THEN 'material row with another subtype' END,
    CASE WHEN NOT bare AND fault = 3 THEN 'evidence or annotator is missing' END,
    CASE WHEN NOT bare AND fault = 4 THEN 'visual_relationship_category is unknown or unsettled' END,
    CASE WHEN NOT bare AND fault = 4 AND material THEN 'material row with another relationship' END,
    CASE WHEN NOT bare AND fault = 5 THEN 'visual_overlay_category is unknown or unsettled' END,
    CASE WHEN NOT bare AND fault = 6 AND NOT material THEN 'clean row with risk or size' END,
    CASE WHEN NOT bare AND fault = 7 THEN 'affected image is no member' END,
    CASE WHEN NOT bare AND fault = 7 THEN 'affected image and list disagree' END,
    CASE WHEN NOT bare AND fault = 8 AND material THEN 'better_view image and list disagree' END,
    CASE WHEN NOT bare AND material AND first = last THEN 'an image both occluded and better' END
  ]) AS p FROM a
) WHERE p IS NOT NULL""",
    "label_outcomes": f"""
WITH {LABELS_SQL}
SELECT CASE WHEN s.truth = 1 THEN 'near_duplicates' ELSE 'hard_negatives' END AS category, (s.doc_id + 1) || '.png' AS first_filename, s.doc_id || '.png' AS second_filename,
  s.truth = 1 AS expected_same_document, CASE WHEN o.doc_id IS NOT NULL AND s.doc_id % 2 = 0 THEN s.p >= 0.5 END AS actual_same_document, o.doc_id IS NOT NULL AND s.doc_id % 2 = 0 AS found,
  o.doc_id IS NOT NULL AND CASE WHEN s.doc_id % 2 = 0 THEN (s.p >= 0.5) = (s.truth = 1) ELSE s.truth <> 1 END AS passed
FROM scored s LEFT JOIN scored o ON o.doc_id = s.doc_id + 1""",
    "state_calibration": f"""
WITH {LABELS_SQL}, r AS (
  SELECT truth = 1 AS same, CASE WHEN doc_id % 5 > 0 THEN doc_id % 2 = 0 END AS material, ['small', 'medium', 'large'][doc_id % 3 + 1] AS size, p, index_gap / CAST(8 AS DOUBLE) AS q FROM scored
), t AS (SELECT * FROM r WHERE NOT same OR material IS NOT NULL), s AS (
  SELECT same, size, 'clean' AS state, p * (1 - q) AS x, CAST(same AND NOT coalesce(material, false) AS INTEGER) AS y FROM t
  UNION ALL SELECT same, size, 'occluded', p * q, CAST(same AND coalesce(material, false) AS INTEGER) FROM t
  UNION ALL SELECT same, size, 'different', 1 - p, CAST(NOT same AS INTEGER) FROM t
), l AS (
  SELECT *, least(1 - 1e-15, greatest(1e-15, x)) AS z FROM s
)
SELECT state, CAST(NULL AS VARCHAR) AS size, count(*) AS count, round(avg(-(y * ln(z) + (1 - y) * ln(1 - z))), 6) AS log_loss, round(avg((x - y) * (x - y)), 6) AS brier FROM l GROUP BY state
UNION ALL SELECT 'occluded_by_size', size, count(*), round(avg(-(y * ln(z) + (1 - y) * ln(1 - z))), 6), round(avg((x - y) * (x - y)), 6) FROM l WHERE state = 'occluded' AND same GROUP BY size""",
    "dispositions": """
WITH r AS (
  SELECT CASE WHEN l_linestatus = 'O' THEN 'data_bearing_overlay' ELSE 'base_page' END AS kind, l_returnflag = 'A' AS partial,
    concat_ws('; ', CASE WHEN l_returnflag <> 'A' AND l_linenumber = 7 THEN 'the cropper was not sure' END, CASE WHEN 0.5 + l_discount < 0.55 THEN 'low confidence' END,
      CASE WHEN l_orderkey % 11 = 0 THEN 'crop file missing or empty' END,
      CASE WHEN p_partkey IS NULL THEN 'size of the source unknown'
        WHEN NOT (CAST(l_quantity * 2 AS INTEGER) BETWEEN 1 AND 100 AND l_suppkey % 60 BETWEEN 1 AND 55) THEN 'box outside the source' END) AS reasons
  FROM lineitem LEFT JOIN (SELECT DISTINCT p_partkey FROM part WHERE p_partkey % 13 <> 0) ON p_partkey = l_partkey
)
SELECT CASE WHEN reasons <> '' THEN 'REVIEW REQUIRED' WHEN partial THEN 'SUBMIT PARTIAL' ELSE 'SUBMIT COMPLETE' END AS disposition, kind, reasons, count(*) AS n FROM r GROUP BY 1, 2, 3""",
    "native_groups": """
SELECT doc_id AS image_id, CASE WHEN doc_id % 3 <> 0 THEN min(CASE WHEN doc_id % 3 <> 0 THEN doc_id END) OVER (PARTITION BY doc_id // 10) ELSE doc_id END AS root FROM documents""",
    "promotion": f"""
WITH {LABELS_SQL}, g AS (SELECT NOT coalesce(bool_or(contradiction AND truth = 0), false) AS ok FROM scored)
SELECT ok AS no_automatic_false_link, true AS no_contaminated_component, ok AS promotable FROM g""",
}
