"""Tables that leave the engine: what a model, a recogniser and a reviewer read, and the evaluation's reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..materialize import materialize
from ..sources import writers
from . import evaluate

c = F.col
LOW_CONFIDENCE = 0.55


def cluster_payloads(images: DataFrame, clusters: DataFrame, pairs: DataFrame) -> DataFrame:
    """A row for each cluster: members in order, its pairs, confidences of the accepted ones, models, largest gap, review_reasons, review_required."""
    members = clusters.select("cluster_id", "sequence_id", "representative_image_id", F.posexplode("image_ids").alias("_at", "image_id")).join(images.select("image_id", "path"), "image_id")
    listed = members.groupBy("cluster_id", "sequence_id").agg(
        F.count("*").alias("image_count"), F.array_sort(F.collect_list(F.struct("_at", "path"))).alias("_p"),
        F.max(F.when(c("image_id") == c("representative_image_id"), c("path"))).alias("representative_image_path"),
    )
    end = lambda side: members.select(c("image_id").alias(f"{side}_image_id"), c("cluster_id").alias(f"_{side}"))
    inside = pairs.join(end("first"), "first_image_id").join(end("second"), "second_image_id").where("_first = _second")
    sure = F.when(c("same_document"), c("confidence"))
    told = F.struct("first_image_id", "second_image_id", "same_document", "confidence", "index_gap", "registration_model")
    stats = inside.groupBy(c("_first").alias("cluster_id")).agg(
        F.min(sure).alias("confidence_min"), F.avg(sure).alias("confidence_mean"), F.max(sure).alias("confidence_max"),
        F.coalesce(F.max(F.when(c("same_document"), c("index_gap"))), F.lit(0)).alias("largest_gap"),
        F.array_sort(F.collect_set(F.when(c("same_document"), c("registration_model")))).alias("models"),
        F.array_sort(F.collect_list(told)).alias("pairs"), F.max((~c("same_document")).cast("int")).alias("_failed"),
    )
    rows = listed.join(stats, "cluster_id", "left").withColumns({"image_paths": F.transform("_p", lambda x: x["path"]), "connected_over_others": F.coalesce(c("_failed") == 1, F.lit(False))})
    reasons = F.filter(
        F.array(
            F.when((c("image_count") > 1) & c("confidence_min").isNull(), "no accepted pair inside"), F.when(c("confidence_min") < LOW_CONFIDENCE, "a weak accepted pair"),
            F.when(c("connected_over_others"), "a pair inside was not accepted"), F.when(c("largest_gap") > 1, "an accepted pair bridges a gap"),
        ),
        lambda x: x.isNotNull(),
    )
    return rows.withColumn("review_reasons", reasons).withColumn("review_required", F.size("review_reasons") > 0).drop("_p", "_failed")


def crop_reasons(b: Column) -> Column:
    """Why a submission goes to a person, as an array."""
    at = lambda i: F.get(b, F.lit(i))
    inside = (at(0) >= 0) & (at(0) < at(2)) & (at(2) <= c("width")) & (at(1) >= 0) & (at(1) < at(3)) & (at(3) <= c("height"))
    return F.filter(
        F.array(
            F.when(c("completeness") == "review_required", "the cropper was not sure"), F.when(c("confidence") < LOW_CONFIDENCE, "low confidence"),
            F.when(c("crop_path").isNull() | (F.coalesce(c("crop_bytes"), F.lit(0)) == 0), "crop file missing or empty"),
            F.when(c("width").isNull() | c("height").isNull(), "size of the source unknown").when(~inside, "box outside the source"),
        ),
        lambda x: x.isNotNull(),
    )


def recogniser_rows(submissions: DataFrame, sources: DataFrame) -> DataFrame:
    """Submissions (submission_id, path, bbox, kind, completeness, confidence, crop_path, crop_bytes) with review_reasons and disposition.

    ``sources`` (path, width, height) may lack some. Every state of a page counts as an overlay that bears data.
    """
    kind = F.when(c("kind").isin("data_bearing_overlay", "page_state"), "data_bearing_overlay").otherwise("base_page")
    rows = submissions.join(sources.select("path", "width", "height"), "path", "left").withColumns({"kind": kind, "review_reasons": crop_reasons(c("bbox"))})
    disposition = F.when(F.size("review_reasons") > 0, "REVIEW REQUIRED").when(c("completeness") == "partial_best_available", "SUBMIT PARTIAL").otherwise("SUBMIT COMPLETE")
    return rows.withColumns({"review_required": F.size("review_reasons") > 0, "disposition": disposition})


def state_calibration(rows: DataFrame) -> DataFrame:
    """(state, size, count, log_loss, brier): how well three states are told, and occlusion by its size.

    ``rows`` has truth_same_document, material (null where not annotated), size_category and the three probabilities; same pairs
    without annotation are left out.
    """
    same, material = c("truth_same_document"), F.coalesce(c("material"), F.lit(False))
    told = rows.where(~same | c("material").isNotNull()).withColumns(
        {"_clean": (same & ~material).cast("int"), "_occluded": (same & material).cast("int"), "_different": (~same).cast("int")}
    )
    one = lambda p, t: F.struct(F.lit(t[1:]).alias("state"), c(p).alias("p"), c(t).alias("t"))
    long = told.select("truth_same_document", "size_category", F.explode(F.array(one("same_clean_probability", "_clean"), one("same_occluded_probability", "_occluded"), one("different_document_probability", "_different"))).alias("s"))
    q = F.least(F.lit(1 - 1e-15), F.greatest(F.lit(1e-15), c("s.p")))
    loss = -(c("s.t") * F.log(q) + (1 - c("s.t")) * F.log(1 - q))
    measures = (F.count("*").alias("count"), F.avg(loss).alias("log_loss"), F.avg((c("s.p") - c("s.t")) * (c("s.p") - c("s.t"))).alias("brier"))
    whole = long.groupBy(c("s.state").alias("state")).agg(*measures).withColumn("size", F.lit(None).cast("string"))
    sized = long.where("s.state = 'occluded' and truth_same_document").groupBy(c("size_category").alias("size")).agg(*measures).withColumn("state", F.lit("occluded_by_size"))
    return whole.select("state", "size", "count", "log_loss", "brier").unionByName(sized.select("state", "size", "count", "log_loss", "brier"))


def with_annotations(rows: DataFrame, splits: DataFrame, subtypes: DataFrame) -> DataFrame:
    """Pair rows (original_cluster_id, truth) with split, occlusion_subtype, material and size_category; a pair without a split is an error."""
    key = "original_cluster_id"
    noted = subtypes.select(key, "occlusion_subtype", F.expr("try_cast(material_occlusion_metric_included as boolean)").alias("material"), c("occlusion_size_category").alias("size_category"))
    out = rows.join(splits.select(key, "split"), key, "left").join(noted, key, "left")
    known = F.when(c("split").isNull(), F.raise_error(F.concat(F.lit("no split for "), key)).cast("string")).otherwise(c("split"))
    default = F.when(c("truth") == "accepted", "uncertain_occlusion_subtype").otherwise("different_document")
    return out.withColumns({"split": known, "occlusion_subtype": F.coalesce("occlusion_subtype", default)})


def native_components(image_ids: DataFrame, native: DataFrame | None, edges: DataFrame) -> DataFrame:
    """(image_id, root): by the prediction's own cluster ids (image_id, cluster_id) where it has them, an image without one being alone; else by automatic edges."""
    if native is None:
        from .graph import link_components

        return link_components(image_ids, edges)
    of = image_ids.select("image_id").distinct().join(native.select("image_id", "cluster_id"), "image_id", "left")
    first = of.where("cluster_id is not null").groupBy("cluster_id").agg(F.min("image_id").alias("_r"))
    return of.join(first, "cluster_id", "left").select("image_id", F.coalesce("_r", "image_id").alias("root"))


def fit_calibrator(rows: DataFrame, manifest_sha256: str, conditional: bool = True) -> dict:
    """Isotonic knots for identity, from all selection rows, and for occlusion, from same pairs there that are annotated as material or not."""
    chosen = rows.where("split = 'selection'")
    knots = lambda df, score, truth: [(r["score"], r["value"]) for r in evaluate.fit_isotonic(df, score, truth).orderBy("knot").collect()]
    identity = knots(chosen.withColumn("_t", c("truth_same_document").cast("int")), "same_document_probability", "_t")
    if not identity:
        raise ValueError("no selection rows to fit on")
    noted = chosen.where("truth_same_document and material is not null").withColumn("_t", c("material").cast("int"))
    return {
        "schema_version": 1, "calibration_source": "selection", "prepared_manifest_sha256": manifest_sha256, "selection_pair_count": chosen.count(),
        "identity": identity, "conditional": (knots(noted, "occluded_given_same_probability", "_t") or None) if conditional else None, "locked_audit_used_for_fit": False,
    }


def promotion_gates(pairs: DataFrame) -> DataFrame:
    """One row: no automatic edge on a negative pair, no component with one, both."""
    no = lambda status: F.coalesce(F.max((c("status") == status).cast("int")), F.lit(0)) == 0
    out = pairs.agg(no("automatic_false_link").alias("no_automatic_false_link"), no("contaminated_component").alias("no_contaminated_component"))
    return out.withColumn("promotable", c("no_automatic_false_link") & c("no_contaminated_component"))


def write_evaluation(folder: str, pairs: DataFrame, groups: DataFrame) -> None:
    """Pair rows, group rows, failures and the rows for review, each as JSON lines and CSV, and reliability, budget and gates as JSON.

    ``pairs`` has image_a, image_b, truth (1 or 0), status and same_document_probability.
    """
    pairs = materialize(pairs)
    good = ("deterministically_linked", "transitively_connected", "correctly_separated")
    tables = {"pair_rows": pairs, "group_rows": groups, "failures": pairs.where(~c("status").isin(*good)), "review_rows": pairs.where(c("status").isin("review_only", "candidate_only"))}
    for name, df in tables.items():
        writers.write_json_lines(df, f"{folder}/{name}")
        writers.write_union([df], f"{folder}/{name}_csv")
    summaries = {
        "reliability": evaluate.reliability(pairs, "same_document_probability", "truth"), "probability_metrics": evaluate.probability_metrics(pairs, "same_document_probability", "truth"),
        "review_budget": evaluate.review_budget(pairs, "same_document_probability", [c("image_a"), c("image_b")], "truth"), "gates": promotion_gates(pairs),
    }
    for name, df in summaries.items():
        writers.write_json_lines(df, f"{folder}/{name}")


def write_cases(cases: DataFrame, path: str) -> None:
    """Label cases as JSON lines in order of case_id: files in range order, none sorted by one task alone."""
    cases.orderBy("case_id").write.mode("overwrite").json(path)


def write_prepared(folder: str, groups: DataFrame, pairs: DataFrame, splits: DataFrame, sidecar: DataFrame) -> bool:
    """The prepared dataset; the sidecar, which people fill in, is written only where there is none. True if it was."""
    for name, df in (("groups", groups), ("pairs", pairs), ("splits", splits)):
        writers.write_json_lines(df, f"{folder}/{name}")
    jvm, conf = groups.sparkSession.sparkContext._jvm, groups.sparkSession.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/subtypes")
    if path.getFileSystem(conf).exists(path):
        return False
    writers.write_new(sidecar, f"{folder}/subtypes")
    return True
