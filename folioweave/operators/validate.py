"""Checks of runs, manifests, annotations and calibrators. Each gives a table of what is wrong, empty where all is well."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col

UNSETTLED = ("uncertain", "uncertain_or_other", "uncertain_occlusion_subtype")
CATEGORIES = {
    "visual_relationship_category": ("identical_or_near_identical", "material_physical_occlusion", "same_document_state_or_content_change", "visual_only_overlay", "mixed_or_multi_state"),
    "visual_overlay_category": ("none", "large_number", "stamp_or_seal", "card_or_label", "other_visual_overlay"),
    "meaningful_hidden_content_risk": ("none", "low", "medium", "high"),
    "occlusion_size_category": ("none", "small", "medium", "large"),
    "registration_difficulty": ("easy", "moderate", "hard"),
}
ROLES = ("affected", "occluded", "better_view")
SUBTYPE_COLUMNS = (
    "member_image_ids_json", "material_occlusion_metric_included", "occlusion_subtype", "evidence", "uncertainty_notes", "annotator_method",
    *CATEGORIES, *(f"{r}_image_id" for r in ROLES), *(f"{r}_image_ids_json" for r in ROLES),
)


def found(rows: DataFrame, key: str, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """(key, problem) for every rule that holds; a rule that cannot be told holds."""
    broken = F.array(*(F.when(F.coalesce(rule, F.lit(True)), F.lit(text)) for text, rule in rules))
    return rows.select(key, F.explode(F.filter(broken, lambda x: x.isNotNull())).alias("problem"))


def in_order_of(values: Column, authority: Column) -> Column:
    """Those of ``authority`` that are among the values, in its order."""
    return F.filter(authority, lambda x: F.array_contains(values, x))


# --- splits


def in_splits(rows: DataFrame, wanted: Sequence[str], split: str = "split", known: Sequence[str] = ("development", "selection", "locked_audit")) -> DataFrame:
    """The rows of the wanted splits; an empty or unknown choice, or one that leaves no row, is an error."""
    names = list(dict.fromkeys(x.strip() for x in wanted))
    if not names:
        raise ValueError("no split was asked for")
    if odd := [x for x in names if x not in known]:
        raise ValueError(f"unknown split: {odd[0]}")
    kept = rows.where(c(split).isin(names))
    if kept.isEmpty():
        raise ValueError("the asked splits hold no rows")
    return kept


# --- completed annotations


def subtype_problems(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """(original_cluster_id, problem) of the completed sidecar against accepted groups (original_cluster_id, image_ids in their order)."""
    key = "original_cluster_id"
    if lacking := [x for x in SUBTYPE_COLUMNS if x not in rows.columns]:
        raise ValueError(f"the sidecar lacks {', '.join(lacking)}")
    both = rows.withColumn("_row", F.lit(True)).join(groups.select(key, "image_ids"), key, "full")
    text = {x: F.trim(F.coalesce(c(x), F.lit(""))) for x in SUBTYPE_COLUMNS}
    listed = {x: F.transform(F.from_json(text[x], "array<string>"), lambda v: F.trim(v)) for x in ("member_image_ids_json", *(f"{r}_image_ids_json" for r in ROLES))}
    both = both.select(key, "_row", "image_ids", *(v.alias(x) for x, v in (text | listed).items()), (F.lower(text["material_occlusion_metric_included"]).isin("true", "1", "yes")).alias("_material"))
    members, material = c("image_ids"), c("_material")
    subtype, relation, overlay = c("occlusion_subtype"), c("visual_relationship_category"), c("visual_overlay_category")
    risk, size = c("meaningful_hidden_content_risk"), c("occlusion_size_category")
    ids, one = {r: c(f"{r}_image_ids_json") for r in ROLES}, {r: c(f"{r}_image_id") for r in ROLES}
    rules: list[tuple[str, Column]] = [
        ("group without annotation", c("_row").isNull()),
        ("annotation without group", members.isNull()),
        ("members differ from the group", c("member_image_ids_json") != members),
        ("subtype is unsettled", subtype.isin(*UNSETTLED, "")),
        ("material flag is no boolean", ~F.lower(text["material_occlusion_metric_included"]).isin("true", "false", "1", "0", "yes", "no")),
        *((f"{x} is unknown or unsettled", ~c(x).isin(*values)) for x, values in CATEGORIES.items()),
        ("evidence or annotator is missing", (c("evidence") == "") | (c("annotator_method") == "")),
    ]
    for r in ROLES:
        rules += [
            (f"{r} list is no list of distinct ids", ids[r].isNull() | (F.size(F.array_distinct(ids[r])) != F.size(ids[r])) | F.exists(ids[r], lambda x: x == "")),
            (f"{r} list has an id that is no member, or another order", ids[r] != in_order_of(ids[r], members)),
            (f"{r} image is no member", (one[r] != "") & ~F.array_contains(members, one[r])),
            (f"{r} image and list disagree", F.when(one[r] != "", ~F.array_contains(ids[r], one[r])).otherwise(F.size(ids[r]) > 0)),
        ]
    empty = {r: F.size(ids[r]) == 0 for r in ROLES}
    rules += [
        ("material row with another subtype", material & ~subtype.isin("same_occluded", "mixed_or_multi_state")),
        ("material row with another relationship", material & ~relation.isin("material_physical_occlusion", "mixed_or_multi_state")),
        ("material row without affected, occluded or better views", material & (empty["affected"] | empty["occluded"] | empty["better_view"])),
        ("occluded images that are not affected", material & (F.size(F.array_except(ids["occluded"], ids["affected"])) > 0)),
        ("an image both occluded and better", material & F.arrays_overlap(ids["occluded"], ids["better_view"])),
        ("material row without risk or size", material & ((risk == "none") | (size == "none"))),
        ("occluded subtype outside the metric", ~material & (subtype == "same_occluded")),
        ("physical occlusion outside the metric", ~material & (relation == "material_physical_occlusion")),
        ("clean row with risk or size", ~material & (subtype == "same_clean") & ((risk != "none") | (size != "none"))),
        ("occluded images outside the metric", ~material & ((one["occluded"] != "") | ~empty["occluded"])),
        ("identical images with contradicting fields", (relation == "identical_or_near_identical") & ((subtype != "same_clean") | material | (overlay != "none"))),
        ("overlay row is incomplete", (relation == "visual_only_overlay") & (material | (overlay == "none") | empty["affected"])),
    ]
    missing = c("_row").isNull() | members.isNull()
    lone = [rules[0], rules[1]]
    whole = [(text_, rule & ~missing) for text_, rule in rules[2:]]
    twice = rows.groupBy(key).count().where("count > 1").select(key, F.lit("two annotations of one group").alias("problem"))
    return found(both, key, [*lone, *whole]).unionByName(twice)


# --- the reviewed manifest


def manifest_rule_problems(rows: DataFrame, other: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """(original_cluster_id, problem) of manifest rows, beside the counts of ``readers.manifest_problems``.

    ``other`` is the same manifest from its second file, which must equal it; ``files`` (path) are those of the package, in which
    an image may lie with or without a leading images/.
    """
    key = "original_cluster_id"
    accepted, included = c("review_decision") == "accepted", c("included_in_original_cluster")
    wrong = F.when(accepted, (c("cluster_status") != "approved") | (c("assignment_type") != "accepted_cluster") | ~included).otherwise(
        (c("cluster_status") != "dissolved") | (c("assignment_type") != "rejected_singleton") | included
    )
    groups = rows.groupBy(key).agg(
        F.countDistinct("review_decision").alias("_decisions"), F.min("review_decision").alias("_decision"), F.countDistinct("assignment_id").alias("_ids"), F.count("*").alias("_n"),
        F.max(F.coalesce(wrong, F.lit(True)).cast("int")).alias("_wrong"),
    )
    rules = [
        ("decisions are mixed", c("_decisions") != 1),
        ("unknown decision", ~c("_decision").isin("accepted", "rejected")),
        ("a row contradicts its decision", c("_wrong") == 1),
        ("accepted group without one shared assignment", (c("_decision") == "accepted") & (c("_ids") != 1)),
        ("rejected group without assignments of their own", (c("_decision") == "rejected") & (c("_ids") != c("_n"))),
    ]
    out = [found(groups, key, rules)]
    reused = rows.groupBy("assignment_id").agg(F.collect_set(key).alias("_g")).where(F.size("_g") > 1).select(F.explode("_g").alias(key), F.lit("an assignment spans groups").alias("problem"))
    again = rows.groupBy("image_id").agg(F.min(key).alias(key), F.count("*").alias("_n")).where("_n > 1").select(key, F.lit("an image in several rows").alias("problem"))
    out += [reused, again]
    if other is not None:
        same = [x for x in rows.columns if x in other.columns]
        apart = rows.select(same).exceptAll(other.select(same)).union(other.select(same).exceptAll(rows.select(same)))
        out.append(apart.select(key, F.lit("the manifest's two files differ").alias("problem")))
    if files is not None:
        at = F.regexp_replace("package_relative_path", "^images/", "")
        have = files.select(F.regexp_replace("path", "^images/", "").alias("_at")).distinct()
        out.append(rows.withColumn("_at", at).join(have, "_at", "left_anti").select(key, F.lit("an image file is missing").alias("problem")))
    return reduce(DataFrame.unionByName, out).distinct()


# --- a whole run


def run_problems(sources: DataFrame, images: DataFrame, clusters: DataFrame, crops: DataFrame | None = None, labels: DataFrame | None = None, max_size: int = 3) -> DataFrame:
    """(subject, problem) of a run.

    ``sources`` (path, folder, width, height, error), ``images`` (image_id, path, sequence_index), ``clusters`` (cluster_id, image_ids),
    ``crops`` (submission_id, path, bbox, crop_path, crop_bytes), ``labels`` (category, passed).
    """
    name = lambda df, subject, text: df.select(c(subject).cast("string").alias("subject"), F.lit(text).alias("problem"))
    known, used = sources.select("path").distinct(), images.select("path").distinct()
    twice = lambda df, key: df.groupBy(key).count().where("count > 1")
    members = (
        clusters.select("cluster_id", F.posexplode("image_ids").alias("_at", "image_id")).join(images, "image_id", "left").join(sources.select("path", "folder"), "path", "left")
        .groupBy("cluster_id").agg(F.count("*").alias("_n"), F.countDistinct("folder").alias("_folders"), F.array_sort(F.collect_list(F.struct("_at", "sequence_index"))).alias("_m"))
        .withColumn("_i", F.transform("_m", lambda m: m["sequence_index"]))
    )
    out = [
        name(known.join(used, "path", "left_anti"), "path", "source image in no sequence"),
        name(used.join(known, "path", "left_anti"), "path", "image that is no source"),
        name(twice(images, "path"), "path", "image twice"),
        name(twice(clusters, "cluster_id"), "cluster_id", "cluster id twice"),
        name(members.where(c("_n") > max_size), "cluster_id", "cluster is too large"),
        name(members.where("_folders != 1"), "cluster_id", "cluster spans folders"),
        name(members.where(c("_i") != F.array_sort("_i")), "cluster_id", "members out of order"),
        name(sources.where("error is not null"), "path", "image cannot be decoded"),
    ]
    if crops is not None:
        box = lambda i: F.get("bbox", F.lit(i))
        placed = crops.join(sources.select("path", "width", "height", F.lit(True).alias("_known")), "path", "left")
        outside = ~((box(0) >= 0) & (box(0) < box(2)) & (box(2) <= c("width")) & (box(1) >= 0) & (box(1) < box(3)) & (box(3) <= c("height")))
        out += [
            name(twice(crops, "submission_id"), "submission_id", "submission id twice"),
            name(placed.where("_known is null"), "submission_id", "crop of an unknown source"),
            name(placed.where(c("_known") & F.coalesce(outside, F.lit(True))), "submission_id", "crop outside its source"),
            name(crops.where("crop_path is null or coalesce(crop_bytes, 0) = 0"), "submission_id", "crop file missing or empty"),
        ]
    if labels is not None:
        out.append(name(labels.where("not passed"), "category", "reviewed pair failed"))
    return reduce(DataFrame.unionByName, out)


def label_pairs(labels: DataFrame, images: DataFrame, pairs: DataFrame) -> DataFrame:
    """Labels (category, first_filename, second_filename, expected_same_document) with their comparison, in either order, and ``passed``.

    A pair that was not compared passes if it is expected to differ; one with an unknown file fails. Of files of one name the last by id counts.
    """
    names = images.groupBy(F.element_at(F.split("path", "/"), -1).alias("_name")).agg(F.max("image_id").alias("_id"))
    both = labels.join(names.toDF("first_filename", "_a"), "first_filename", "left").join(names.toDF("second_filename", "_b"), "second_filename", "left")
    metrics = [x for x in ("branch", "reason", "confidence", "hard_contradiction") if x in pairs.columns]
    keyed = pairs.select(F.least("first_image_id", "second_image_id").alias("_l"), F.greatest("first_image_id", "second_image_id").alias("_h"), c("same_document").alias("actual_same_document"), *metrics)
    out = both.withColumns({"_l": F.least("_a", "_b"), "_h": F.greatest("_a", "_b")}).join(keyed, ["_l", "_h"], "left")
    there = c("_a").isNotNull() & c("_b").isNotNull()
    passed = there & F.when(c("actual_same_document").isNull(), ~c("expected_same_document")).otherwise(c("actual_same_document") == c("expected_same_document"))
    return out.withColumns({"found": c("actual_same_document").isNotNull(), "passed": passed}).drop("_a", "_b", "_l", "_h")


# --- calibrators


def check_calibrator(calibrator: Mapping, manifest_sha256: str, schema: int = 1) -> None:
    """A calibrator of this version, fitted on this manifest and not on the locked audit; else an error."""
    if calibrator.get("schema_version") != schema:
        raise ValueError("calibrator of another version")
    if calibrator.get("prepared_manifest_sha256") != manifest_sha256:
        raise ValueError("calibrator of another manifest")
    if calibrator.get("locked_audit_used_for_fit") is not False:
        raise ValueError("calibrator may have seen the locked audit")
