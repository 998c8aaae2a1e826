import math

import pytest
from pyspark.sql import functions as F

from folioweave.operators import reports, validate

GOOD = {
    "original_cluster_id": "g", "member_image_ids_json": '["a", "b", "c"]', "material_occlusion_metric_included": "true", "occlusion_subtype": "same_occluded",
    "evidence": "seen", "uncertainty_notes": "", "annotator_method": "by eye", "visual_relationship_category": "material_physical_occlusion", "visual_overlay_category": "none",
    "meaningful_hidden_content_risk": "high", "occlusion_size_category": "large", "registration_difficulty": "easy", "affected_image_id": "a", "occluded_image_id": "a",
    "better_view_image_id": "b", "affected_image_ids_json": '["a"]', "occluded_image_ids_json": '["a"]', "better_view_image_ids_json": '["b", "c"]',
}
CLEAN = GOOD | {
    "material_occlusion_metric_included": "false", "occlusion_subtype": "same_clean", "visual_relationship_category": "identical_or_near_identical", "meaningful_hidden_content_risk": "none",
    "occlusion_size_category": "none", "affected_image_id": "", "occluded_image_id": "", "better_view_image_id": "", "affected_image_ids_json": "[]", "occluded_image_ids_json": "[]",
    "better_view_image_ids_json": "[]",
}

SUBTYPES = [
    (GOOD, set()),
    (CLEAN, set()),
    (GOOD | {"member_image_ids_json": '["b", "a", "c"]'}, {"members differ from the group"}),
    (GOOD | {"occlusion_subtype": "uncertain_occlusion_subtype"}, {"subtype is unsettled", "material row with another subtype"}),
    (GOOD | {"registration_difficulty": "uncertain"}, {"registration_difficulty is unknown or unsettled"}),
    (GOOD | {"better_view_image_ids_json": '["c", "b"]'}, {"better_view list has an id that is no member, or another order"}),
    (GOOD | {"better_view_image_ids_json": '["b", "z"]'}, {"better_view list has an id that is no member, or another order"}),
    (GOOD | {"better_view_image_id": ""}, {"better_view image and list disagree"}),
    (GOOD | {"better_view_image_id": "a", "better_view_image_ids_json": '["a", "b"]'}, {"an image both occluded and better"}),
    (GOOD | {"occluded_image_id": "c", "occluded_image_ids_json": '["c"]', "better_view_image_ids_json": '["b"]'}, {"occluded images that are not affected"}),
    (GOOD | {"occlusion_size_category": "none"}, {"material row without risk or size"}),
    (GOOD | {"evidence": " "}, {"evidence or annotator is missing"}),
    (GOOD | {"material_occlusion_metric_included": "perhaps"}, {"material flag is no boolean", "occluded subtype outside the metric", "physical occlusion outside the metric", "occluded images outside the metric"}),
    (CLEAN | {"visual_overlay_category": "stamp_or_seal"}, {"identical images with contradicting fields"}),
    (CLEAN | {"visual_relationship_category": "visual_only_overlay"}, {"overlay row is incomplete"}),
    (CLEAN | {"meaningful_hidden_content_risk": "low"}, {"clean row with risk or size"}),
    (GOOD | {"affected_image_ids_json": "no list"}, None),
]


def test_annotations_break_just_the_rules_they_break(spark):
    rows = [r | {"original_cluster_id": f"g{i}"} for i, (r, _) in enumerate(SUBTYPES)]
    groups = spark.createDataFrame([(r["original_cluster_id"], ["a", "b", "c"]) for r in rows], "original_cluster_id string, image_ids array<string>")
    found: dict[str, set] = {}
    for r in validate.subtype_problems(spark.createDataFrame(rows), groups).collect():
        found.setdefault(r["original_cluster_id"], set()).add(r["problem"])
    for i, (_, expected) in enumerate(SUBTYPES):
        if expected is None:
            assert "affected list is no list of distinct ids" in found[f"g{i}"]
        else:
            assert found.get(f"g{i}", set()) == expected, i


def test_annotations_and_groups_cover_each_other(spark):
    rows = spark.createDataFrame([GOOD, GOOD, CLEAN | {"original_cluster_id": "stray"}])
    groups = spark.createDataFrame([("g", ["a", "b", "c"]), ("bare", ["x", "y"])], "original_cluster_id string, image_ids array<string>")
    found = {tuple(r) for r in validate.subtype_problems(rows, groups).collect()}
    assert found == {("g", "two annotations of one group"), ("stray", "annotation without group"), ("bare", "group without annotation")}
    with pytest.raises(ValueError, match="evidence"):
        validate.subtype_problems(rows.drop("evidence"), groups)


def test_splits_must_be_known_and_hold_rows(spark):
    rows = spark.createDataFrame([("development", 1), ("selection", 2)], "split string, x int")
    assert [r["x"] for r in validate.in_splits(rows, ["selection", " selection "]).collect()] == [2]
    for wanted in ([], ["nowhere"], ["locked_audit"]):
        with pytest.raises(ValueError):
            validate.in_splits(rows, wanted)


MANIFEST = "original_cluster_id string, review_decision string, cluster_status string, assignment_type string, included_in_original_cluster boolean, assignment_id string, image_id string, package_relative_path string"


def test_manifest_rules(spark):
    a = ("accepted", "approved", "accepted_cluster", True)
    r = ("rejected", "dissolved", "rejected_singleton", False)
    sound = [("g1", *a, "s1", "i1", "images/i1"), ("g1", *a, "s1", "i2", "i2"), ("g2", *r, "s2", "i3", "i3"), ("g2", *r, "s3", "i4", "i4")]
    at = lambda rows, **more: {tuple(x) for x in validate.manifest_rule_problems(spark.createDataFrame(rows, MANIFEST), **more).collect()}
    files = spark.createDataFrame([("i1",), ("images/i2",), ("i3",), ("i4",)], "path string")
    assert at(sound, other=spark.createDataFrame(sound, MANIFEST), files=files) == set()
    assert at(sound, other=spark.createDataFrame(sound[1:], MANIFEST)) == {("g1", "the manifest's two files differ")}
    assert at(sound, files=files.where("path != 'i3'")) == {("g2", "an image file is missing")}
    assert at([*sound, ("g3", *a, "s1", "i5", "")]) == {("g1", "an assignment spans groups"), ("g3", "an assignment spans groups")}
    assert at([*sound, ("g1", *a, "s9", "i2", "")]) == {("g1", "an image in several rows"), ("g1", "accepted group without one shared assignment")}
    assert at([("g", *r, "s", "i1", ""), ("g", *r, "s", "i2", "")]) == {("g", "rejected group without assignments of their own")}
    assert ("g", "decisions are mixed") in at([("g", *r, "s", "i1", ""), ("g", *a, "t", "i2", "")])
    assert at([("g", "accepted", "dissolved", "accepted_cluster", True, "s", "i1", "")]) == {("g", "a row contradicts its decision")}


def tables(spark):
    sources = spark.createDataFrame([(f"/d/{n}.png", "/d", 100, 50, None) for n in "abc"], "path string, folder string, width int, height int, error string")
    images = spark.createDataFrame([(n, f"/d/{n}.png", i) for i, n in enumerate("abc")], "image_id string, path string, sequence_index int")
    clusters = spark.createDataFrame([("1", ["a", "b"]), ("2", ["c"])], "cluster_id string, image_ids array<string>")
    crops = spark.createDataFrame([("s1", "/d/a.png", [0, 0, 100, 50], "x", 9)], "submission_id string, path string, bbox array<int>, crop_path string, crop_bytes int")
    return sources, images, clusters, crops


def test_a_sound_run_and_every_way_to_break_it(spark):
    sources, images, clusters, crops = tables(spark)
    at = lambda *x, **more: {tuple(r) for r in validate.run_problems(*x, **more).collect()}
    passed = spark.createDataFrame([("near", True)], "category string, passed boolean")
    assert at(sources, images, clusters, crops, passed) == set()
    assert at(sources, images.where("image_id != 'c'"), clusters.where("cluster_id = '1'")) == {("/d/c.png", "source image in no sequence")}
    assert at(sources.where("path != '/d/c.png'"), images, clusters) == {("/d/c.png", "image that is no source"), ("2", "cluster spans folders")}
    assert at(sources, images, clusters, max_size=1) == {("1", "cluster is too large")}
    assert at(sources, images, clusters.withColumn("image_ids", F.reverse("image_ids"))) == {("1", "members out of order")}
    assert at(sources.withColumn("folder", F.col("path")), images, clusters) == {("1", "cluster spans folders")}
    assert at(sources.withColumn("error", F.when(F.col("path") == "/d/b.png", "broken")), images, clusters) == {("/d/b.png", "image cannot be decoded")}
    assert at(sources, images, clusters, crops.union(crops)) == {("s1", "submission id twice")}
    assert at(sources, images, clusters, crops.withColumn("bbox", F.array(F.lit(0), F.lit(0), F.lit(101), F.lit(50)))) == {("s1", "crop outside its source")}
    assert at(sources, images, clusters, crops.withColumn("path", F.lit("/e"))) == {("s1", "crop of an unknown source")}
    assert at(sources, images, clusters, crops.withColumn("crop_bytes", F.lit(0))) == {("s1", "crop file missing or empty")}
    assert at(sources, images, clusters, crops, passed.withColumn("passed", F.lit(False))) == {("near", "reviewed pair failed")}


def test_labelled_pairs_pass_as_told(spark):
    _, images, _, _ = tables(spark)
    pairs = spark.createDataFrame([("a", "b", True), ("b", "c", False)], "first_image_id string, second_image_id string, same_document boolean")
    labels = [("n", "b.png", "a.png", True), ("h", "c.png", "b.png", False), ("h", "a.png", "c.png", False), ("n", "a.png", "c.png", True), ("h", "a.png", "z.png", False), ("n", "c.png", "b.png", True)]
    got = validate.label_pairs(spark.createDataFrame(labels, "category string, first_filename string, second_filename string, expected_same_document boolean"), images, pairs).collect()
    assert {(r["first_filename"], r["second_filename"], r["expected_same_document"]): (r["found"], r["passed"]) for r in got} == {
        ("b.png", "a.png", True): (True, True), ("c.png", "b.png", False): (True, True), ("a.png", "c.png", False): (False, True),
        ("a.png", "c.png", True): (False, False), ("a.png", "z.png", False): (False, False), ("c.png", "b.png", True): (True, False),
    }


def test_cluster_payloads(spark):
    _, images, clusters, _ = tables(spark)
    clusters = clusters.withColumns({"sequence_id": F.lit("/d"), "representative_image_id": F.col("image_ids")[0]})
    pairs = spark.createDataFrame([("a", "b", True, 0.5, 1, "affine"), ("b", "c", False, 0.2, 1, None)], "first_image_id string, second_image_id string, same_document boolean, confidence double, index_gap int, registration_model string")
    got = {r["cluster_id"]: r for r in reports.cluster_payloads(images, clusters, pairs).collect()}
    assert got["1"]["image_paths"] == ["/d/a.png", "/d/b.png"] and got["1"]["representative_image_path"] == "/d/a.png" and got["1"]["models"] == ["affine"]
    assert got["1"]["review_reasons"] == ["a weak accepted pair"] and got["2"]["review_reasons"] == [] and got["2"]["confidence_min"] is None


def test_recogniser_rows_have_one_disposition(spark):
    sources, _, _, crops = tables(spark)
    rows = crops.withColumns({"kind": F.lit("page_state"), "completeness": F.lit("complete"), "confidence": F.lit(0.9)})
    at = lambda df: reports.recogniser_rows(df, sources).first()
    assert (at(rows)["disposition"], at(rows)["kind"]) == ("SUBMIT COMPLETE", "data_bearing_overlay")
    assert at(rows.withColumn("completeness", F.lit("partial_best_available")))["disposition"] == "SUBMIT PARTIAL"
    weak = at(rows.withColumns({"confidence": F.lit(0.5), "path": F.lit("?"), "crop_path": F.lit(None).cast("string")}))
    assert weak["disposition"] == "REVIEW REQUIRED" and weak["review_reasons"] == ["low confidence", "crop file missing or empty", "size of the source unknown"]


PAIRS = "original_cluster_id string, image_a string, image_b string, truth_same_document boolean, material boolean, size_category string, same_clean_probability double, same_occluded_probability double, different_document_probability double"


def test_states_are_calibrated_apart(spark):
    rows = spark.createDataFrame([("g", "a", "b", True, True, "large", 0.1, 0.7, 0.2), ("g", "a", "c", True, False, "none", 0.6, 0.1, 0.3), ("h", "a", "d", False, None, None, 0.2, 0.1, 0.7), ("k", "a", "e", True, None, None, 0.9, 0.0, 0.1)], PAIRS)
    got = {(r["state"], r["size"]): r for r in reports.state_calibration(rows).collect()}
    assert set(got) == {("clean", None), ("occluded", None), ("different", None), ("occluded_by_size", "large"), ("occluded_by_size", "none")}
    assert got["clean", None]["count"] == 3 and got["clean", None]["brier"] == pytest.approx((0.01 + 0.16 + 0.04) / 3)
    assert got["occluded_by_size", "large"]["log_loss"] == pytest.approx(-math.log(0.7))


def test_annotations_join_and_missing_splits_fail(spark):
    rows = spark.createDataFrame([("g", "accepted"), ("h", "rejected"), ("k", "accepted")], "original_cluster_id string, truth string")
    splits = spark.createDataFrame([("g", "selection"), ("h", "selection"), ("k", "development")], "original_cluster_id string, split string")
    subtypes = spark.createDataFrame([("g", "same_clean", "false", "none")], "original_cluster_id string, occlusion_subtype string, material_occlusion_metric_included string, occlusion_size_category string")
    got = {r["original_cluster_id"]: r for r in reports.with_annotations(rows, splits, subtypes).collect()}
    assert [(got[k]["split"], got[k]["occlusion_subtype"], got[k]["material"]) for k in "ghk"] == [("selection", "same_clean", False), ("selection", "different_document", None), ("development", "uncertain_occlusion_subtype", None)]
    with pytest.raises(Exception, match="no split for k"):
        reports.with_annotations(rows, splits.where("original_cluster_id != 'k'"), subtypes).collect()


def test_native_components_come_first(spark):
    ids = spark.createDataFrame([(x, i) for i, x in enumerate("abcd")], "image_id string, sequence_index int")
    native = spark.createDataFrame([("b", "1"), ("c", "1"), ("d", "2")], "image_id string, cluster_id string")
    assert {tuple(r) for r in reports.native_components(ids, native, None).collect()} == {("a", "a"), ("b", "b"), ("c", "b"), ("d", "d")}


def test_calibrator_is_fitted_on_selection_and_guarded(spark):
    rows = [("selection", True, True, 0.8, 0.9), ("selection", True, False, 0.7, 0.2), ("selection", False, None, 0.3, 0.5), ("locked_audit", False, None, 0.99, 0.5), ("selection", True, None, 0.9, 0.1)]
    df = spark.createDataFrame(rows, "split string, truth_same_document boolean, material boolean, same_document_probability double, occluded_given_same_probability double")
    got = reports.fit_calibrator(df, "sha")
    assert got["identity"] == [(0.3, 0.0), (0.7, 1.0), (0.8, 1.0), (0.9, 1.0)] and got["conditional"] == [(0.2, 0.0), (0.9, 1.0)] and got["selection_pair_count"] == 4
    validate.check_calibrator(got, "sha")
    for bad in ({"schema_version": 2}, {"prepared_manifest_sha256": "other"}, {"locked_audit_used_for_fit": True}, {"locked_audit_used_for_fit": None}):
        with pytest.raises(ValueError):
            validate.check_calibrator(got | bad, "sha")
    with pytest.raises(ValueError):
        reports.fit_calibrator(df.where("split != 'selection'"), "sha")


def test_reports_are_written_and_the_sidecar_kept(spark, tmp_path):
    pairs = spark.createDataFrame([("a", "b", 1, "deterministically_linked", 0.9), ("a", "c", 0, "candidate_only", 0.4), ("a", "d", 1, "missed_entirely", 0.1)], "image_a string, image_b string, truth int, status string, same_document_probability double")
    reports.write_evaluation(str(tmp_path / "e"), pairs, pairs.select("image_a"))
    assert spark.read.json(str(tmp_path / "e" / "failures")).count() == 2 and spark.read.json(str(tmp_path / "e" / "review_rows")).count() == 1
    assert spark.read.json(str(tmp_path / "e" / "gates")).first()["promotable"]
    side = spark.createDataFrame([("g", "")], "original_cluster_id string, occlusion_subtype string")
    assert reports.write_prepared(str(tmp_path / "p"), pairs, pairs, pairs, side) and not reports.write_prepared(str(tmp_path / "p"), pairs, pairs, pairs, side.limit(0))
    assert spark.read.option("header", True).csv(str(tmp_path / "p" / "subtypes")).count() == 1
    reports.write_cases(spark.createDataFrame([("b",), ("a",)], "case_id string"), str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "c")).count() == 2
