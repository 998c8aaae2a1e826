"""Decisions and probabilities: both sides of thresholds."""

import pytest
from pyspark.sql import functions as F

from folioweave.config import LinkConfig
from folioweave.operators import decide, probability

NOTHING = dict.fromkeys(
    ["largest_ink_component_fraction", "outside_ink_mismatch_tiles_fraction", "outside_unmatched_ink_union_fraction", "outside_unmatched_ink_fraction",
     "occlusion_localization_contrast", "occlusion_ink_mismatch_capture", "inside_unmatched_ink_union_fraction", "occlusion_material_median",
     "occlusion_material_fraction", "occlusion_rectangularity", "occlusion_residual_capture", "occlusion_area_fraction"],
    0.0,
)
CLEAN = NOTHING | dict(
    page_count=1, full_page_occlusion_count=0, occlusion_candidate_count=0, registration_model="affine", registration_fallback_used=False,
    registration_alignment_score=0.9, feature_overlap=0.5, inlier_ratio=0.8, x_span=0.9, y_span=0.9, valid_fraction=0.95, changed_fraction=0.05,
    ink_mismatch_tiles_fraction=0.02, residual_tiles_changed_fraction=0.02, unmatched_ink_union_fraction=0.01, unmatched_ink_fraction=0.001,
)
COVERED = CLEAN | dict(
    inside_unmatched_ink_union_fraction=0.6, outside_unmatched_ink_union_fraction=0.01, outside_ink_mismatch_tiles_fraction=0.05,
    occlusion_localization_contrast=0.5, occlusion_ink_mismatch_capture=0.9, occlusion_candidate_count=1, occlusion_material_median=0.05,
    occlusion_material_fraction=0.8, occlusion_rectangularity=0.8, occlusion_residual_capture=0.9, occlusion_area_fraction=0.45,
    unmatched_ink_union_fraction=0.30, ink_mismatch_tiles_fraction=0.30, changed_fraction=0.55,
)

CASES = [
    (CLEAN, {}, True, "near_duplicate"),
    (CLEAN, {"valid_fraction": 0.649}, False, None),
    (CLEAN, {"valid_fraction": 0.65}, True, "near_duplicate"),
    (CLEAN, {"unmatched_ink_union_fraction": 0.021}, False, None),
    (CLEAN, {"feature_overlap": 0.079}, False, None),
    (CLEAN, {"registration_fallback_used": True, "registration_alignment_score": 0.30, "feature_overlap": 0.0}, True, "near_duplicate"),
    (CLEAN, {"registration_fallback_used": True, "registration_alignment_score": 0.29}, False, None),
    (COVERED, {}, True, "physical_occlusion"),
    (COVERED, {"occlusion_candidate_count": 3}, False, None),
    (COVERED, {"outside_unmatched_ink_union_fraction": 0.081}, False, None),
    (COVERED, {"occlusion_rectangularity": 0.19}, False, None),
    (COVERED, {"occlusion_residual_capture": 0.37}, False, None),
    (COVERED, {"occlusion_ink_mismatch_capture": 0.14}, False, None),
    (COVERED, {"unmatched_ink_union_fraction": 0.45, "ink_mismatch_tiles_fraction": 0.75, "occlusion_material_median": 0.034}, False, None),
    (COVERED, {"outside_unmatched_ink_union_fraction": 0.20, "outside_ink_mismatch_tiles_fraction": 0.55, "occlusion_ink_mismatch_capture": 0.59}, False, None),
]


@pytest.fixture(scope="module")
def decided(spark):
    rows = [base | change | {"n": i, "first_path": "p001.jpg", "second_path": "p002.jpg"} for i, (base, change, *_) in enumerate(CASES)]
    out = probability.pair_probabilities(decide.decide(spark.createDataFrame(rows), LinkConfig(), ("first_path", "second_path")))
    return {r["n"]: r for r in out.collect()}


@pytest.mark.parametrize("n", range(len(CASES)))
def test_thresholds(decided, n):
    r, (_, _, accepted, branch) = decided[n], CASES[n]
    assert (r["same_document"], r["branch"]) == (accepted, branch)
    assert (r["confidence"] >= 0.5) == accepted and not (r["same_document"] and r["hard_contradiction"])
    assert abs(r["same_clean_probability"] + r["same_occluded_probability"] - r["same_document_probability"]) < 1e-12
    assert abs(r["same_document_probability"] + r["different_document_probability"] - 1) < 1e-12


def test_safety_keeps_far_and_foreign_names_for_review(spark):
    names = [("p001.jpg", "p013.jpg", None), ("p001.jpg", "p014.jpg", "filename positions too far apart"), ("p001.jpg", "q002.jpg", "filename prefixes differ"), ("001.jpg", "q002.jpg", None)]
    rows = spark.createDataFrame([CLEAN | {"a": a, "b": b} for a, b, _ in names])
    got = {(r["a"], r["b"]): r for r in decide.decide(rows, LinkConfig(), ("a", "b")).collect()}
    for a, b, reason in names:
        r = got[a, b]
        assert r["safety_reason"] == reason and r["same_document"] == (reason is None) and r["branch"] == "near_duplicate"
        assert r["automatic_link_eligible"] == (reason is None)


def test_evidence_is_zero_without_a_block_and_penalised_when_spread(spark):
    rows = [CLEAN, COVERED, COVERED | {"outside_unmatched_ink_union_fraction": 0.25, "outside_ink_mismatch_tiles_fraction": 0.6}]
    df = decide.with_rules(spark.createDataFrame([r | {"n": i} for i, r in enumerate(rows)]), LinkConfig())
    none, full, spread = (r[0] for r in df.orderBy("n").select(probability.occlusion_evidence(LinkConfig())).collect())
    assert none == 0 and full > 0.9 and spread < 0.05


def test_nan_features_count_as_zero(spark):
    row = spark.createDataFrame([CLEAN | {"inlier_ratio": float("nan")}, CLEAN | {"inlier_ratio": 0.0}])
    a, b = (r["same_document_probability"] for r in probability.pair_probabilities(row).collect())
    assert a == b


def test_settings():
    assert LinkConfig().fingerprint() == LinkConfig.from_mapping(LinkConfig().as_dict()).fingerprint() != LinkConfig(max_gap=2).fingerprint()
    assert len(LinkConfig().as_dict()) > 120
    for bad in ({"nothing": 1}, {"min_valid_fraction": 1.5}, {"max_gap": 0}, {"ecc_gaussian_filter_size": 4}, {"occlusion_evidence_full_localization_contrast": 0.01}):
        with pytest.raises(ValueError):
            LinkConfig(**bad)


def test_rules_are_generated_code(spark):
    df = decide.decide(spark.createDataFrame([COVERED]), LinkConfig())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and df.select(F.count("*")).first()[0] == 1
