"""Canonical tables."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

_WHOLE = """index_gap good_match_count inlier_count coherent_ink_component_count occlusion_candidate_count full_page_occlusion_count
shallow_occlusion_count page_count""".split()
_FLAGS = "same_document registration_fallback_used hard_contradiction automatic_link_eligible occlusion_candidate_flag".split()
_TEXT = "first_image_id second_image_id sequence_id reason registration_model branch probability_model_version".split()
#: Fractions and scores; a pair that could not be registered has the pessimistic value.
_REAL = """confidence inlier_ratio feature_overlap median_reprojection_error registration_alignment_score x_span y_span valid_fraction
changed_fraction stable_fraction tiles_changed_fraction largest_change_share unmatched_ink_fraction unmatched_ink_union_fraction
ink_mismatch_tiles_fraction largest_ink_component_fraction residual_tiles_changed_fraction occlusion_area_fraction
occlusion_residual_capture occlusion_rectangularity occlusion_boundary_score occlusion_material_fraction occlusion_material_median
outside_unmatched_ink_fraction outside_unmatched_ink_union_fraction outside_ink_mismatch_tiles_fraction
inside_unmatched_ink_union_fraction occlusion_ink_mismatch_capture occlusion_localization_contrast occlusion_evidence
same_document_probability occluded_given_same_probability same_clean_probability same_occluded_probability
different_document_probability raw_occluded_given_same_probability""".split()

PESSIMISTIC = dict.fromkeys(
    ["changed_fraction", "unmatched_ink_fraction", "unmatched_ink_union_fraction", "ink_mismatch_tiles_fraction", "residual_tiles_changed_fraction",
     "outside_unmatched_ink_fraction", "outside_unmatched_ink_union_fraction", "outside_ink_mismatch_tiles_fraction"],
    1.0,
)

PAIRS = StructType(
    [StructField(n, StringType()) for n in _TEXT]
    + [StructField(n, IntegerType()) for n in _WHOLE]
    + [StructField(n, BooleanType()) for n in _FLAGS]
    + [StructField(n, DoubleType()) for n in _REAL]
    + [StructField("transform", ArrayType(ArrayType(DoubleType())))]
)
IMAGES = "image_id string, path string, sequence_id string, sequence_index int"
CLUSTERS = "cluster_id string, sequence_id string, image_ids array<string>, representative_image_id string"
MANIFEST = (
    "index int, image_id string, source_path string, source_project string, sequence_id string, sequence_index int, review_decision string, cluster_status string, "
    "assignment_id string, assignment_type string, original_cluster_id string, included_in_original_cluster boolean, reviewed_at string, package_relative_path string"
)
CASES = (
    "case_id string, images array<string>, relation string, expected_cluster boolean, expected_min_submissions int, "
    "expected_submissions array<struct<image: string, bbox: array<double>, coordinates: string, kind: string, completeness: string, side: string, notes: string>>, "
    "notes string, source string, status string"
)
RESULT_VERSION = 1
