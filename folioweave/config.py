"""Settings of the linking rules, with their ranges.

A setting's full name is its group and its short name, joined by an underscore.
Unknown names are refused; the fingerprint is the first 16 hexadecimal digits of
the SHA-256 of the sorted, compact JSON, and goes with every output.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from typing import Any

#: group -> short name -> default. A float default is a fraction in [0, 1] unless WIDE names it.
DEFAULTS: dict[str, dict[str, Any]] = {
    "": dict(max_gap=3, max_cluster_size=None, max_working_dimension=900, max_features=2500, ratio_test=0.72,
             min_inliers=12, min_inlier_ratio=0.18, min_grid_cells=4, min_x_span=0.30, min_y_span=0.25,
             min_valid_fraction=0.65, change_threshold=0.15, workers=0, cache_features=True, cache_pairs=True,
             cache_working_images=True, feature_cache_compressed=True),
    "sift": dict(contrast_threshold=0.025),
    "ransac": dict(reprojection_px=3.5),
    "standard": dict(max_changed_fraction=0.62, min_feature_overlap=0.11),
    "heavy": dict(max_changed_fraction=0.82, min_feature_overlap=0.18),
    "exceptional": dict(max_changed_fraction=0.90, min_feature_overlap=0.28),
    "tile": dict(columns=8, rows=6, changed_threshold=0.20),
    "content_tile": dict(columns=24, rows=18),
    "ink": dict(gradient_weight=0.16, background_sigma_fraction=0.018, min_response=0.085, tolerance_fraction=0.0025,
                min_component_fraction=0.000003, mismatch_min_component_fraction=0.000008,
                tile_valid_threshold=0.004, tile_union_threshold=0.08),
    "residual": dict(stable_fraction=0.58, upper_tail_fraction=0.20, min_scale=0.012, changed_min_absolute=0.075,
                     changed_z_threshold=2.4),
    "gutter": dict(min_prominence=0.18, search_max_fraction=0.66, search_min_fraction=0.34, min_aspect_ratio=1.15),
    "ecc": dict(fallback_enabled=True, epsilon=0.000001, max_iterations=100, gaussian_filter_size=5, min_correlation=0.30,
                max_translation_fraction=0.18, max_rotation_degrees=5.0, working_dimension=384, coarse_dimension=192,
                min_descriptor_matches=50, min_phase_correlation=0.12),
    "duplicate": dict(max_ink_mismatch_tiles_fraction=0.10, max_unmatched_ink_union_fraction=0.02,
                      max_unmatched_ink_fraction=0.0025, max_changed_fraction=0.35, min_feature_overlap=0.08),
    "contradiction": dict(min_outside_ink_mismatch_tiles_fraction=0.04, min_outside_unmatched_ink_union_fraction=0.08,
                          min_unmatched_ink_union_fraction=0.06, min_residual_tiles_changed_fraction=0.18,
                          min_ink_mismatch_tiles_fraction=0.20),
    "contradiction_text": dict(max_material_median=0.020, min_ink_mismatch_tiles_fraction=0.09,
                               min_unmatched_ink_union_fraction=0.08),
    "contradiction_overwhelming": dict(outside_ink_union_fraction=0.20, unmatched_ink_union_fraction=0.25,
                                       ink_tiles_fraction=0.70),
    "automatic_link": dict(min_physical_occlusion_feature_overlap=0.35, allow_full_page_ecc=False,
                           require_same_filename_prefix=True, max_numeric_filename_gap=12),
    "occlusion": dict(candidate_probability_threshold=0.04, min_feature_overlap=0.10, min_page_area_fraction=0.18,
                      min_component_tiles=2, padding_y_fraction=0.08, padding_x_fraction=0.05,
                      min_residual_capture=0.38, min_support_fill_fraction=0.20, min_page_support_fraction=0.22,
                      min_material_median=0.024, min_material_fraction=0.12, material_changed_fraction=0.40,
                      max_area_fraction=0.85, min_area_fraction=0.025, min_boundary_score=0.90,
                      max_outside_ink_mismatch_tiles_fraction=0.30, max_outside_unmatched_ink_union_fraction=0.06,
                      max_outside_unmatched_ink_fraction=0.028),
    "occlusion_strong": dict(changed_fraction=0.51, min_page_support_fraction=0.15, boundary_score=1.45,
                             boundary_min_capture=0.30, max_outside_ink_mismatch_tiles_fraction=0.45,
                             max_outside_unmatched_ink_union_fraction=0.08),
    "occlusion_extreme": dict(min_material_median=0.020, min_residual_capture=0.55, changed_fraction=0.65,
                              max_outside_ink_mismatch_tiles_fraction=0.55,
                              max_outside_unmatched_ink_union_fraction=0.30),
    "occlusion_clean": dict(min_page_support_fraction=0.40, changed_fraction=0.34,
                            max_outside_unmatched_ink_union_fraction=0.015),
    "occlusion_large_clean": dict(max_unmatched_ink_union_fraction=0.08, max_area_fraction=0.95),
    "occlusion_geometric": dict(max_outside_ink_mismatch_tiles_fraction=0.10, min_material_median=0.020,
                                max_outside_unmatched_ink_union_fraction=0.015, min_residual_capture=0.75,
                                min_page_support_fraction=0.30),
    "occlusion_shallow": dict(min_width_fraction=0.50, max_height_fraction=0.30),
    "occlusion_different_record": dict(max_material_median=0.035, min_ink_mismatch_tiles_fraction=0.75,
                                       min_unmatched_ink_union_fraction=0.45),
    "occlusion_full_page": dict(tile_fraction=0.90, ink_tile_fraction=0.60, material_fraction=0.30,
                                min_material_fraction=0.10, min_changed_fraction=0.72, low_changed_fraction=0.15,
                                strong_material_min_changed_fraction=0.18, strong_material_fraction=0.34,
                                min_ink_mismatch_fraction=0.45),
    "occlusion_full_page_text": dict(max_material_median=0.08, min_ink_mismatch_tiles_fraction=0.55,
                                     max_inside_unmatched_ink_union_fraction=0.60),
    "occlusion_ink_block": dict(max_gap=1, min_rows=3, min_width_fraction=0.35, min_occupancy=0.45,
                                column_density=0.35, row_density=0.40),
    "occlusion_dirty_exterior": dict(min_ink_mismatch_tiles_fraction=0.40, min_unmatched_ink_union_fraction=0.10,
                                     min_alignment_score=0.55, min_feature_overlap=0.15),
    "occlusion_evidence": dict(distributed_penalty=0.05, distributed_outside_tiles_fraction=0.55,
                               distributed_outside_union_fraction=0.20,
                               full_inside_unmatched_ink_union_fraction=0.70,
                               min_inside_unmatched_ink_union_fraction=0.35, full_localization_contrast=0.35,
                               min_localization_contrast=0.03, full_ink_mismatch_capture=0.75,
                               min_ink_mismatch_capture=0.15),
}

#: Floats that are no fractions.
WIDE = {"ransac_reprojection_px", "residual_changed_z_threshold", "gutter_min_aspect_ratio", "ecc_max_rotation_degrees", "occlusion_strong_boundary_score"}

_FLAT = {f"{group}_{name}" if group else name: value for group, names in DEFAULTS.items() for name, value in names.items()}


class LinkConfig:
    """All settings as attributes; ``LinkConfig(max_gap=2)`` overrides some."""

    def __init__(self, **overrides: Any):
        unknown = sorted(set(overrides) - set(_FLAT))
        if unknown:
            raise ValueError(f"no such settings: {', '.join(unknown)}")
        self._values = _FLAT | overrides
        self._validate()

    def __getattr__(self, name: str) -> Any:
        try:
            return self.__dict__["_values"][name]
        except KeyError:
            raise AttributeError(name) from None

    def _validate(self) -> None:
        for name, default in _FLAT.items():
            value = self._values[name]
            if isinstance(default, bool):
                if not isinstance(value, bool):
                    raise ValueError(f"{name} must be true or false")
            elif isinstance(default, float):
                if not isinstance(value, (int, float)) or value != value or value < 0 or (name not in WIDE and value > 1):
                    raise ValueError(f"{name} is out of range: {value}")
            elif isinstance(default, int) and (not isinstance(value, int) or value < 0):
                raise ValueError(f"{name} must be a whole number that is not negative")
        if self.max_gap < 1 or (self.max_cluster_size is not None and self.max_cluster_size < 1):
            raise ValueError("max_gap and max_cluster_size must be positive")
        for stem in ("ink_mismatch_capture", "localization_contrast", "inside_unmatched_ink_union_fraction"):
            if self._values[f"occlusion_evidence_full_{stem}"] <= self._values[f"occlusion_evidence_min_{stem}"]:
                raise ValueError(f"the full value of {stem} must exceed its minimum")
        if self.ecc_gaussian_filter_size % 2 == 0:
            raise ValueError("ecc_gaussian_filter_size must be odd")

    def as_dict(self) -> dict[str, Any]:
        return dict(self._values)

    @classmethod
    def from_mapping(cls, values: Mapping[str, Any] | None) -> LinkConfig:
        return cls(**dict(values or {}))

    def fingerprint(self) -> str:
        return hashlib.sha256(json.dumps(self._values, separators=(",", ":"), sort_keys=True).encode()).hexdigest()[:16]
