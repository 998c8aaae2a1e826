"""Probabilities of the three states of a pair: same and clean, same and occluded, different."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import LinkConfig
from ..functions.numeric import clamp, finite_or_zero, linear, ramp, sigmoid
from . import decide as rules

c = F.col

#: feature -> weight in P(same), weight in P(occluded given same).
WEIGHTS: dict[str, tuple[float, float]] = {
    "registration_fallback_used": (-3.30523264275, -0.0862595982891),
    "inlier_ratio": (1.54165319374, 4.63165727698),
    "feature_overlap": (10.8673154655, -39.7763158242),
    "x_span": (3.02391782739, 5.40568144254),
    "y_span": (2.95748489785, -3.80712561427),
    "valid_fraction": (14.318220195, 29.3484218594),
    "changed_fraction": (1.3601496971, 12.8020717636),
    "unmatched_ink_fraction": (12.911490102, 112.588110255),
    "unmatched_ink_union_fraction": (9.98239985807, 30.6888764169),
    "largest_ink_component_fraction": (-25.104974442, -367.37276427),
    "residual_tiles_changed_fraction": (2.94313315568, -4.59443003663),
    "ink_mismatch_tiles_fraction": (-7.41409816239, 41.4537202459),
    "occlusion_candidate_count": (-0.113294723829, 2.20572211637),
    "occlusion_area_fraction": (-2.76520017095, 1.35998083064),
    "occlusion_residual_capture": (0.717476905671, 2.2674292895),
    "occlusion_rectangularity": (1.26170244453, 5.08228494261),
    "occlusion_material_fraction": (-0.450872517669, 7.48353954155),
    "occlusion_material_median": (0.468714776354, 3.74987617885),
    "outside_unmatched_ink_fraction": (6.20489537405, 68.8749943246),
    "outside_unmatched_ink_union_fraction": (-1.86654378948, -10.1167134239),
    "outside_ink_mismatch_tiles_fraction": (-0.382983552484, 0.103324514267),
    "visible_exterior_fraction": (2.76520017095, -1.35998083064),
}
INTERCEPTS = (-25.032403217297773, -40.3619545391732)


def features() -> list[tuple[str, Column]]:
    """The 22 inputs in their fixed order; what is not finite counts as 0."""
    special = {"visible_exterior_fraction": F.greatest(F.lit(0.0), 1 - c("occlusion_area_fraction"))}
    return [(name, finite_or_zero(special.get(name, c(name) if name not in special else F.lit(0)))) for name in WEIGHTS]


def model(which: int) -> Column:
    return sigmoid(linear(INTERCEPTS[which], [(WEIGHTS[name][which], value) for name, value in features()]))


def occlusion_evidence(cfg: LinkConfig) -> Column:
    """0 to 1, over ``with_rules``: how well one block explains where the text differs."""
    support = c("_support")
    at = lambda name, low, high: ramp(c(name), low, high)
    evidence = lambda stem: (getattr(cfg, f"occlusion_evidence_min_{stem}"), getattr(cfg, f"occlusion_evidence_full_{stem}"))
    inside = at("inside_unmatched_ink_union_fraction", *evidence("inside_unmatched_ink_union_fraction"))
    ink = at("occlusion_ink_mismatch_capture", *evidence("ink_mismatch_capture"))
    contrast = at("occlusion_localization_contrast", *evidence("localization_contrast"))
    material = at("occlusion_material_median", 0.006, max(0.04, 2.0 * cfg.occlusion_min_material_median))
    least_support, least_capture, least_fill = cfg.occlusion_min_page_support_fraction, cfg.occlusion_min_residual_capture, cfg.occlusion_min_support_fill_fraction
    clean_union = 1 - at("outside_unmatched_ink_union_fraction", cfg.occlusion_clean_max_outside_unmatched_ink_union_fraction, cfg.occlusion_extreme_max_outside_unmatched_ink_union_fraction)
    clean_tiles = 1 - at("outside_ink_mismatch_tiles_fraction", cfg.occlusion_geometric_max_outside_ink_mismatch_tiles_fraction, cfg.occlusion_extreme_max_outside_ink_mismatch_tiles_fraction)
    agreement = F.least(clean_union, clean_tiles)
    agreement = F.when((c("full_page_occlusion_count") > 0) & (support >= 0.70), F.greatest(agreement, 0.50 * material)).otherwise(agreement)
    parts = (
        (0.12, ramp(support, least_support * 0.45, least_support)),
        (0.22, at("occlusion_residual_capture", least_capture * 0.45, min(1.0, least_capture * 1.75))),
        (0.22, 0.55 * ink + 0.25 * contrast + 0.20 * inside),
        (0.18, agreement),
        (0.08, at("occlusion_rectangularity", least_fill * 0.50, max(0.60, least_fill * 2.5))),
        (0.18, F.greatest(inside, material)),
    )
    total = reduce(lambda x, y: x + y, (weight * value for weight, value in parts))
    spread = (c("outside_unmatched_ink_union_fraction") >= cfg.occlusion_evidence_distributed_outside_union_fraction) & (
        c("outside_ink_mismatch_tiles_fraction") >= cfg.occlusion_evidence_distributed_outside_tiles_fraction
    )
    weak = (c("occlusion_ink_mismatch_capture") < evidence("ink_mismatch_capture")[0]) & (c("occlusion_residual_capture") < least_capture)
    thin = (c("inside_unmatched_ink_union_fraction") < evidence("inside_unmatched_ink_union_fraction")[0]) & (c("occlusion_material_median") < 0.006) & ~c("_erased")
    penalty = F.when(spread | weak | thin | c("_page_text"), F.lit(cfg.occlusion_evidence_distributed_penalty)).otherwise(F.lit(1.0))
    return F.when(c("occlusion_candidate_count").between(1, 2), clamp(total * penalty)).otherwise(F.lit(0.0))


def identity_support(cfg: LinkConfig) -> Column:
    """Below 1 where a noisy exterior meets weak alignment."""
    overlap = cfg.occlusion_dirty_exterior_min_feature_overlap
    aligned = F.when(
        c("registration_fallback_used"), ramp(c("registration_alignment_score"), cfg.ecc_min_correlation, cfg.occlusion_dirty_exterior_min_alignment_score)
    ).otherwise(ramp(c("feature_overlap"), 0.40 * overlap, overlap))
    return F.when(rules.dirty_exterior(cfg), aligned).otherwise(F.lit(1.0))


def _holds(limits: dict[str, tuple[float | None, float | None]]) -> Column:
    parts = []
    for name, (low, high) in limits.items():
        parts += [c(name) >= low] if low is not None else []
        parts += [c(name) <= high] if high is not None else []
    return reduce(lambda x, y: x & y, parts)


def material_block() -> Column:
    """A coherent block that the model under-rates; for review only."""
    return _holds({
        "same_document_probability": (0.90, None), "occlusion_candidate_count": (1, 1), "occlusion_evidence": (0.75, None),
        "occlusion_ink_mismatch_capture": (0.90, None), "inside_unmatched_ink_union_fraction": (0.25, None),
        "outside_unmatched_ink_union_fraction": (None, 0.03), "outside_ink_mismatch_tiles_fraction": (None, 0.10),
        "occlusion_material_median": (0.02, None),
    })


def low_text_block() -> Column:
    """A broad block over nearly blank parts; for review only."""
    return ~c("registration_fallback_used") & _holds({
        "same_document_probability": (0.95, None), "feature_overlap": (0.45, None), "occlusion_candidate_count": (1, 2),
        "occlusion_area_fraction": (0.25, None), "occlusion_residual_capture": (0.80, None), "occlusion_material_median": (0.01, None),
        "outside_unmatched_ink_union_fraction": (None, 0.01), "outside_ink_mismatch_tiles_fraction": (None, 0.05),
        "inside_unmatched_ink_union_fraction": (None, 0.05), "occlusion_localization_contrast": (None, 0.05),
    })


def pair_probabilities(pairs: DataFrame, cfg: LinkConfig | None = None) -> DataFrame:
    """The pairs with the probabilities and occlusion_candidate_flag; the two same-states add up to same_document_probability."""
    cfg = cfg or LinkConfig()
    return (
        rules.with_rules(pairs, cfg)
        .withColumn("same_document_probability", model(0))
        .withColumn("raw_occluded_given_same_probability", model(1))
        .withColumn("occlusion_evidence", occlusion_evidence(cfg) * identity_support(cfg))
        .withColumn("occluded_given_same_probability", c("raw_occluded_given_same_probability") * c("occlusion_evidence"))
        .withColumn("same_occluded_probability", c("same_document_probability") * c("occluded_given_same_probability"))
        .withColumn("same_clean_probability", c("same_document_probability") * (1 - c("occluded_given_same_probability")))
        .withColumn("different_document_probability", 1 - c("same_document_probability"))
        .withColumn(
            "occlusion_candidate_flag",
            (c("same_occluded_probability") >= cfg.occlusion_candidate_probability_threshold) | c("_erased") | material_block() | low_text_block(),
        )
        .drop(*rules.RULES)
    )
