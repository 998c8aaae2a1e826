"""The decision rules for a pair, as Column expressions over its metrics.

Metric names are those of the canonical pair schema (see ``sources.schemas``).
Everything here is generated code: no rule needs Python.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import LinkConfig
from ..functions.numeric import clamp
from ..functions.text import name_position

c = F.col


def _all(*parts: Column) -> Column:
    return reduce(lambda x, y: x & y, parts)


def _any(*parts: Column) -> Column:
    return reduce(lambda x, y: x | y, parts)


def page_support() -> Column:
    """The share of a page that a candidate covers on average."""
    pages = F.greatest(c("page_count"), F.lit(1))
    return c("occlusion_area_fraction") * pages / F.greatest(c("occlusion_candidate_count"), F.lit(1))


def registration_support(least: float, cfg: LinkConfig) -> Column:
    return F.when(c("registration_fallback_used"), c("registration_alignment_score") >= cfg.ecc_min_correlation).otherwise(c("feature_overlap") >= least)


def near_duplicate(cfg: LinkConfig) -> Column:
    limits = {
        "changed_fraction": cfg.duplicate_max_changed_fraction,
        "unmatched_ink_fraction": cfg.duplicate_max_unmatched_ink_fraction,
        "unmatched_ink_union_fraction": cfg.duplicate_max_unmatched_ink_union_fraction,
        "ink_mismatch_tiles_fraction": cfg.duplicate_max_ink_mismatch_tiles_fraction,
    }
    return _all(registration_support(cfg.duplicate_min_feature_overlap, cfg), *(c(k) <= v for k, v in limits.items()))


def full_page_text(cfg: LinkConfig) -> Column:
    """Text replaced over a whole page, which a sheet laid on it could be taken for."""
    return _all(
        c("full_page_occlusion_count") > 0,
        c("_support") >= 0.75,
        c("ink_mismatch_tiles_fraction") >= cfg.occlusion_full_page_text_min_ink_mismatch_tiles_fraction,
        c("occlusion_material_median") < cfg.occlusion_full_page_text_max_material_median,
        c("inside_unmatched_ink_union_fraction") < cfg.occlusion_full_page_text_max_inside_unmatched_ink_union_fraction,
    )


def text_erasure(cfg: LinkConfig) -> Column:
    """One block lost its text while all around it stayed the same."""
    at_least = {
        "occlusion_ink_mismatch_capture": max(0.85, cfg.occlusion_evidence_full_ink_mismatch_capture),
        "occlusion_localization_contrast": cfg.occlusion_evidence_full_localization_contrast,
        "occlusion_residual_capture": cfg.occlusion_geometric_min_residual_capture,
        "occlusion_rectangularity": cfg.occlusion_min_support_fill_fraction,
    }
    at_most = {
        "outside_unmatched_ink_union_fraction": cfg.occlusion_clean_max_outside_unmatched_ink_union_fraction,
        "outside_ink_mismatch_tiles_fraction": cfg.occlusion_geometric_max_outside_ink_mismatch_tiles_fraction,
    }
    return _all(
        ~c("_page_text"),
        c("_support") >= cfg.occlusion_geometric_min_page_support_fraction,
        *(c(k) >= v for k, v in at_least.items()),
        *(c(k) <= v for k, v in at_most.items()),
    )


def different_record(cfg: LinkConfig) -> Column:
    """The same form, filled in with something else."""
    union, tiles, material = c("unmatched_ink_union_fraction"), c("ink_mismatch_tiles_fraction"), c("occlusion_material_median")
    overwhelming = _all(
        union >= cfg.occlusion_different_record_min_unmatched_ink_union_fraction,
        tiles >= cfg.occlusion_different_record_min_ink_mismatch_tiles_fraction,
        material < cfg.occlusion_different_record_max_material_median,
    )
    thin = _all(
        union >= cfg.contradiction_text_min_unmatched_ink_union_fraction,
        tiles >= cfg.contradiction_text_min_ink_mismatch_tiles_fraction,
        c("inside_unmatched_ink_union_fraction") < cfg.occlusion_evidence_min_inside_unmatched_ink_union_fraction,
        material < 0.006,
        ~c("_erased"),
    )
    spread = _all(
        c("outside_unmatched_ink_union_fraction") >= cfg.occlusion_evidence_distributed_outside_union_fraction,
        c("outside_ink_mismatch_tiles_fraction") >= cfg.occlusion_evidence_distributed_outside_tiles_fraction,
        c("occlusion_ink_mismatch_capture") < 0.60,
    )
    return _any(overwhelming, thin, spread, c("_page_text"))


def physical_occlusion(cfg: LinkConfig) -> Column:
    """A large block laid over the page explains the difference."""
    changed, capture, material = c("changed_fraction"), c("occlusion_residual_capture"), c("occlusion_material_median")
    outside_union, outside_tiles = c("outside_unmatched_ink_union_fraction"), c("outside_ink_mismatch_tiles_fraction")
    support = c("occlusion_area_fraction") * c("page_count") / F.greatest(c("occlusion_candidate_count"), F.lit(1))
    erased = c("_erased")
    strong = changed >= cfg.occlusion_strong_changed_fraction
    extreme = _all(
        changed >= cfg.occlusion_extreme_changed_fraction,
        capture >= cfg.occlusion_extreme_min_residual_capture,
        material >= cfg.occlusion_extreme_min_material_median,
    )

    def limit(name: str) -> Column:
        by_kind = (getattr(cfg, f"occlusion_{kind}max_{name}") for kind in ("extreme_", "strong_", ""))
        most, middle, least = by_kind
        return F.when(extreme, F.lit(most)).when(strong, F.lit(middle)).otherwise(F.lit(least))

    gates = (
        registration_support(cfg.occlusion_min_feature_overlap, cfg),
        c("occlusion_candidate_count").between(1, 2),
        ~c("_other_record"),
        c("occlusion_ink_mismatch_capture") >= cfg.occlusion_evidence_min_ink_mismatch_capture,
        c("occlusion_localization_contrast") >= cfg.occlusion_evidence_min_localization_contrast,
        _any(c("inside_unmatched_ink_union_fraction") >= cfg.occlusion_evidence_min_inside_unmatched_ink_union_fraction, material >= 0.006, erased),
        support >= F.when(strong, F.lit(cfg.occlusion_strong_min_page_support_fraction)).otherwise(F.lit(cfg.occlusion_min_page_support_fraction)),
        c("occlusion_rectangularity") >= cfg.occlusion_min_support_fill_fraction,
        capture >= cfg.occlusion_min_residual_capture,
        outside_union <= limit("outside_unmatched_ink_union_fraction"),
        outside_tiles <= limit("outside_ink_mismatch_tiles_fraction"),
    )
    clean = _all(
        changed >= cfg.occlusion_clean_changed_fraction,
        outside_union <= cfg.occlusion_clean_max_outside_unmatched_ink_union_fraction,
        support >= cfg.occlusion_clean_min_page_support_fraction,
    )
    geometric = _all(
        support >= cfg.occlusion_geometric_min_page_support_fraction,
        capture >= cfg.occlusion_geometric_min_residual_capture,
        material >= cfg.occlusion_geometric_min_material_median,
        outside_union <= cfg.occlusion_geometric_max_outside_unmatched_ink_union_fraction,
        outside_tiles <= cfg.occlusion_geometric_max_outside_ink_mismatch_tiles_fraction,
    )
    by_material = (changed >= cfg.occlusion_material_changed_fraction) & (material >= cfg.occlusion_min_material_median)
    return _all(*gates, _any(strong, by_material, clean, geometric, extreme, erased))


def raw_contradiction(cfg: LinkConfig) -> Column:
    """Disagreement all over the page, whether or not the pair was accepted."""
    union, tiles = c("unmatched_ink_union_fraction"), c("ink_mismatch_tiles_fraction")
    outside_union, outside_tiles = c("outside_unmatched_ink_union_fraction"), c("outside_ink_mismatch_tiles_fraction")
    replaced = _all(
        union >= cfg.contradiction_text_min_unmatched_ink_union_fraction,
        tiles >= cfg.contradiction_text_min_ink_mismatch_tiles_fraction,
        c("occlusion_material_median") <= cfg.contradiction_text_max_material_median,
    )
    two_sheets = _all(c("occlusion_candidate_count") == 2, c("occlusion_material_fraction") >= 0.50, outside_union <= 0.04, outside_tiles <= 0.15)
    ink = (tiles >= cfg.contradiction_min_ink_mismatch_tiles_fraction) & (union >= cfg.contradiction_min_unmatched_ink_union_fraction)
    exterior = _all(
        c("residual_tiles_changed_fraction") >= cfg.contradiction_min_residual_tiles_changed_fraction,
        outside_union >= cfg.contradiction_min_outside_unmatched_ink_union_fraction,
        outside_tiles >= cfg.contradiction_min_outside_ink_mismatch_tiles_fraction,
    )
    overwhelming = _all(
        tiles >= cfg.contradiction_overwhelming_ink_tiles_fraction,
        union >= cfg.contradiction_overwhelming_unmatched_ink_union_fraction,
        outside_union >= cfg.contradiction_overwhelming_outside_ink_union_fraction,
    )
    return _any(c("_other_record"), replaced, ~two_sheets & _any(ink, exterior, overwhelming))


#: The columns that ``with_rules`` adds.
RULES = ("_support", "_page_text", "_erased", "_other_record", "_occluded", "_raw")


def with_rules(pairs: DataFrame, cfg: LinkConfig) -> DataFrame:
    """The pairs with the rules as columns, step by step.

    Each rule is used by several later ones. As columns they are computed once
    and the optimizer keeps the steps apart; nested into each other as
    expressions they would multiply.
    """
    steps = (
        {"_support": page_support()},
        {"_page_text": full_page_text(cfg)},
        {"_erased": text_erasure(cfg)},
        {"_other_record": different_record(cfg)},
        {"_occluded": physical_occlusion(cfg), "_raw": raw_contradiction(cfg)},
    )
    for step in steps:
        pairs = pairs.withColumns(step)
    return pairs


NEAR, OCCLUDED = "near_duplicate", "physical_occlusion"


def decision(cfg: LinkConfig) -> Column:
    """struct<accepted, branch, reason> over ``with_rules``; the first rule that holds decides."""

    def outcome(reason: str, branch: str | None = None) -> Column:
        return F.struct(F.lit(branch is not None).alias("accepted"), F.lit(branch).cast("string").alias("branch"), F.lit(reason).alias("reason"))

    return (
        F.when(c("valid_fraction") < cfg.min_valid_fraction, outcome("insufficient valid overlap"))
        .when(near_duplicate(cfg), outcome("ink agrees nearly everywhere", NEAR))
        .when(c("_other_record"), outcome("same form, different entries"))
        .when(c("_occluded"), outcome("one large block covers part of the page", OCCLUDED))
        .when(~registration_support(cfg.occlusion_min_feature_overlap, cfg), outcome("weak registration support"))
        .when(c("ink_mismatch_tiles_fraction") >= 0.20, outcome("ink disagrees in many places"))
        .when(c("occlusion_candidate_count") == 0, outcome("no block explains the disagreement"))
        .when(c("outside_unmatched_ink_union_fraction") > cfg.occlusion_max_outside_unmatched_ink_union_fraction, outcome("ink disagrees outside the block"))
        .when(c("_raw"), outcome("ink or exterior disagrees all over"))
        .otherwise(outcome("block support, density or exterior insufficient"))
    )


def confidence(accepted: Column, branch: Column) -> Column:
    """At least 0.5 for accepted pairs, at most 0.49 for the others."""
    support = F.when(c("registration_fallback_used"), clamp((c("registration_alignment_score") - 0.30) / 0.50)).otherwise(clamp((c("feature_overlap") - 0.06) / 0.24))
    ink = clamp(1 - c("unmatched_ink_union_fraction") / 0.02)
    outside = clamp(1 - c("outside_unmatched_ink_union_fraction") / 0.08)
    capture = clamp(c("occlusion_residual_capture") / 0.70)
    disagreement = clamp(c("ink_mismatch_tiles_fraction") / 0.40)
    score = (
        F.when(branch == NEAR, 0.45 * support + 0.55 * ink)
        .when(branch == OCCLUDED, 0.40 * outside + 0.30 * (support + capture))
        .otherwise(0.35 * support + 0.15 * (1 - disagreement))
    )
    return F.when(accepted, F.greatest(score, F.lit(0.50))).otherwise(F.least(score, F.lit(0.49)))


def dirty_exterior(cfg: LinkConfig) -> Column:
    return (c("outside_unmatched_ink_union_fraction") >= cfg.occlusion_dirty_exterior_min_unmatched_ink_union_fraction) & (
        c("outside_ink_mismatch_tiles_fraction") >= cfg.occlusion_dirty_exterior_min_ink_mismatch_tiles_fraction
    )


def safety_reason(first_path: Column, second_path: Column, branch: Column, cfg: LinkConfig) -> Column:
    """Why an accepted pair stays for review only, or null."""
    (prefix_a, number_a), (prefix_b, number_b) = name_position(first_path), name_position(second_path)
    placed = prefix_a.isNotNull() & prefix_b.isNotNull()
    occluded = branch.eqNullSafe(OCCLUDED)
    fallback, overlap = c("registration_fallback_used"), c("feature_overlap")
    identified = (overlap >= cfg.occlusion_dirty_exterior_min_feature_overlap) | (c("registration_alignment_score") >= cfg.occlusion_dirty_exterior_min_alignment_score)
    return (
        F.when(placed & F.lit(cfg.automatic_link_require_same_filename_prefix) & (prefix_a != prefix_b), F.lit("filename prefixes differ"))
        .when(placed & (prefix_a == prefix_b) & (F.abs(number_a - number_b) > cfg.automatic_link_max_numeric_filename_gap), F.lit("filename positions too far apart"))
        .when(F.lit(not cfg.automatic_link_allow_full_page_ecc) & fallback & (c("full_page_occlusion_count") > 0), F.lit("full page by fallback registration"))
        .when(occluded & (fallback | (overlap < cfg.automatic_link_min_physical_occlusion_feature_overlap)), F.lit("occlusion without strong overlap"))
        .when(occluded & dirty_exterior(cfg) & ~identified, F.lit("dirty exterior without strong registration support"))
    )


def decide(pairs: DataFrame, cfg: LinkConfig | None = None, paths: tuple[str, str] | None = None) -> DataFrame:
    """The pairs with same_document, branch, reason, confidence, hard_contradiction, automatic_link_eligible, safety_reason.

    A match that a safety reason keeps for review is no edge: same_document is
    false for it, while its branch and the freedom from contradiction remain.
    """
    cfg = cfg or LinkConfig()
    out = with_rules(pairs, cfg).withColumn("_d", decision(cfg)).select("*", c("_d.accepted").alias("_accepted"), c("_d.branch").alias("branch"), c("_d.reason").alias("reason")).drop("_d")
    safety = safety_reason(c(paths[0]), c(paths[1]), c("branch"), cfg) if paths else F.lit(None).cast("string")
    return (
        out.withColumn("hard_contradiction", ~c("_accepted") & c("_raw"))
        .withColumn("safety_reason", F.when(c("_accepted"), safety))
        .withColumn("same_document", c("_accepted") & c("safety_reason").isNull())
        .withColumn("reason", F.when(c("safety_reason").isNotNull(), F.concat(F.lit("review only: "), c("safety_reason"))).otherwise(c("reason")))
        .withColumn("confidence", confidence(c("same_document"), c("branch")))
        .withColumn("automatic_link_eligible", c("same_document") & ~c("hard_contradiction"))
        .drop("_accepted", *RULES)
    )
