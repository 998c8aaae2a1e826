"""Ranking of pairs for review. Ranking never makes an edge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import LinkConfig
from . import decide
from .graph import _measured
from .pairs import common_neighbours, symmetric_neighbours
from .ranks import ranked as numbered

c = F.col

REASONS = (
    "accepted although the content contradicts",
    "both are linked to a common neighbour",
    "already in one group",
    "high score without support from the graph",
    "contradiction: for an expert",
    "accepted without conflict",
)


def tier(conflict: Column, accepted: Column, contradiction: Column, common: Column, together: Column) -> Column:
    """0 (most urgent) to 5."""
    return (
        F.when(conflict, F.lit(0)).when(accepted, F.lit(5)).when(contradiction, F.lit(4))
        .when(F.size(common) > 0, F.lit(1)).when(together, F.lit(2)).otherwise(F.lit(3))
    )


def rank_candidates(pairs: DataFrame, members: DataFrame, cfg: LinkConfig | None = None, include_unflagged: bool = False, include_accepted: bool = False) -> DataFrame:
    """The pairs to review with review_tier, priority_reason and review_rank (from 1, ties by ids).

    ``members`` has image_id and root. Accepted pairs appear if their content
    contradicts them, or if asked for; the others if flagged, or if asked for.
    """
    cfg = cfg or LinkConfig()
    edges = pairs.where("same_document").select(c("first_image_id").alias("a"), c("second_image_id").alias("b"))
    root = members.select("image_id", "root")
    ranked = (
        decide.with_rules(pairs, cfg)
        .where(c("same_document") | c("occlusion_candidate_flag") | F.lit(include_unflagged))
        .withColumn("raw_hard_contradiction", _measured() & c("_raw"))
        .drop(*decide.RULES)
        .withColumn("acceptance_conflict", c("same_document") & c("raw_hard_contradiction"))
        .where(~c("same_document") | c("acceptance_conflict") | F.lit(include_accepted))
        .join(root.toDF("first_image_id", "_r1"), "first_image_id", "left")
        .join(root.toDF("second_image_id", "_r2"), "second_image_id", "left")
        .withColumn("same_component", F.coalesce(c("_r1") == c("_r2"), F.lit(False)))
        .drop("_r1", "_r2")
    )
    near = common_neighbours(ranked, symmetric_neighbours(edges), "first_image_id", "second_image_id")
    level = tier(c("acceptance_conflict"), c("same_document"), c("hard_contradiction"), c("common"), c("same_component"))
    tiered = (
        near.withColumn("review_tier", level)
        .withColumn("priority_reason", F.element_at(F.array(*map(F.lit, REASONS)), c("review_tier") + 1))
        .withColumnRenamed("common", "common_accepted_neighbors")
    )
    # tiers and probabilities in one falling score, which decides the buckets; the keys themselves decide the order in them
    likely = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("same_occluded_probability", F.lit(0.0))))
    keys = [c("review_tier"), c("same_occluded_probability").desc(), c("index_gap"), c("first_image_id"), c("second_image_id")]
    return numbered(tiered.withColumn("_score", (5 - c("review_tier") + likely) / 6), "_score", keys, "review_rank").drop("_score")


def summarize(candidates: DataFrame) -> DataFrame:
    """Counts by tier and, with a null tier, over all, in one pass."""
    return candidates.groupingSets([["review_tier"], []], "review_tier").agg(
        F.count("*").alias("pairs"),
        F.count_if("acceptance_conflict").alias("conflicts"),
        F.count_if("hard_contradiction").alias("contradictions"),
        F.count_if(F.size("common_accepted_neighbors") > 0).alias("with_common_neighbour"),
        F.count_if("registration_fallback_used").alias("by_fallback"),
    )
