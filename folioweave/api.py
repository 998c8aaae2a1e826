"""The engine's entry points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import LinkConfig
from .materialize import materialize
from .operators import components, crops, decide, graph, pairs as near, probability, ranking
from .operators import images as captures
from .sources import readers, schemas, writers

#: What a pair is that could not be registered.
UNREGISTERED = {
    "same_document": False, "hard_contradiction": False, "automatic_link_eligible": False, "occlusion_candidate_flag": False, "confidence": 0.0,
    "same_document_probability": 0.0, "raw_occluded_given_same_probability": 0.0, "occlusion_evidence": 0.0, "occluded_given_same_probability": 0.0,
    "same_occluded_probability": 0.0, "same_clean_probability": 0.0, "different_document_probability": 1.0,
}


def cluster(images: DataFrame, pairs: DataFrame, cfg: LinkConfig | None = None) -> dict[str, DataFrame]:
    """images, pairs (decided, with probabilities) and clusters.

    ``pairs`` has the measurements of neighbouring images (sequence_id,
    first_image_id, second_image_id, index_gap, metrics); paths decide safety.
    Pairs with a registration_reason were not registered and are never linked.
    """
    cfg = cfg or LinkConfig()
    path = images.select("image_id", "path")
    placed = pairs.join(path.toDF("first_image_id", "_p1"), "first_image_id").join(path.toDF("second_image_id", "_p2"), "second_image_id")
    decided = decide.decide(placed, cfg, ("_p1", "_p2")).drop("_p1", "_p2")
    scored = probability.pair_probabilities(decided, cfg)
    if "registration_reason" in pairs.columns:
        refused = F.col("registration_reason").isNotNull()
        scored = scored.withColumns({k: F.when(refused, F.lit(v)).otherwise(F.col(k)) for k, v in UNREGISTERED.items()} | {
            "branch": F.when(~refused, F.col("branch")), "safety_reason": F.when(~refused, F.col("safety_reason")), "reason": F.coalesce("registration_reason", "reason"),
        })
    scored = materialize(scored)
    members = graph.constrained_groups(images.select("sequence_id", "image_id", "sequence_index"), scored, cfg.max_cluster_size)
    return {"images": images, "pairs": scored, "clusters": graph.cluster_records(members, scored)}


def cluster_files(images: DataFrame, contents: DataFrame, cfg: LinkConfig | None = None) -> dict[str, DataFrame]:
    """``cluster`` of images (image_id, path, sequence_id, sequence_index) by the pixels in contents (image_id, content)."""
    cfg = cfg or LinkConfig()
    return cluster(images, captures.measured_pairs(images, contents, cfg), cfg)


def _contents(spark: SparkSession, paths: str | list[str], images: DataFrame) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    return files.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "content").join(images.select("image_id", "path"), "path").select("image_id", "content")


def cluster_directory(spark: SparkSession, folder: str, cfg: LinkConfig | None = None, manifest: DataFrame | None = None) -> dict[str, DataFrame]:
    """Groups of the images below a folder: each folder is a sequence by file name, or each group of a manifest (see ``readers.join_group_manifest``)."""
    cfg = cfg or LinkConfig()
    images = readers.scan_images(spark, folder)
    if manifest is not None:
        images = readers.join_group_manifest(manifest, images, cfg.max_cluster_size)
    return cluster_files(images, _contents(spark, folder, images), cfg)


def cluster_images(spark: SparkSession, paths: list[str], sequence: str = ".", cfg: LinkConfig | None = None) -> dict[str, DataFrame]:
    """Groups of the given files, in the given order."""
    images = readers.ordered_images(spark, paths, sequence)
    return cluster_files(images, _contents(spark, list(paths), images), cfg)


def crop_groups(images: DataFrame, contents: DataFrame, groups: DataFrame | None = None, cfg: LinkConfig | None = None, settings: crops.CropSettings | None = None) -> dict[str, DataFrame]:
    """members (group_id, image_id, position), edges and submissions; groups (group_id, image_id) are given, or found by the edges of neighbours."""
    cfg, s = cfg or LinkConfig(), settings or crops.CropSettings()
    loaded = materialize(captures.load_images(contents, LinkConfig(**cfg.as_dict() | {"max_working_dimension": s.max_dimension, "max_features": s.features})))
    if groups is None:
        placed = images.withColumn("_in", F.col("sequence_id"))
    else:
        placed = images.join(groups.select("image_id", F.col("group_id").alias("_in")), "image_id")
    pairs = near.neighbour_pairs(placed, "_in", ["sequence_index", "image_id"], ["image_id"], s.window)
    edges = materialize(crops.crop_edges(pairs.select(F.col("a.image_id").alias("a"), F.col("b.image_id").alias("b")), loaded, s))
    if groups is None:
        of = components.components(placed, edges.join(placed.select(F.col("image_id").alias("a"), "sequence_id"), "a"), ["sequence_id", "image_id"], "sequence_index")
        placed = placed.join(of.select("image_id", F.col("root").alias("group_id")), "image_id")
    else:
        placed = placed.withColumn("group_id", F.col("_in"))
    members = placed.select("group_id", "image_id", F.col("sequence_index").alias("position"))
    return {"members": members, "edges": edges, "submissions": crops.by_bucket(crops.recover_crops(members, loaded, edges, cfg, s))}


def crop_directory(spark: SparkSession, folder: str, **options) -> dict[str, DataFrame]:
    """``crop_groups`` of the images below a folder."""
    images = readers.scan_images(spark, folder)
    return crop_groups(images, _contents(spark, folder, images), **options)


def crop_result(spark: SparkSession, result: dict[str, DataFrame], folder: str, **options) -> dict[str, DataFrame]:
    """``crop_groups`` of the clusters of a result, whose images lie below a folder."""
    groups = result["clusters"].select(F.col("cluster_id").alias("group_id"), F.explode("image_ids").alias("image_id"))
    return crop_groups(result["images"], _contents(spark, folder, result["images"]), groups, **options)


def rank_candidates(result: dict[str, DataFrame], cfg: LinkConfig | None = None, **flags: bool) -> DataFrame:
    members = result["clusters"].select(F.explode("image_ids").alias("image_id"), F.col("cluster_id").alias("root"))
    return ranking.rank_candidates(result["pairs"], members, cfg, **flags)


def write_result(result: dict[str, DataFrame], folder: str, cfg: LinkConfig | None = None) -> None:
    writers.write_result(result["images"], result["clusters"], result["pairs"], folder, (cfg or LinkConfig()).fingerprint())


def read_result(spark, folder: str) -> dict[str, DataFrame]:
    return writers.read_tables(spark, folder)


__all__ = ["LinkConfig", "cluster", "cluster_directory", "cluster_files", "cluster_images", "crop_directory", "crop_groups", "crop_result", "rank_candidates", "read_result", "readers", "schemas", "write_result"]
