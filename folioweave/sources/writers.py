"""Writers. Spark's commit protocol makes each of them atomic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_result(images: DataFrame, clusters: DataFrame, pairs: DataFrame, folder: str, fingerprint: str) -> None:
    """Parquet tables, the pair scores as CSV too, and one row of counts."""
    for name, df in (("images", images), ("clusters", clusters), ("pairs", pairs)):
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    flat = [f.name for f in pairs.schema.fields if not f.dataType.simpleString().startswith(("array", "map", "struct"))]
    pairs.select(*flat).write.mode("overwrite").option("header", True).csv(f"{folder}/pair_scores")
    run_counts(images, clusters, pairs).withColumn("config_fingerprint", F.lit(fingerprint)).write.mode("overwrite").json(f"{folder}/run")


def run_counts(images: DataFrame, clusters: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: sequences, images, pairs, accepted pairs, clusters and clusters of two or more."""
    a = images.agg(F.countDistinct("sequence_id").alias("sequences"), F.count("*").alias("images"))
    b = pairs.agg(F.count("*").alias("pairs"), F.count_if("same_document").alias("accepted_pairs"))
    d = clusters.agg(F.count("*").alias("clusters"), F.count_if(F.size("image_ids") > 1).alias("multi_image_clusters"))
    return a.crossJoin(b).crossJoin(d)


def read_tables(spark, folder: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in ("images", "clusters", "pairs")}


def write_json_lines(df: DataFrame, path: str, digits: int = 6) -> None:
    """JSON lines with columns in order of name; top-level doubles are rounded half to even."""
    kinds = dict(df.dtypes)
    out = [F.bround(c, digits).alias(c) if kinds[c] == "double" else F.col(f"`{c}`") for c in sorted(df.columns)]
    df.select(*out).write.mode("overwrite").json(path)


def write_new(df: DataFrame, path: str) -> None:
    """CSV that keeps what is there: a second write is an error."""
    df.write.mode("errorifexists").option("header", True).csv(path)


def write_union(frames: list[DataFrame], path: str) -> None:
    """CSV of the union of rows and columns."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    out.write.mode("overwrite").option("header", True).csv(path)
