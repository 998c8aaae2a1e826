"""A corpus pipeline: five training-data operators, each over all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again before the next stage, whereupon the table before it is
deleted. All stages but the last keep the columns of ``documents``. Nulls, very
long texts, ties, repeated rows, empty tables and extra columns have the results
that the operators' docstrings state.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioweave.llm import language_id, line_dedup, mixing, packing, simhash_dedup
from folioweave.llm.common import fresh


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the others go."""
    return language_id.known_language(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without runs of lines that stood earlier in the corpus; those of which nothing is left go."""
    left = line_dedup.dedup_lines(docs.withColumn(was := fresh(docs, "was_empty")[0], F.coalesce(F.col("text") == "", F.lit(True))))
    return left.where(F.col(was) | (F.col("text") != "")).drop(was)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash_dedup.dedup_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the target weights of the sources, as many times as they have copies."""
    return mixing.sampled(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document in its window."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("simhash_dedup", drop_near_copies),
    ("source_mixing", mix_sources),
    ("packing", pack_windows),
]

#: Training a network and near-copy groups have no SQL; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def _folder(spark: SparkSession) -> str:
    """A new folder in the cluster's shared one; only where none is named, as in tests, a local one."""
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir")
    if not shared and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{shared or tempfile.gettempdir()}/corpus-pipeline-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; the last stage's rows."""
    folder = _folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{i}-{name}")
            docs = spark.read.parquet(f"{folder}/{i}-{name}")
            if i:
                _delete(spark, f"{folder}/{i - 1}-{STAGES[i - 1][0]}")
    return docs
