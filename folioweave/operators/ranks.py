"""Ranks and running sums over a whole table without bringing it into one task.

Rows are put into buckets of their score. Buckets are ordered, so what lies in
the buckets above is summed over at most ``BUCKETS`` + 1 rows, whatever the
table's size; only rows of one bucket are sorted together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..materialize import materialize

BUCKETS = 4096


def _bucket(score: Column) -> Column:
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)) * BUCKETS).cast("int")


def running_sums(rows: DataFrame, score: str, sums: Sequence[str]) -> DataFrame:
    """The rows, of distinct scores in [0, 1], with upto_* over all rows of the same or a higher score and total_*."""
    marked = rows.withColumn("_b", _bucket(F.col(score)))
    above = Window.orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    totals = marked.groupBy("_b").agg(*(F.sum(s).alias(f"_{s}") for s in sums))
    everything = Window.partitionBy(F.lit(1))
    offsets = totals.select("_b", *(F.coalesce(F.sum(f"_{s}").over(above), F.lit(0)).alias(f"_above_{s}") for s in sums), *(F.sum(f"_{s}").over(everything).alias(f"total_{s}") for s in sums))
    own = Window.partitionBy("_b").orderBy(F.col(score).desc())
    summed = marked.withColumns({f"_own_{s}": F.sum(s).over(own) for s in sums}).join(offsets, "_b")
    return summed.withColumns({f"upto_{s}": F.col(f"_own_{s}") + F.col(f"_above_{s}") for s in sums}).drop("_b", *(f"_own_{s}" for s in sums), *(f"_above_{s}" for s in sums))


def ranked(rows: DataFrame, score: str, ties: Sequence[Column], name: str = "rank") -> DataFrame:
    """The rows numbered from 1 by falling score, then by ``ties``."""
    marked = rows.withColumn("_b", _bucket(F.col(score)))
    above = Window.orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = marked.groupBy("_b").agg(F.count("*").alias("_n")).select("_b", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_above"))
    turn = F.row_number().over(Window.partitionBy("_b").orderBy(F.col(score).desc(), *ties))
    return marked.withColumn("_turn", turn).join(offsets, "_b").withColumn(name, F.col("_turn") + F.col("_above")).drop("_b", "_turn", "_above")


def counted_before(rows: DataFrame, order: Sequence[str], name: str = "rank") -> DataFrame:
    """The rows numbered from 1 in the order of columns: ranges of the order are sorted apart, and offset by the rows of the ranges before.

    The ranges are written once, as they are asked twice and drawn from a sample.
    """
    placed = materialize(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_above"))
    turn = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return placed.withColumn("_turn", turn).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_turn") + F.col("_above")).drop("_part", "_turn", "_above")
