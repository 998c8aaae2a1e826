"""Connected components of an edge table by alternating large and small stars.

Edges that fit a task are joined up there at once; that many edges are few
megabytes, and both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


#: Edges that one task joins up.
ONE_TASK = 1_000_000


def lowest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the edges, and the lowest id of the component of each."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while True:
        p, q = root[x], root[y]
        low, new = np.minimum(p, q), root.copy()
        np.minimum.at(new, p, low)
        np.minimum.at(new, q, low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            return ids, ids[root]
        root = new


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if held:
            ids, root = lowest(np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held]))
            keep = ids != root
            yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(root[keep])], ["node", "root"])

    return edges.repartition(1).mapInArrow(run, "node long, root long")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select("b", "a")).toDF("a", "b")
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    return (
        down.join(low, "a")
        .select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        .select(F.col("e.b").alias("a"), F.col("e.m").alias("b"))
        .where("a != b")
        .distinct()
    )


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(node, root) for every node of ``edges`` (two integer columns) that is not the lowest of its component.

    Nulls and loops are ignored and repeated edges count once. The number of
    rounds grows with the logarithm of the longest path; each is materialised in
    the checkpoint folder.
    """
    now = cut(edges.toDF("a", "b").select(F.col("a").cast("long"), F.col("b").cast("long")).where("a != b").distinct())
    if now.limit(one_task + 1).count() <= one_task:
        return cut(_in_one_task(now))
    state = None
    while True:
        now = cut(_small_star(_large_star(now)))
        new = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if new == state:
            return now.toDF("node", "root")
        state = new
