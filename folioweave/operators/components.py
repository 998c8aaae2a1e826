"""Connected components of any table of edges, spread over tasks.

Large and small stars alternate until nothing changes, in a number of rounds that
grows with the logarithm of the longest path. Edges that fit one task are joined
up there at once; both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..materialize import materialize

c = F.col
#: Edges that one task joins up; a few megabytes.
ONE_TASK = 1_000_000


def lowest_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ends of edges, and for each the lowest end that it is connected to."""
    ends, place = np.unique(np.stack([a, b]), return_inverse=True)
    left, right = place.reshape(2, -1)
    label, before = np.arange(len(ends)), None
    while before is None or (label != before).any():
        before = label.copy()
        for side, other in ((left, right), (right, left)):
            np.minimum.at(label, label[side], label[other])
        while (label[label] != label).any():
            label = label[label]
    return ends, ends[label]


def _joined_up(edges: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if parts:
            ends, label = lowest_labels(*(np.concatenate([b.column(i).to_numpy() for b in parts]) for i in range(2)))
            moved = ends != label
            yield pa.RecordBatch.from_arrays([pa.array(ends[moved]), pa.array(label[moved])], ["node", "root"])

    return edges.repartition(1).mapInArrow(run, "node long, root long")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours hang on the lowest of them and itself: the higher ones (large star), or the lower ones and the node (small)."""
    if large:
        both = edges.union(edges.select(c("v").alias("u"), c("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    near = both.join(least, "u")
    hung = near.where("v > u").select(c("v").alias("u"), c("m").alias("v")) if large else near.select(c("v").alias("u"), c("m").alias("v")).union(least.toDF("u", "v"))
    return hung.where("u != v").distinct()


def numbered_components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(node, root) of edges (two columns of whole numbers) for each node that is not the lowest of its component."""
    now = materialize(edges.toDF("u", "v").select(c("u").cast("long"), c("v").cast("long")).where("u != v").distinct())
    if now.limit(one_task + 1).count() <= one_task:
        return materialize(_joined_up(now))
    seen = None
    while True:
        now = materialize(_star(_star(now, True), False))
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            return now.toDF("node", "root")
        seen = mark


def components(items: DataFrame, edges: DataFrame, keys: list[str], order: str, one_task: int = ONE_TASK) -> DataFrame:
    """(*keys, root): for each item the key of the item of its component that is first by ``order``.

    The last of ``keys`` names an item within the others; ``edges`` has the others and the ends a, b. Edges with an end
    that is no item are ignored.
    """
    *outer, inner = keys
    nodes = materialize(items.select(*keys, c(order).alias("_o")).withColumn("_n", F.monotonically_increasing_id()))
    end = lambda name: nodes.select(*outer, c(inner).alias(name), c("_n").alias(f"_{name}"))
    ids = edges.join(end("a"), [*outer, "a"]).join(end("b"), [*outer, "b"]).select("_a", "_b")
    found = nodes.join(numbered_components(ids, one_task).select(c("node").alias("_n"), c("root").alias("_r")), "_n", "left").withColumn("_r", F.coalesce("_r", "_n"))
    first = found.groupBy("_r").agg(F.min_by(inner, F.struct("_o", inner)).alias("root"))
    return found.join(first, "_r").select(*keys, "root")
