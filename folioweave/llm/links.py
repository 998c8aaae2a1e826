"""Classes of linked items, without writing or comparing all pairs of a class.

Items share cells; two items of one cell are linked if a check holds. Classes
are the connected components of the links. Pairs inside a class need not be
known one by one, so:

1. few, wide cells: each item is checked against the lowest id of its cell only
   (a star); groups of near copies become one class here, however large;
2. all cells: only items that are in different classes so far are compared. A
   cell that holds far more rows than others is split: its commonest class is
   set against the rest only, in blocks;
3. every task turns the links that it found into a spanning forest before it
   hands them on.

No link between two classes is lost by any of this: each pair that shares a cell
either is compared or is in one class already.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_small, cut
from .components import components, lowest

#: Links, or cells, that a task holds before it reduces them.
HELD = 1_000_000
#: A cell is counted by a task from so many rows out of ``HELD`` on, and is split in blocks of about so many rows.
COUNTED, BLOCK = 16, 2_000

Near = Callable[[str, str], Column]


def forest(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with the same components, in each task no more than it has ids."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, new, n = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
        for batch in batches:
            new.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            n += batch.num_rows
            if n >= HELD:
                a, b = _forest(a, b, new)
                new, n = [], 0
        if new:
            a, b = _forest(a, b, new)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null").mapInArrow(run, "a long, b long")


def _forest(a: np.ndarray, b: np.ndarray, new: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    ids, root = lowest(np.concatenate([a, *(x for x, _ in new)]), np.concatenate([b, *(y for _, y in new)]))
    keep = ids != root
    return ids[keep], root[keep]


def _hot(placed: DataFrame, most: int = 1) -> DataFrame:
    """(cell, blocks) of the cells with more than ``most`` blocks of rows, as far as single tasks can tell; it decides the plan, not the result."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def counted() -> pa.RecordBatch:
            cells, times = np.unique(np.concatenate(held), return_counts=True)
            keep = times >= COUNTED
            return pa.RecordBatch.from_arrays([pa.array(cells[keep]), pa.array(times[keep])], ["cell", "n"])

        for batch in batches:
            held.append(batch.column(0).to_numpy())
            n += batch.num_rows
            if n >= HELD:
                yield counted()
                held, n = [], 0
        if held:
            yield counted()

    found = placed.select("cell").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    return found.where(F.col("n") > most * BLOCK).select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))


def starred(items: DataFrame, payload: list[str], near: Near, few: Callable[[DataFrame], DataFrame], check: Callable[[DataFrame], DataFrame] | None = None, extra: DataFrame | None = None, carried: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The links (a, b) of stars in wide cells, with ``extra``, and all items with the ``root`` that these give them; see ``linked``."""
    check = check or (lambda pairs: pairs)
    items = cut(items.select("id", *payload, *carried))
    wide = few(items).select(F.explode("cells").alias("cell"), "id", *payload)
    low = wide.groupBy("cell").agg(F.min("id").alias("lowest_id"), F.count("*").alias("n")).where("n > 1").select("cell", "lowest_id")
    star = wide.join(low, "cell").where("id != lowest_id").groupBy("id", "lowest_id").agg(F.first(F.struct(*payload)).alias("own"))
    star = star.join(items.select(F.col("id").alias("lowest_id"), F.struct(*payload).alias("other")), "lowest_id")
    star = star.select(F.col("lowest_id").alias("lid"), F.col("id").alias("rid"), F.col("other").alias("l"), F.col("own").alias("r")).where(near("l", "r"))
    first = forest(check(star.select(F.col("lid").alias("a"), F.col("rid").alias("b"))))
    first = cut(first if extra is None else first.union(extra))
    roots = components(first)
    rooted = items.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").select("id", F.coalesce("root", "id").alias("root"), *payload, *carried)
    return first, cut(rooted)


def linked(items: DataFrame, payload: list[str], near: Near, few: Callable[[DataFrame], DataFrame], many: Callable[[DataFrame], DataFrame], check: Callable[[DataFrame], DataFrame] | None = None, extra: DataFrame | None = None, carried: tuple[str, ...] = ()) -> DataFrame:
    """(node, root) of every item that is not the lowest id of its class.

    ``items`` has a long ``id`` and the payload; rows of one id are one item; ``few`` and ``many`` add an array of cells named ``cells`` to
    such rows and keep their columns. ``check`` takes pairs (a, b) for which ``near`` holds and returns those that are links;
    ``extra`` are pairs that are links anyway;
    ``carried`` are columns that only ``few`` and ``many`` read.
    """
    check = check or (lambda pairs: pairs)
    first, rooted = starred(items, payload, near, few, check, extra, carried)
    for found in compared(many(rooted).select(F.explode("cells").alias("cell"), "id", "root", *payload), near):
        first = first.union(forest(check(found)))
    return components(first)


def compared(rows: DataFrame, near: Near) -> list[DataFrame]:
    """The pairs (a, b) of different roots that share a cell and for which ``near`` holds; ``rows`` has cell, id, root and the payload."""
    hot = cut(_hot(rows))
    unlike = F.col("l.root") != F.col("r.root")
    cold = rows if hot.isEmpty() else rows.join(broadcast_small(hot.select("cell")), "cell", "left_anti")
    found = (
        cold.alias("l").join(cold.alias("r"), (F.col("l.cell") == F.col("r.cell")) & (F.col("l.id") < F.col("r.id")) & unlike & near("l", "r"))
        .select(F.col("l.id").alias("a"), F.col("r.id").alias("b"))
    )
    parts = [found]
    if not hot.isEmpty():
        warm = rows.join(broadcast_small(hot), "cell")
        classes = warm.groupBy("cell", "root").agg(F.count("*").alias("n"))
        major = classes.groupBy("cell").agg(F.max_by("root", F.struct("n", "root")).alias("major"))
        warm = warm.join(broadcast_small(cut(major)), "cell")
        left = warm.where("root != major").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        right = warm.withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
        once = (F.col("r.root") == F.col("r.major")) | (F.col("l.id") < F.col("r.id"))
        same = (F.col("l.cell") == F.col("r.cell")) & (F.col("l.block") == F.col("r.block"))
        parts.append(left.alias("l").join(right.alias("r"), same & once & unlike & near("l", "r")).select(F.col("l.id").alias("a"), F.col("r.id").alias("b")))
    return parts


def classes(members: DataFrame, roots: DataFrame) -> DataFrame:
    """``members`` (with a column id, null for none) with class_id, the lowest id of the class, and n_links, how many other distinct items it has."""
    sizes = roots.groupBy("root").agg(F.count("*").alias("n_links"))
    of = roots.select(F.col("node").alias("id"), F.col("root").alias("class_id")).union(sizes.select(F.col("root").alias("id"), F.col("root").alias("class_id")))
    known = of.join(sizes.select(F.col("root").alias("class_id"), "n_links"), "class_id")
    links = F.when(F.col("id").isNotNull(), F.coalesce("n_links", F.lit(0)).cast("long"))
    return members.join(known, "id", "left").withColumn("class_id", F.coalesce("class_id", "id")).withColumn("n_links", links)
