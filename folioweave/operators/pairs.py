"""Candidate pairs inside ordered sequences.

With ``max_gap`` k every item meets its next k neighbours, so a sequence of n
items gives at most k*n pairs. The positional form numbers all items in the order
of sequence and place (see ``ranks.counted_before``) and takes leads inside blocks
of that numbering, each with the k items that follow it; so a sequence that holds
most of the table is spread over as many tasks as any others. The form by index
gaps is an equi-join on the sequence with buckets of k+1 indexes, so that a long
sequence never meets itself as a whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import counted_before

#: Rows of a block of the numbering, which one task sorts.
BLOCK = 50_000


def _placed(items: DataFrame, sequence: str, order: Sequence[str], payload: Column) -> DataFrame:
    """(s, row, n): the payload of every item, numbered from 1 in the order of sequence and place."""
    by = [f"o{i}" for i in range(len(order))]
    return counted_before(items.select(F.col(sequence).alias("s"), *(F.col(o).alias(k) for o, k in zip(order, by)), payload.alias("row")), ["s", *by], "n").select("s", "row", "n")


def sequence_index(items: DataFrame, sequence: str, order: Sequence[str], name: str = "sequence_index") -> DataFrame:
    """Positions from 0 in each sequence."""
    placed = _placed(items, sequence, order, F.struct(*(F.col(f"`{x}`") for x in items.columns)))
    first = placed.groupBy(F.col("s").alias("of")).agg(F.min("n").alias("first"))
    return placed.join(first, F.col("s").eqNullSafe(F.col("of"))).select("row.*", (F.col("n") - F.col("first")).cast("int").alias(name))


def neighbour_pairs(items: DataFrame, sequence: str, order: Sequence[str], columns: Sequence[str], max_gap: int = 3) -> DataFrame:
    """(sequence, a, b, gap): a and b are structs of ``columns``; b comes gap places after a."""
    own, before = F.floor((F.col("n") - 1) / BLOCK), F.floor((F.col("n") - 1 - max_gap) / BLOCK)
    blocks = F.filter(F.array_distinct(F.array(own, before)), lambda b: b >= 0)
    placed = _placed(items, sequence, order, F.struct(*columns)).withColumn("own", own).select("s", "row", "n", "own", F.explode(blocks).alias("block"))
    window = Window.partitionBy("block").orderBy("n")
    at = F.struct("s", "row")
    near = placed.select("s", "own", "block", F.col("row").alias("a"), F.array(*(F.lead(at, k).over(window) for k in range(1, max_gap + 1))).alias("near")).where("own = block")
    pairs = near.select(F.col("s").alias(sequence), "a", F.posexplode("near").alias("at", "x")).where(F.col("x").isNotNull() & F.col("x.s").eqNullSafe(F.col(sequence)))
    return pairs.select(sequence, "a", F.col("x.row").alias("b"), (F.col("at") + 1).alias("gap"))


def index_pairs(items: DataFrame, sequence: str, index: str, key: str, max_gap: int = 3) -> DataFrame:
    """(sequence, a, b, gap) of keys whose indexes differ by at most max_gap; of equal indexes the lower key is a."""
    width = max_gap + 1
    base = items.select(F.col(sequence).alias("s"), F.col(index).cast("long").alias("i"), F.col(key).alias("k")).withColumn("w", F.floor(F.col("i") / width))
    ahead = base.select("s", F.col("i").alias("j"), F.col("k").alias("l"), F.explode(F.array("w", F.col("w") - 1)).alias("w"))
    later = (F.col("j") > F.col("i")) | ((F.col("j") == F.col("i")) & (F.col("l") > F.col("k")))
    return (
        base.join(ahead, ["s", "w"])
        .where(later & (F.col("j") - F.col("i") <= max_gap))
        .select(F.col("s").alias(sequence), F.col("k").alias("a"), F.col("l").alias("b"), (F.col("j") - F.col("i")).alias("gap"))
    )


def unordered(a: Column, b: Column) -> tuple[Column, Column]:
    """The key of a pair, whichever way round it is given."""
    return F.least(a, b), F.greatest(a, b)


def all_pairs(members: DataFrame, group: str, order: str, key: str) -> DataFrame:
    """(group, a, b): every pair of a group, in the members' order."""
    left = members.select(group, F.col(order).alias("i"), F.col(key).alias("a"))
    right = members.select(group, F.col(order).alias("j"), F.col(key).alias("b"))
    return left.join(right, group).where("i < j").select(group, "a", "b")


def symmetric_neighbours(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, neighbours): the sorted distinct neighbours over both directions."""
    both = edges.select(F.explode(F.array(F.struct(F.col(a).alias("node"), F.col(b).alias("other")), F.struct(F.col(b).alias("node"), F.col(a).alias("other")))).alias("e"))
    return both.groupBy(F.col("e.node").alias("node")).agg(F.sort_array(F.collect_set("e.other")).alias("neighbours"))


def common_neighbours(pairs: DataFrame, neighbours: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The pairs with ``common``, the sorted neighbours that both ends have."""
    left = neighbours.toDF(a, "_na")
    right = neighbours.toDF(b, "_nb")
    none = F.array().cast("array<string>")
    return (
        pairs.join(left, a, "left").join(right, b, "left")
        .withColumn("common", F.sort_array(F.array_intersect(F.coalesce(F.col("_na").cast("array<string>"), none), F.coalesce(F.col("_nb").cast("array<string>"), none))))
        .drop("_na", "_nb")
    )


def islands(rows: DataFrame, group: str, position: str, flag: str, max_gap: int = 1) -> DataFrame:
    """(group, first, last, n): runs of flagged positions, gaps of at most max_gap unflagged ones filled."""
    window = Window.partitionBy(group).orderBy(position)
    on = rows.where(flag).select(group, position)
    starts = on.withColumn("new", (F.col(position) - F.lag(position).over(window) > max_gap + 1).cast("int"))
    numbered = starts.withColumn("run", F.sum(F.coalesce("new", F.lit(0))).over(window))
    return numbered.groupBy(group, "run").agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count("*").alias("n")).drop("run")
