"""All pairs of fingerprints within a Hamming distance, without loss.

Items are dealt to blocks, and every two blocks meet in a task (or several, if blocks are
few). In a task the bits are dealt to disjoint grids of ``DIMS`` bits. If the radii of the
grids, each with one added, sum up to the distance plus one, then a pair within the distance
lies within the radius in some grid (pigeonhole principle). So each cell is compared with
the cells within the radius only: about an eighth of all pairs at distance 44 of 256 if bits
are independent. Comparison is by matrix products of signs over the first 128 bits, whose
distance never exceeds the whole one; the few pairs left are measured over all bits. Small
blocks are compared without grids.

Nothing is capped: a full cell takes more steps, not fewer pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .links import HELD, _forest

#: Bits of a grid, items of a block at most, tasks at least if there are many pairs.
DIMS, BLOCK, TASKS = 11, 131_072, 24
#: From so many pairs on grids pay, and a task has so many pairs at least.
GRIDS_FROM, PAIRS = 2**30, 2**27
#: Rows and columns of a matrix product.
STEP, WIDE = 1024, 4096
#: Bits that the matrix product compares.
FIRST = 128

Found = Iterator[tuple[np.ndarray, np.ndarray]]


def radii(distance: int, grids: int) -> list[int]:
    """A radius for each grid, -1 for grids that need no search; with one added to each they sum up to ``distance`` + 1."""
    each, more = divmod(distance + 1, grids)
    return [each - 1 + (g < more) for g in range(grids)]


def _bits(words: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(words.astype(">i8")).view(np.uint8).reshape(len(words), -1), axis=1)


def _signs(bits: np.ndarray) -> np.ndarray:
    return bits[:, :FIRST].astype(np.int8) * np.int8(2) - np.int8(1)


def _close(left: np.ndarray, right: np.ndarray, distance: int) -> Found:
    """Places of rows of signs that differ in at most ``distance``, in steps of bounded size."""
    least = left.shape[1] - 2 * distance
    for j in range(0, len(right), WIDE):
        columns = right[j : j + WIDE].astype(np.float32).T
        for i in range(0, len(left), STEP):
            hit = np.flatnonzero((left[i : i + STEP].astype(np.float32) @ columns).ravel() >= least)
            if len(hit):
                row, column = np.divmod(hit, columns.shape[1])
                yield row + i, column + j


def _by_rows(left: np.ndarray, right: np.ndarray, same: bool, distance: int, part: int, parts: int) -> Found:
    l, r = _signs(_bits(left)), _signs(_bits(right))
    for at in range(part * STEP, len(l), parts * STEP):
        first = at if same else 0
        for i, j in _close(l[at : at + STEP], r[first:], distance):
            yield i + at, j + first


def _by_grids(left: np.ndarray, right: np.ndarray, same: bool, distance: int, part: int, parts: int) -> Found:
    sides = [_bits(left), _bits(right)]
    signs = [_signs(b) for b in sides]
    dims = min(DIMS, sides[0].shape[1])
    grids = sides[0].shape[1] // dims
    scale, numbers = 1 << np.arange(dims), np.arange(1 << dims)
    for g, radius in list(enumerate(radii(distance, grids)))[part::parts]:
        if radius < 0:
            continue
        steps = numbers[np.bitwise_count(numbers) <= radius]
        keys = [b[:, g * dims : (g + 1) * dims] @ scale for b in sides]
        order = [np.argsort(k, kind="stable") for k in keys]
        begin = [np.searchsorted(k[o], np.arange((1 << dims) + 1)) for k, o in zip(keys, order)]
        l, r = (s[o] for s, o in zip(signs, order))
        for cell in np.flatnonzero(np.diff(begin[0])):
            others = cell ^ steps
            if same:
                others = others[others >= cell]
            take = np.concatenate([np.arange(a, b) for a, b in zip(begin[1][others], begin[1][others + 1])])
            if len(take):
                for i, j in _close(l[begin[0][cell] : begin[0][cell + 1]], r[take], distance):
                    yield order[0][i + begin[0][cell]], order[1][take[j]]


def pairs(left: np.ndarray, right: np.ndarray, same: bool, distance: int, part: int = 0, parts: int = 1) -> Found:
    """Places of the rows of (n, words) fingerprints that differ in at most ``distance`` bits, some more than once; ``same``: both sides are one.

    ``parts`` calls find everything together.
    """
    search = _by_grids if len(left) * len(right) >= GRIDS_FROM else _by_rows
    for i, j in search(left, right, same, distance, part, parts):
        keep = np.bitwise_count((left[i] ^ right[j]).view(np.uint64)).sum(1, dtype=np.int64) <= distance
        if same:
            keep &= i != j
        if keep.any():
            yield i[keep], j[keep]


def within(items: DataFrame, words: list[str], distance: int) -> DataFrame:
    """Edges (a, b) that join all classes (``root``) of items (id, root, words) of which any two members lie within the distance."""
    n = items.count()
    blocks = max(1, ceil(n / BLOCK))
    parts = max(1, min(ceil(TASKS / (blocks * (blocks + 1) // 2)), ceil(n * n / PAIRS)))
    rows = items.select("id", "root", *words, F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
    others = F.sequence(F.lit(0), F.lit(blocks - 1))
    rows = rows.withColumn("other", F.explode(others)).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    rows = rows.select(F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "part", "block", "id", "root", *words)

    def run(table: pa.Table) -> pa.Table:
        low, high, part = (table.column(c)[0].as_py() for c in ("low", "high", "part"))
        block = table.column("block").to_numpy()
        ids, root = table.column("id").to_numpy(), table.column("root").to_numpy()
        prints = np.stack([table.column(w).to_numpy() for w in words], axis=1)
        left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
        a = b = np.zeros(0, np.int64)
        new, held = [], 0
        for i, j in pairs(prints[left], prints[right], low == high, distance, part, parts):
            i, j = left[i], right[j]
            unlike = root[i] != root[j]
            new.append((ids[i[unlike]], ids[j[unlike]]))
            held += int(unlike.sum())
            if held >= HELD:
                a, b = _forest(a, b, new)
                new, held = [], 0
        a, b = _forest(a, b, new) if new else (a, b)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("low", "high", "part").applyInArrow(run, "a long, b long")
