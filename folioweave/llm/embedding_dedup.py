"""Embedding near-dedup by randomised-rotation binary codes.

A unit vector, padded with zeros to a multiple of ``BITS`` dimensions, is rotated
at random and reduced to the signs of its coordinates. With the code goes a
correction factor, the inner product <code, vector>; <code, other> / <code,
vector> is then an unbiased estimate of <vector, other>, whose error a bound holds
with high probability. The other vector enters as ``PLANES`` bit planes of its
rotated coordinates, rounded with a dither that is the same for all vectors, so
that an estimate is a few popcounts. A pair whose upper bound lies below the
threshold is decided by its codes; every other pair is recomputed from the
vectors.

Vectors meet where their codes agree in all bits of a band. Sign bits of a random
rotation agree with probability 1 - angle/pi; there are so many bands that a pair
at the threshold meets with probability ``RECALL``. The width of a band follows
the binary logarithm of the number of vectors, so that a band holds as many
unlike vectors at any size. Equal vectors are one item.

The result is a row for every vector: its class (the lowest vec_id that it is
linked to directly or over others), how many other vectors the class has that
differ, and the cosine to the class's first vector. How classes are found without
all pairs of a class: see ``links``.

Plan: one Arrow pass makes codes, written once; ``links`` shuffles (band, id,
code). Of the pairs that meet, those whose codes differ in no more bits than those
of pairs at the threshold do, give or take four standard deviations
(``most_apart``: 1 such pair in 30,000 is lost to it), meet factors and planes by
two joins on ids, and their estimate runs in generated code; only the pairs that
need it meet their vectors, by two more.

Defined results: a null, empty or zero vector, or one with a null or non-finite
entry, has a null class; vectors of different lengths are never linked; rows come
out as often as they went in, and rows of one vec_id may have classes of their
own if their vectors differ; a null vec_id has a null class; ties have the lowest
vec_id; extra columns are ignored; an empty table gives an empty table. vec_id is
an integer.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache
from math import acos, ceil, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .links import classes, linked

BITS = 256
PLANES = 4
MIN_COSINE = 0.9
#: How likely a pair at the threshold is to meet, were the bits of its bands independent; as bands share bits it is a little less.
RECALL = 0.985
#: Width of the bound in standard deviations of the estimate.
EPSILON = 3.0


@cache
def rotation(dims: int, bits: int) -> np.ndarray:
    """(dims, bits): the rows of a random rotation that the padded vectors use."""
    rng = np.random.default_rng(dims)
    q, r = np.linalg.qr(rng.normal(size=(bits, bits)))
    return (q * np.sign(np.diag(r)))[:dims]


def code_length(dims: int) -> int:
    """A whole multiple of ``BITS``, no shorter than the vectors."""
    return BITS * max(1, -(-dims // BITS))


def _code(bits: int) -> list[str]:
    return [f"c{i}" for i in range(bits // 64)]


def _planes(bits: int) -> list[str]:
    return [f"p{j}_{i}" for j in range(PLANES) for i in range(bits // 64)]


@cache
def dither(bits: int) -> np.ndarray:
    return np.random.default_rng(bits + 1).random(bits)


def bands_of(vectors: int, bits: int = BITS, min_cosine: float = MIN_COSINE) -> np.ndarray:
    """(bands, width) numbers of bits, dealt so that all are used as often."""
    width = max(12, ceil(log2(max(vectors, 1))) - 3)
    meet = (1 - acos(min_cosine) / pi) ** width
    n = ceil(log(1 - RECALL) / log(1 - meet)) if meet < 1 else 1
    each, rng = bits // width, np.random.default_rng(19)
    deals = [rng.permutation(bits)[: each * width].reshape(each, width) for _ in range(-(-n // each))]
    return np.concatenate(deals)[:n]


def most_apart(min_cosine: float, bits: int = BITS) -> int:
    """How many bits the codes of a pair at the threshold differ in at most, but for one in 30,000."""
    p = acos(min_cosine) / pi
    return int(bits * p + 4 * sqrt(bits * p * (1 - p)))


def encode(x: np.ndarray, bits: int = BITS) -> dict[str, np.ndarray]:
    """Codes, correction factors and bit planes of (n, dims) unit vectors."""
    turned = x @ rotation(x.shape[1], bits)
    signs = turned > 0
    factor = np.abs(turned).sum(1) / np.sqrt(bits)
    top = (1 << PLANES) - 1
    low = turned.min(1, keepdims=True)
    step = np.maximum((turned.max(1, keepdims=True) - low) / top, 1e-12)
    level = np.minimum(np.floor((turned - low) / step + dither(bits)), top).astype(np.uint8)
    out = {"factor": factor, "low": low[:, 0], "step": step[:, 0], "total": level.sum(1, dtype=np.int64)}

    def words(found: np.ndarray) -> np.ndarray:
        return np.packbits(found, axis=1).view(">i8").astype(np.int64)

    for i, w in enumerate(words(signs).T):
        out[f"c{i}"] = w
    for j in range(PLANES):
        for i, w in enumerate(words(level >> j & 1).T):
            out[f"p{j}_{i}"] = w
    return out


def estimate(code: str, other: str, bits: int = BITS) -> Column:
    """The unbiased estimate of the inner product of the row ``code`` with the row ``other``."""
    c = lambda name: F.col(f"{code}.{name}")
    o = lambda name: F.col(f"{other}.{name}")
    both = F.lit(0)
    for j in range(PLANES):
        plane = F.lit(0)
        for i in range(bits // 64):
            plane = plane + F.bit_count(c(f"c{i}").bitwiseAND(o(f"p{j}_{i}")))
        both = both + plane * F.lit(1 << j)
    ones = F.lit(0)
    for w in _code(bits):
        ones = ones + F.bit_count(c(w))
    # <code, other> * sqrt(bits) = sum of (2 bit - 1) * (low + step * level)
    dot = o("step") * (both * 2 - o("total")) + o("low") * (ones * 2 - F.lit(bits))
    return dot / F.lit(float(np.sqrt(bits))) / c("factor")


def margin(code: str, bits: int = BITS) -> Column:
    """What the estimate may miss, with high probability."""
    x = F.col(f"{code}.factor")
    return F.lit(EPSILON) * F.sqrt(F.greatest(F.lit(0.0), 1 - x * x)) / x / F.lit(float(np.sqrt(bits - 1)))


def unit_vectors(table: DataFrame) -> DataFrame:
    """(vec_id, key, dims, unit) of every row: the vector scaled to length one, null where it can have no partner; equal directions share a key."""
    v = F.col("embedding").cast("array<double>")
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ~F.coalesce(bad, F.lit(True)) & (length > 0)
    unit = F.when(usable, F.transform(v, lambda x: x / length))
    key = F.sha2(F.array_join(F.transform("unit", lambda x: x.cast("float").cast("string")), ","), 256)
    return table.select(F.col("vec_id").cast("long").alias("vec_id"), unit.alias("unit")).select("vec_id", key.alias("key"), F.size("unit").alias("dims"), "unit")


def _longs(bits: int) -> list[str]:
    return [*_code(bits), *_planes(bits), "total"]


def coded(distinct: DataFrame, bits: int = BITS) -> DataFrame:
    """Codes of (id, dims, unit)."""
    longs = _longs(bits)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy(zero_copy_only=False)
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                x = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                found = encode(x, bits)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *(pa.array(found[k]) for k in longs), *(pa.array(found[k]) for k in ("factor", "low", "step"))],
                    ["id", "dims", *longs, "factor", "low", "step"],
                )

    kinds = ", ".join(f"{k} long" for k in longs)
    return distinct.select("id", "dims", "unit").mapInArrow(run, f"id long, dims int, {kinds}, factor double, low double, step double")


def _banded(codes: DataFrame, bands: np.ndarray, bits: int) -> DataFrame:
    """``codes`` with the array of their bands' numbers."""
    names = _code(bits)
    weights = np.int64(1) << np.arange(min(bands.shape[1], 62), dtype=np.int64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names], axis=1)
            signs = np.unpackbits(np.ascontiguousarray(words.astype(">i8")).view(np.uint8).reshape(len(words), -1), axis=1)
            found = signs[:, bands].astype(np.int64) @ weights
            found = (found.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.arange(len(bands), dtype=np.uint64)).view(np.int64)
            offsets = pa.array(np.arange(0, found.size + 1, len(bands), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(found.ravel()))], [*batch.schema.names, "cells"])

    return codes.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in codes.dtypes) + ", cells array<long>")


def near_duplicates(table: DataFrame, min_cosine: float = MIN_COSINE) -> DataFrame:
    """(vec_id, class_id, n_links, cosine) of every row."""
    rows = cut(unit_vectors(table))
    same = rows.where("unit is not null").groupBy("key").agg(F.min("vec_id").alias("first_id"), F.first("dims").alias("dims"), F.first("unit").alias("unit"))
    distinct = cut(same.withColumn("id", F.monotonically_increasing_id()))
    found = distinct.agg(F.max("dims").alias("dims"), F.count("*").alias("n")).first()
    bits, bands = code_length(found["dims"] or 1), bands_of(found["n"], min_cosine=min_cosine)
    cosine = F.aggregate(F.zip_with("x", "y", lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    codes, limit = cut(coded(distinct, bits)), most_apart(min_cosine, bits)

    def near(left: str, right: str) -> Column:
        apart = F.lit(0)
        for w in _code(bits):
            apart = apart + F.bit_count(F.col(f"{left}.{w}").bitwiseXOR(F.col(f"{right}.{w}")))
        return (F.col(f"{left}.dims") == F.col(f"{right}.dims")) & (apart <= limit)

    def exact(pairs: DataFrame) -> DataFrame:
        return (
            pairs.distinct()
            .join(codes.select(F.col("id").alias("a"), F.struct(*_code(bits), "factor").alias("l")), "a")
            .join(codes.select(F.col("id").alias("b"), F.struct(*_planes(bits), "total", "low", "step").alias("r")), "b")
            .where(estimate("l", "r", bits) + margin("l", bits) >= min_cosine)
            .select("a", "b")
            .join(distinct.select(F.col("id").alias("a"), F.col("unit").alias("x")), "a")
            .join(distinct.select(F.col("id").alias("b"), F.col("unit").alias("y")), "b")
            .where(cosine >= min_cosine)
            .select("a", "b")
        )

    wide = np.arange(BITS).reshape(8, -1)
    roots = linked(codes, ["dims", *_code(bits)], near, lambda x: _banded(x, wide, bits), lambda x: _banded(x, bands, bits), exact)
    known = cut(classes(distinct.select("id", "first_id", "key", "unit"), roots))
    lead = known.groupBy("class_id").agg(F.min(F.struct("first_id", "key", "unit")).alias("lead"))
    of = known.join(lead, "class_id").select(
        F.col("key").alias("of_key"), F.col("lead.first_id").alias("class_id"), "n_links", F.col("unit").alias("x"), F.col("lead.unit").alias("y"), (F.col("key") == F.col("lead.key")).alias("own")
    ).select("of_key", "class_id", "n_links", F.when(F.col("own"), F.lit(1.0)).otherwise(F.least(F.lit(1.0), cosine)).alias("cosine"))
    return rows.join(of, F.col("key") == F.col("of_key"), "left").select("vec_id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "cosine")
