"""SimHash near-dedup through a segment-popcount embedding.

A document's fingerprint has 256 bits: bit i is the majority of bit i in the
hashes of its distinct words (lower case, punctuation apart). Two documents are
near copies if their fingerprints differ in at most ``max_distance`` bits.

Bits are taken as segments of one; the number of set bits in each embeds the
fingerprint in a space in which the Manhattan distance never exceeds the Hamming
distance. The segments are dealt to disjoint grids, and a range join in each grid
compares every cell with the cells within a radius; the radii are such that no pair
within ``max_distance`` is lost (pigeonhole principle). See ``hamming``, which also
says how few pairs are compared. Wider segments thin the pairs less: with 64 segments
or fewer the Manhattan bound passes too many unlike pairs (at 32 every seventh).

Equal fingerprints are joined without any search. Groups are the connected
components; the lowest doc_id of each stays. How they are found without all pairs
of a group: see ``links``.

Plan: one Arrow pass makes fingerprints, written once; stars in ``links`` join the
big groups first; then blocks of whole fingerprints are shuffled, one copy for each
other block, and compared in pairs of blocks. Comparisons grow with the square of the
number of distinct fingerprints, the shuffle with that number times the blocks.

Defined results: documents without a word (null, empty, only punctuation) are
never copies; very long texts count whole; rows of equal doc_id are one document
and stay or go together; a null doc_id is left out of the search and stays; extra
columns pass through; an empty table gives an empty table. doc_id is an integer.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cache
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_runs
from .components import components
from .hamming import within
from .links import starred

BITS = 256
SEGMENT = 2
MAX_DISTANCE = 44
#: Dimensions of a grid of popcounts, and how likely a pair at the greatest distance is to meet in these. ``copies`` does not search by them.
DIMS, RECALL = 9, 0.95
WORDS = ["f0", "f1", "f2", "f3"]

_WORD = re.compile(r"\w+")


def fingerprint_bits(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(n, 256) bits and which texts have any word."""
    index: dict[str, int] = {}
    rows: list[int] = []
    starts, have = [], np.zeros(len(texts), bool)
    for i, text in enumerate(texts):
        words = set(_WORD.findall(text.lower())) if text else ()
        if words:
            have[i] = True
            starts.append(len(rows))
            rows += [index.setdefault(w, len(index)) for w in words]
    out = np.zeros((len(texts), BITS), np.uint8)
    if not rows:
        return out, have
    raw = b"".join(xxhash.xxh3_128_digest(w, seed=s) for w in (x.encode("utf-8", "surrogatepass") for x in index) for s in (1, 2))
    bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, BITS // 8), axis=1)
    order, sums = np.array(rows), []
    ends = [*starts[1:], len(rows)]
    for a, b in zip(starts, ends):
        part = order[a:b]
        sums.append(sum((bits[part[i : i + 65536]].sum(0, dtype=np.int64) for i in range(0, len(part), 65536)), np.zeros(BITS, np.int64)))
    sizes = np.array(ends) - np.array(starts)
    out[have] = 2 * np.array(sums) > sizes[:, None]
    return out, have


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, f0..f3) of every row that has a doc_id and a word."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_runs(batches, 500_000):
            bits, have = fingerprint_bits(batch.column(1).to_pylist())
            words = np.packbits(bits, axis=1).view(">i8").astype(np.int64)
            keep = pa.array(have)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(words[:, j]) for j in range(4))], ["doc_id", *WORDS]).filter(keep)

    return docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{w} long" for w in WORDS))


def meeting(dims: int, distance: int) -> float:
    """The probability that a pair at a Hamming distance meets in one grid."""
    q = distance / BITS
    same, step = (1 - q) ** 2 + q * q / 2, 2 * q * (1 - q)
    return same**dims + dims * step * same ** (dims - 1) + comb(dims, 2) / 2 * step**2 * same ** (dims - 2)


@cache
def _segments(dims: int, max_distance: int) -> np.ndarray:
    """(grids, dims) numbers of segments, at random but always the same; the grids of one deal are disjoint."""
    each, grids = BITS // SEGMENT // dims, ceil(log(1 - RECALL) / log(1 - meeting(dims, max_distance)))
    rng = np.random.default_rng(7)
    return np.concatenate([rng.permutation(BITS // SEGMENT)[: each * dims].reshape(each, dims) for _ in range(-(-grids // each))])[:grids]


def popcounts(words: np.ndarray) -> np.ndarray:
    """(n, 128) bits set in each segment, of (n, 4) fingerprint words."""
    bits = np.unpackbits(np.ascontiguousarray(words.astype(">i8")).view(np.uint8).reshape(len(words), BITS // 8), axis=1)
    return bits.reshape(len(words), -1, SEGMENT).sum(2, dtype=np.int64)


def cells(counts: np.ndarray, dims: int, max_distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Cell numbers of (n, 128) popcounts, row after row, and how many each row has; cells of different grids differ."""
    picks = _segments(dims, max_distance)
    scale = (SEGMENT + 1) ** np.arange(dims, dtype=np.int64)
    at = counts[:, picks]
    own = at @ scale + np.arange(len(picks)) * (SEGMENT + 1) ** dims
    found = np.concatenate([own[:, :, None], own[:, :, None] - scale], axis=2).reshape(len(counts), -1)
    valid = np.concatenate([np.ones((*own.shape, 1), bool), at > 0], axis=2).reshape(len(counts), -1)
    return found[valid], valid.sum(1)


def _distance(left: str, right: str, words: list[str] = WORDS) -> tuple[Column, Column]:
    """The Manhattan distance of the words' popcounts, and their Hamming distance."""
    pairs = [(F.col(f"{left}.{w}"), F.col(f"{right}.{w}")) for w in words]
    bound, exact = F.lit(0), F.lit(0)
    for a, b in pairs:
        bound = bound + F.abs(F.bit_count(a) - F.bit_count(b))
        exact = exact + F.bit_count(a.bitwiseXOR(b))
    return bound, exact


def _halves(prints: DataFrame) -> DataFrame:
    """``prints`` with the eight 32-bit halves of their words as cells."""
    parts = [x for w in WORDS for x in (F.shiftright(F.col(w), 32), F.col(w).bitwiseAND(F.lit(2**32 - 1)))]
    return prints.withColumn("cells", F.array(*(F.xxhash64(F.lit(i), x) for i, x in enumerate(parts))))


def groups(prints: DataFrame, max_distance: int = MAX_DISTANCE, extra: DataFrame | None = None) -> DataFrame:
    """(node, root) of fingerprints (a long ``id`` and f0..f3) linked within the distance, or by ``extra`` pairs of ids."""

    def near(left: str, right: str) -> Column:
        bound, least = _distance(left, right, WORDS[:2])
        return (bound <= max_distance) & (least <= max_distance)

    whole = prints.select("id", F.struct(*WORDS).alias("f"))

    def exact(pairs: DataFrame) -> DataFrame:
        both = pairs.distinct().join(whole.toDF("a", "l"), "a").join(whole.toDF("b", "r"), "b")
        return both.where(_distance("l", "r")[1] <= max_distance).select("a", "b")

    first, rooted = starred(prints, WORDS[:2], near, _halves, exact, extra, tuple(WORDS[2:]))
    return components(first.union(within(rooted, WORDS, max_distance)))


def copies(docs: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(doc_id, kept_doc_id) for every document that goes: the one of its group that stays has the lowest doc_id."""
    prints = cut(fingerprints(docs))
    same = cut(prints.groupBy(*WORDS).agg(F.min("doc_id").cast("long").alias("id")))
    found = cut(prints.join(same, WORDS).select(F.col("doc_id").cast("long").alias("doc_id"), "id").distinct())
    several = found.groupBy("doc_id").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low != high").select("doc_id", "low")
    one = found.join(several, "doc_id").select(F.col("id").alias("a"), F.col("low").alias("b"))
    roots = groups(same, max_distance, one)
    return (
        found.join(roots.toDF("id", "root"), "id", "left")
        .groupBy("doc_id").agg(F.min(F.coalesce("root", "id")).alias("kept_doc_id"))
        .where("doc_id != kept_doc_id")
    )


def dedup_documents(docs: DataFrame, **parameters) -> DataFrame:
    """The documents without those that ``copies`` lets go."""
    return docs.join(copies(docs, **parameters).select("doc_id"), "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
