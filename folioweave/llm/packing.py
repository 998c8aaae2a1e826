"""Packing by minimum bin slack.

A document is as long as its tokens, counted with the public vocabulary of
``token_counts``, and one end mark. What exceeds the window is cut into whole
windows and a remainder, so whole texts are packed. The lengths left to place form
a multiset with at most ``capacity`` distinct values. For each window the longest
remaining length is fixed, a subset-sum table in the bits of an integer finds the
fullest sum that the remaining counts can reach, and backtracking gives the count
of every length. The same filling repeats while the counts last, so the plan has
about as many fillings as distinct lengths.

Plan: one Arrow pass reads the texts for their lengths, which are written once
and never shuffled with the texts. The driver sees the length histogram alone (at
most ``capacity`` rows, whatever the corpus). Pieces find their window by their
rank among the pieces of equal length, which is counted in salts by length and
joined as offsets, so no length, however frequent, is sorted in one task; the
number of salts follows the number of pieces. The window of a rank is looked up by
binary search in the plan, whose rows the capacity bounds.

Defined results: a text without tokens (null, empty) takes no window; very long
texts take as many windows as they fill; rows that repeat a doc_id are packed each;
a null doc_id is packed with the id null; ties (equal lengths) go in order of salt,
doc_id, piece; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, text_runs
from .token_counts import PATTERN, VOCABULARY, load_ranks

CAPACITY = 2048
#: Pieces of one length and salt are sorted in one task; there are so many on average.
SALT_ROWS, SALTS = 200_000, 64
END = -1


def encoder(ranks: dict[bytes, int]) -> tiktoken.Encoding:
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def lengths(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens) of every row; null texts have none."""
    shared = docs.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(shared.value).encode_ordinary
        for batch in text_runs(batches):
            found = [len(encode(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, tokens long")


def fullest(counts: list[tuple[int, int]], capacity: int) -> dict[int, int]:
    """The filling that holds the first (longest) length and comes closest to capacity; counts by falling length."""
    mask, (first, n) = (1 << (capacity + 1)) - 1, counts[0]
    reach, before = 1 << first, []
    for length, n in [(first, n - 1), *counts[1:]]:
        before.append(reach)
        step, left = 1, min(n, capacity // length)
        while left > 0:
            take = min(step, left)
            reach |= (reach << (take * length)) & mask
            left -= take
            step *= 2
        if reach >> capacity & 1:
            break
    total, filling = reach.bit_length() - 1, {first: 1}
    for (length, _), was in zip(reversed(counts[: len(before)]), reversed(before)):
        while not was >> total & 1:
            filling[length] = filling.get(length, 0) + 1
            total -= length
    return filling


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Fillings and how often each is used, until no length is left."""
    left, out = {k: v for k, v in histogram.items() if v > 0}, []
    order = sorted(left, reverse=True)
    while order:
        filling = fullest([(x, left[x]) for x in order], capacity)
        times = min(left[x] // n for x, n in filling.items())
        out.append((filling, times))
        for x, n in filling.items():
            left[x] -= n * times
        order = [x for x in order if left[x]]
    return out


def places(fillings: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, from_rank, to_rank, each, first_window, offset): where the ranks of a length go."""
    used: dict[int, int] = {}
    window, out = 0, []
    for filling, times in fillings:
        offset = 0
        for length in sorted(filling, reverse=True):
            n, start = filling[length], used.get(length, 0)
            out.append((length, start, start + n * times, n, window, offset))
            used[length] = start + n * times
            offset += n * length
        window += times
    return out


def window_of(found: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows of (length, rank) and the positions in them, by binary search in the sorted columns of ``places``."""
    lengths, starts, _, each, first, offset = found
    names, inverse = np.unique(length, return_inverse=True)
    at = np.empty(len(rank), np.int64)
    for k, name in enumerate(names):
        own = inverse == k
        low, high = np.searchsorted(lengths, name), np.searchsorted(lengths, name, side="right")
        at[own] = low + np.searchsorted(starts[low:high], rank[own], side="right") - 1
    nth = rank - starts[at]
    return first[at] + nth // each[at], offset[at] + nth % each[at] * length


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, piece, start, length, window_id, position): every piece of every text in its window, counted in tokens and end marks."""
    return pack_lengths(lengths(docs, vocabulary), capacity)


def pack_lengths(counted: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pack`` of (doc_id, tokens)."""
    counted = cut(counted.where("tokens > 0").select("doc_id", (F.col("tokens") + 1).alias("total")))
    pieces = (
        counted.select("doc_id", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(total - 1) div {capacity}"))).alias("piece"))
        .select("doc_id", "piece", (F.col("piece") * capacity).alias("start"), F.least(F.lit(capacity).cast("long"), F.col("total") - F.col("piece") * capacity).alias("length"))
    )
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    salts = max(SALTS, sum(histogram.values()) // SALT_ROWS)
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    shared = counted.sparkSession.sparkContext.broadcast(np.array(sorted(places(plan(histogram, capacity))), np.int64).reshape(-1, 6).T)
    counts = pieces.groupBy("length", "salt").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "salt", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    turn = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1
    ranked = pieces.withColumn("turn", turn).join(offsets, ["length", "salt"]).select("doc_id", "piece", "start", "length", (F.col("turn") + F.col("before")).alias("rank"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            window, position = window_of(shared.value, batch.column(3).to_numpy(), batch.column(4).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(window), pa.array(position)], ["doc_id", "piece", "start", "length", "window_id", "position"])

    kind = dict(counted.dtypes)["doc_id"]
    return ranked.mapInArrow(run, f"doc_id {kind}, piece long, start long, length long, window_id long, position long")


def contents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """(window_id, doc_ids, tokens): the windows themselves, pieces in order of position, an end mark being ``END``.

    doc_id must be unique and not null here. Tokens are shuffled twice, to their documents' places and to their windows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(shared.value).encode_ordinary
        for batch in text_runs(batches):
            ids, numbers, parts = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                found = [*encode(text), END] if text else []
                for k in range(0, len(found) if len(found) > 1 else 0, capacity):
                    ids.append(i)
                    numbers.append(k // capacity)
                    parts.append(found[k : k + capacity])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(numbers, pa.int64()), pa.array(parts, pa.list_(pa.int32()))], ["doc_id", "piece", "tokens"])

    parts = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece long, tokens array<int>")
    placed = pack(docs, capacity, vocabulary).select("doc_id", "piece", "window_id", "position")
    rows = parts.join(placed, ["doc_id", "piece"]).groupBy("window_id").agg(F.sort_array(F.collect_list(F.struct("position", "doc_id", "tokens"))).alias("parts"))
    return rows.select("window_id", F.col("parts.doc_id").alias("doc_ids"), F.flatten("parts.tokens").alias("tokens"))
