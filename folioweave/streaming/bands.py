"""Neighbour pairs of an unbounded, ordered feed: keyed state holds the last k items of each sequence."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_pairs(items: DataFrame, sequence: str, position: str, key: str, max_gap: int = 3) -> DataFrame:
    """(sequence, a, b, gap) for items that arrive in order of ``position``; an item out of order pairs with what is held."""
    kinds = dict(items.dtypes)

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get)) if state.exists else []
        rows = pd.concat(list(batches)).sort_values([position, key], kind="stable")
        out = []
        for p, k in rows[[position, key]].itertuples(index=False):
            held.sort()
            earlier = [h for h in held if h < (p, k)]
            out += [(name[0], a, k, gap) for gap, (_, a) in enumerate(reversed(earlier[-max_gap:]), 1)]
            held = sorted([*held, (p, k)])[-max_gap:]
        state.update(([int(p) for p, _ in held], [k for _, k in held]))
        yield pd.DataFrame(out, columns=[sequence, "a", "b", "gap"])

    return (
        items.select(sequence, F.col(position).cast("long").alias(position), key)
        .groupBy(sequence)
        .applyInPandasWithState(
            step, f"{sequence} {kinds[sequence]}, a {kinds[key]}, b {kinds[key]}, gap int", f"p array<long>, k array<{kinds[key]}>", "append", GroupStateTimeout.NoTimeout
        )
    )


def latest_decisions(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """The latest decision of every cluster in a stream of (cluster_id, ts, action), for the update mode."""
    return events.withWatermark("ts", watermark).groupBy("cluster_id").agg(F.max_by("action", "ts").alias("action"), F.max("ts").alias("ts"))


def windowed_counts(events: DataFrame, width: str = "10 minutes", watermark: str = "1 hour") -> DataFrame:
    """Events by type in tumbling windows; late rows within the watermark count."""
    return events.withWatermark("ts", watermark).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select("window.start", "window.end", "event_type", "n")
