"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, each lengthened by underscores until no column of ``df`` has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder; only where none is named, as in tests, a local one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "folioweave-checkpoints"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder, so that a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Tables are broadcast up to so many rows (a few MB), else joined by shuffle.
BROADCAST_ROWS = 50_000


def broadcast_small(table: DataFrame) -> DataFrame:
    """A materialised table of narrow rows, to be broadcast if it has few of them."""
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


#: Rows of an Arrow batch are processed in runs of about so many characters, so that memory stays bounded on very long texts.
RUN_CHARS = 4_000_000


def text_runs(batches: Iterable[pa.RecordBatch], run_chars: int = RUN_CHARS) -> Iterator[pa.RecordBatch]:
    """Split (id, text) batches into runs of bounded text size; a row is never split or dropped."""
    for batch in batches:
        start = size = 0
        lengths = pc.binary_length(batch.column(1)).fill_null(0).to_pylist()
        for i, n in enumerate(lengths):
            size += n
            if size >= run_chars:
                yield batch.slice(start, i + 1 - start)
                start, size = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)
