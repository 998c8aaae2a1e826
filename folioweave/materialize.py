"""Materialising a table that several later steps use."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame


def materialize(df: DataFrame) -> DataFrame:
    """``df`` written to the folder named by spark.checkpoint.dir, which all executors share, and read from there.

    Decided pairs are used for groups, representatives and ranking. Written once,
    they are not decided again for each, a lost executor costs nothing, and no
    later filter is pushed back into the rules. Only where no folder is named, as
    in tests, a local one is used.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "folioweave-checkpoints"))
    return df.checkpoint(eager=True)
