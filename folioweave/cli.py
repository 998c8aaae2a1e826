"""Command line: cluster captures or tables of measured pairs, rank candidates, link extractions."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from . import api
from .operators import linkage
from .sources import readers


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="folioweave", description=__doc__)
    verbs = parser.add_subparsers(dest="verb", required=True)
    for name, takes in (("cluster", ("images", "pairs", "out")), ("directory", ("folder", "out")), ("crop", ("result", "folder", "out")), ("rank", ("result", "out")), ("link", ("extractions", "out"))):
        verb = verbs.add_parser(name)
        for x in takes:
            verb.add_argument(x)
    a = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.verb == "cluster":
        api.write_result(api.cluster(spark.read.parquet(a.images), spark.read.parquet(a.pairs)), a.out)
    elif a.verb == "directory":
        api.write_result(api.cluster_directory(spark, a.folder), a.out)
    elif a.verb == "crop":
        found = api.crop_result(spark, api.read_result(spark, a.result), a.folder)
        for name in ("members", "submissions"):
            found[name].write.mode("overwrite").json(f"{a.out}/{name}")
    elif a.verb == "rank":
        api.rank_candidates(api.read_result(spark, a.result)).write.mode("overwrite").json(a.out)
    else:
        found = readers.read_extractions(spark, a.extractions)
        links = api.materialize(linkage.link_pairs(found))
        for name, df in (("pairs", links), ("groups", linkage.link_groups(found, links)), ("images", linkage.image_flags(found, links))):
            df.write.mode("overwrite").json(f"{a.out}/{name}")


if __name__ == "__main__":
    main()
