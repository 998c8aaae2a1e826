"""Choosing the best view of every page: scalar rules and greedy selections."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def completeness(hidden: Column) -> Column:
    """By the share of a page that is hidden: complete, the best part that there is, or null where too little is seen to submit it."""
    return F.when(hidden <= 0.025, "complete").when(hidden <= 0.55, "partial_best_available")


def canonical_pages(views: DataFrame, group: str, page: str, score: str, order: str) -> DataFrame:
    """The best-scoring view of each page; ties to the earlier."""
    best = Window.partitionBy(group, page).orderBy(c(score).desc(), c(order))
    return views.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def signature(*parts: str) -> Column:
    """What a finished result depends on; equal signatures need no new work."""
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def unfinished(work: DataFrame, finished: DataFrame) -> DataFrame:
    return work.join(finished.select("signature"), "signature", "left_anti")


def with_fallback(clusters: DataFrame, submissions: DataFrame, columns: Sequence[Column]) -> DataFrame:
    """The submissions, and a row of ``columns`` for each cluster that has none."""
    empty = clusters.join(submissions.select("cluster_id"), "cluster_id", "left_anti")
    return submissions.unionByName(empty.select("cluster_id", *columns), allowMissingColumns=True)


def iou(a: Sequence[int], b: Sequence[int]) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    common = max(0, w) * max(0, h)
    size = lambda r: max(0, r[2] - r[0]) * max(0, r[3] - r[1])
    either = size(a) + size(b) - common
    return common / either if either else 0.0


def greedy_matches(targets: Iterable[Sequence[int]], found: Sequence[Sequence[int]]) -> list[tuple[int, int, float]]:
    """(target, found, iou): targets in order, each with the best box that is left; ties to the earlier box."""
    free = list(range(len(found)))
    out = []
    for i, t in enumerate(targets):
        if free:
            j = max(free, key=lambda k: (iou(t, found[k]), -k))
            free.remove(j)
            out.append((i, j, iou(t, found[j])))
    return out


def match_boxes(expected: DataFrame, actual: DataFrame, keys: Sequence[str], order: str = "n") -> DataFrame:
    """(*keys, expected_n, actual_n, iou): one-to-one matches among rows of equal keys; both sides have n, x0, y0, x1, y1.

    Boxes of one key are gathered in Spark; Python sees batches of keys, not one call a key.
    """
    box = [c(order).cast("long").alias("n"), *(c(k).cast("long").alias(k) for k in ("x0", "y0", "x1", "y1"))]
    gathered = lambda df, name: df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*box))).alias(name))

    @F.pandas_udf("array<struct<expected_n: long, actual_n: long, iou: double>>")
    def matches(es: pd.Series, found: pd.Series) -> pd.Series:
        corners = lambda rows: [(r["x0"], r["y0"], r["x1"], r["y1"]) for r in rows]
        return pd.Series([
            [{"expected_n": e[i]["n"], "actual_n": a[j]["n"], "iou": v} for i, j, v in greedy_matches(corners(e), corners(a))] for e, a in zip(es, found)
        ])

    return gathered(expected, "_e").join(gathered(actual, "_a"), keys).select(*keys, F.explode(matches("_e", "_a")).alias("m")).select(*keys, "m.*")


def match_metrics(expected: DataFrame, actual: DataFrame, matches: DataFrame) -> DataFrame:
    counts = expected.agg(F.count("*").alias("expected_count")).crossJoin(actual.agg(F.count("*").alias("actual_count")))
    found = matches.agg(F.count("*").alias("matched_count"), F.coalesce(F.avg("iou"), F.lit(0.0)).alias("mean_iou"), F.coalesce(F.min("iou"), F.lit(0.0)).alias("minimum_iou"))
    return counts.crossJoin(found).withColumns({
        "missed_count": c("expected_count") - c("matched_count"),
        "false_positive_count": c("actual_count") - c("matched_count"),
        "exact": (c("expected_count") == c("matched_count")) & (c("actual_count") == c("matched_count")),
    })


def keep_distinct(rows: DataFrame, group: str, alike: Callable[[dict, dict], bool], score: str) -> DataFrame:
    """Best-scored rows of each group, leaving out those ``alike`` to one that is kept already; ties by the other columns."""
    rest = [x for x in rows.columns if x not in (group, score)]
    entry = F.struct((-c(score)).alias("_s"), *rest)
    gathered = rows.groupBy(group).agg(F.sort_array(F.collect_list(entry)).alias("_rows"))

    @F.pandas_udf("array<int>")
    def kept(lists: pd.Series) -> pd.Series:
        out = []
        for found in lists:
            keep: list[int] = []
            for i, row in enumerate(found):
                if not any(alike(row, found[j]) for j in keep):
                    keep.append(i)
            out.append(keep)
        return pd.Series(out)

    picked = gathered.select(group, F.explode(F.transform(kept("_rows"), lambda i: F.get(c("_rows"), i))).alias("r"))
    return picked.select(*(c(group) if x == group else (-c("r._s")).alias(x) if x == score else c(f"r.{x}").alias(x) for x in rows.columns))


def merge_candidates(rows: DataFrame, least: float = 0.55) -> DataFrame:
    """Candidates (group_id, side, x0, y0, x1, y1, confidence), without those that overlap a surer one of their side.

    Overlap is the common area over the smaller box.
    """

    def overlaps(a: dict, b: dict) -> bool:
        if a["side"] != b["side"]:
            return False
        w, h = min(a["x1"], b["x1"]) - max(a["x0"], b["x0"]), min(a["y1"], b["y1"]) - max(a["y0"], b["y0"])
        smaller = min((r["x1"] - r["x0"]) * (r["y1"] - r["y0"]) for r in (a, b))
        return smaller > 0 and max(0, w) * max(0, h) / smaller >= least

    return keep_distinct(rows, "group_id", overlaps, "confidence")


def weighted_quantile(rows: DataFrame, group: str, value: str, weight: str, q: float) -> DataFrame:
    """(group, quantile): the least value at which the summed weight reaches q of the total."""
    up = Window.partitionBy(group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    by_value = rows.groupBy(group, value).agg(F.sum(weight).alias("_w"))
    run = by_value.withColumns({"_c": F.sum("_w").over(up), "_t": F.sum("_w").over(Window.partitionBy(group))})
    return run.where(c("_c") >= q * c("_t")).groupBy(group).agg(F.min(value).alias("quantile"))


def lowest(rows: DataFrame, group: str, score: str, order: str, k: int) -> DataFrame:
    """The k rows of least score in each group; ties to the earlier."""
    up = Window.partitionBy(group).orderBy(score, order)
    return rows.withColumn("_n", F.row_number().over(up)).where(c("_n") <= k).drop("_n")


def upper_tail(rows: DataFrame, group: str, value: str, share: float) -> DataFrame:
    """(group, upper_tail, p50, p95): the mean of the highest share of the values, at least one, and interpolated percentiles.

    Values are counted before they are ordered, so a group's rows need not meet in one task, only its distinct values.
    """
    counted = rows.where(c(value).isNotNull()).groupBy(group, c(value).alias("_v")).agg(F.count("*").alias("_c"))
    down = Window.partitionBy(group).orderBy(c("_v").desc()).rowsBetween(Window.unboundedPreceding, 0)
    run = counted.withColumns({"_upto": F.sum("_c").over(down), "_all": F.sum("_c").over(Window.partitionBy(group))})
    most = F.greatest(F.lit(1), F.round(F.lit(share) * c("_all")))
    taken = F.greatest(F.lit(0), F.least(c("_c"), most - (c("_upto") - c("_c"))))
    return run.groupBy(group).agg(
        (F.sum(c("_v") * taken) / F.sum(taken)).alias("upper_tail"), F.percentile("_v", F.lit(0.5), c("_c")).alias("p50"), F.percentile("_v", F.lit(0.95), c("_c")).alias("p95")
    )


def robust_tiles(rows: DataFrame, group: str, value: str, floor: float = 1e-9) -> DataFrame:
    """The rows with the group's median and median absolute deviation, and ``z``."""
    middle = rows.groupBy(group).agg(F.median(value).alias("median"))
    off = rows.join(middle, group).withColumn("_d", F.abs(c(value) - c("median")))
    mad = off.groupBy(group).agg(F.median("_d").alias("mad"))
    return off.join(mad, group).withColumn("z", (c(value) - c("median")) / F.greatest(1.4826 * c("mad"), F.lit(floor))).drop("_d")
