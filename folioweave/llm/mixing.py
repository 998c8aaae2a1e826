"""Mixing sources to target weights by Pareto order sampling.

Every source gets a whole number of places out of the total, by largest
remainder of its target weight. Within a source a document expects
``places * size / sum(size)`` copies, where the size is the number of binary
digits of its text length, so longer texts are likelier by little. The whole
part of that is certain; the fractional part p is an inclusion probability.
With u a hash of the document that is uniform in (0, 1), the ranking variable is
(u / (1 - u)) / (p / (1 - p)), and the documents of smallest rank fill the
source's remaining places, so the sample's size is fixed.

Plan: no text is shuffled and no source is sorted as a whole. Ranks are counted
in equal buckets by source; only the bucket in which a source's last place falls
is ranked row by row. What comes of it, one row per source, is joined to the
documents; it is materialised first and broadcast if its row count allows.

Defined results: documents without text (null or empty) have size 0 and are
never taken; a null source is the source ''; rows that repeat a doc_id share
their draw and are taken or left together (the only way in which a source can
exceed its places); a null doc_id draws by its text; ties in rank go by doc_id;
sources without weight in ``targets`` have ``default_weight``; an empty table
gives an empty table; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh

#: Production weights: the largest source is held at three shares, two curated ones at two.
TARGETS = {"src0": 3, "src1": 2, "src2": 2}
DEFAULT_WEIGHT = 1
SEED = "mix-1"
BUCKETS = 4096
#: Tables of one row a source are broadcast up to so many rows (a few MB), else joined by shuffle.
BROADCAST_SOURCES = 50_000


def _measured(docs: DataFrame, targets: dict[str, int], default_weight: int, seed: str) -> DataFrame:
    chars = F.length("text")
    weight = F.lit(default_weight)
    for name, w in targets.items():
        weight = F.when(F.col("src") == name, F.lit(w)).otherwise(weight)
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.md5("text")))
    return (
        docs.where(chars > 0)
        .select(F.coalesce("source", F.lit("")).alias("src"), key.alias("key"), F.length(F.bin(chars)).cast("long").alias("size"))
        .withColumn("weight", weight.cast("long"))
        .withColumn("draw", _uniform(F.col("key"), seed))
    )


def _uniform(key: Column, seed: str) -> Column:
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), key)), 1, 13)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(2**52))


def _small(by_source: DataFrame) -> DataFrame:
    """One row a source, materialised so that its size is known, and broadcast if that allows.

    Without that the documents would be shuffled by source, the largest source into one task.
    """
    by_source = cut(by_source)
    return F.broadcast(by_source) if by_source.count() <= BROADCAST_SOURCES else by_source


def _ranked(measured: DataFrame, places: DataFrame) -> DataFrame:
    """With whole copies, and the rank q of those that may be drawn (null where p is 0)."""
    expected = F.col("places") * F.col("size") / F.col("sizes").cast("double")
    p, u = F.col("p"), F.col("draw")
    return (
        measured.join(places, "src")
        .withColumn("expected", expected)
        .withColumn("whole", F.floor("expected").cast("long"))
        .withColumn("p", F.col("expected") - F.col("whole"))
        .withColumn("q", F.when(p > 0, (u / (1 - u)) / (p / (1 - p))))
    )


def source_cuts(docs: DataFrame, targets: dict[str, int], default_weight: int, seed: str, buckets: int) -> DataFrame:
    """(src, places, sizes, cut_q, cut_key) by source; rows up to (cut_q, cut_key) are drawn."""
    measured = _measured(docs, targets, default_weight, seed)
    by_source = measured.groupBy("src").agg(
        F.sum("size").alias("sizes"), F.count("*").alias("docs"), F.first("weight").alias("weight")
    )
    all_sources = Window.partitionBy(F.lit(1))
    share = F.sum("docs").over(all_sources) * F.col("weight")
    places = (
        by_source.withColumn("share", share)
        .withColumn("weights", F.sum("weight").over(all_sources))
        .withColumn("base", F.expr("share div weights"))
        .withColumn("left", F.sum("docs").over(all_sources) - F.sum("base").over(all_sources))
        .withColumn("turn", F.row_number().over(all_sources.orderBy(F.expr("share % weights").desc(), "src")))
        .select("src", "sizes", (F.col("base") + (F.col("turn") <= F.col("left")).cast("long")).alias("places"))
    )
    places = _small(places)
    ranked = _ranked(measured, places)
    bucket = F.floor(F.col("q") / (1 + F.col("q")) * buckets).cast("int")
    counts = (
        ranked.withColumn("bucket", bucket)
        .groupBy("src", "bucket")
        .agg(
            F.count("q").alias("n"),
            F.sum("whole").alias("whole"),
            F.first("places").alias("places"),
            F.first("sizes").alias("sizes"),
        )
    )
    by_src = Window.partitionBy("src")
    running = (
        counts.withColumn("open", F.col("places") - F.sum("whole").over(by_src))
        .withColumn("upto", F.sum("n").over(by_src.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("rest", F.col("open") - (F.col("upto") - F.col("n")))
    )
    last = running.where("n > 0 and rest between 1 and n").select("src", "bucket", "rest")
    edge = (
        ranked.where("q is not null")
        .withColumn("bucket", bucket)
        .join(_small(last), ["src", "bucket"])
        .withColumn("turn", F.row_number().over(by_src.orderBy("q", "key")))
        .where("turn = rest")
        .select("src", F.col("q").alias("cut_q"), F.col("key").alias("cut_key"))
    )
    return places.join(edge, "src", "left")


def mix(
    docs: DataFrame,
    targets: dict[str, int] | None = None,
    default_weight: int = DEFAULT_WEIGHT,
    seed: str = SEED,
    buckets: int = BUCKETS,
) -> DataFrame:
    """The documents' columns and ``copies``, for every document, 0 included."""
    targets = TARGETS if targets is None else targets
    cuts = _small(source_cuts(docs, targets, default_weight, seed, buckets))
    names = fresh(docs, "src", "key", "size", "draw", "places", "sizes", "cut_q", "cut_key", "copies")
    src, key, size, draw, places, sizes, cut_q, cut_key, copies = names
    chars = F.coalesce(F.length("text"), F.lit(0))
    cuts = cuts.select(*(F.col(a).alias(b) for a, b in zip(("src", "places", "sizes", "cut_q", "cut_key"), (src, places, sizes, cut_q, cut_key))))
    keyed = docs.withColumns({
        src: F.coalesce("source", F.lit("")),
        key: F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.md5("text"))),
        size: F.when(chars > 0, F.length(F.bin(chars)).cast("long")),
    }).withColumn(draw, _uniform(F.col(key), seed))
    expected = F.col(places) * F.col(size) / F.col(sizes).cast("double")
    whole = F.floor(expected).cast("long")
    p, u = expected - whole, F.col(draw)
    q = F.when(p > 0, (u / (1 - u)) / (p / (1 - p)))
    drawn = (q < F.col(cut_q)) | ((q == F.col(cut_q)) & (F.col(key) <= F.col(cut_key)))
    n = F.when(F.col(size).isNull(), F.lit(0)).otherwise(F.coalesce(whole, F.lit(0)) + F.coalesce(drawn, F.lit(False)).cast("long"))
    return keyed.join(cuts, src, "left").select(*(F.col(f"`{c}`") for c in docs.columns), n.cast("long").alias(copies))


def sampled(docs: DataFrame, **parameters) -> DataFrame:
    """The mixed corpus: every document as many times as it has copies, the documents' columns."""
    mixed = mix(docs, **parameters)
    copies = mixed.columns[-1]
    (turn,) = fresh(mixed, "turn")
    return (
        mixed.where(F.col(copies) > 0)
        .withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(copies))))
        .select(*(F.col(f"`{c}`") for c in docs.columns))
    )


_WEIGHTS = "".join(f" WHEN src = '{name}' THEN {w}" for name, w in TARGETS.items())
SQL = f"""
WITH m AS (
  SELECT doc_id, source, coalesce(source, '') AS src, CAST(doc_id AS VARCHAR) AS key,
         CASE WHEN length(text) > 0 THEN length(bin(length(text))) END AS size,
         (CAST(CAST('0x' || substr(md5('{SEED}:' || CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) + 0.5)
           / CAST(4503599627370496 AS DOUBLE) AS u
  FROM documents
), s AS (
  SELECT src, CAST(sum(size) AS BIGINT) AS sizes, count(*) AS docs, CASE{_WEIGHTS} ELSE {DEFAULT_WEIGHT} END AS weight
  FROM m WHERE size IS NOT NULL GROUP BY src
), t AS (
  SELECT *, CAST(sum(docs) OVER () AS BIGINT) * weight AS share, CAST(sum(weight) OVER () AS BIGINT) AS weights FROM s
), f AS (
  SELECT *, share // weights AS base FROM t
), g AS (
  SELECT src, sizes, base + CASE WHEN row_number() OVER (ORDER BY share % weights DESC, src)
           <= sum(docs) OVER () - sum(base) OVER () THEN 1 ELSE 0 END AS places
  FROM f
), e AS (
  SELECT m.*, CAST(places AS BIGINT) AS places, CAST(places * size AS DOUBLE) / CAST(sizes AS DOUBLE) AS expected
  FROM m LEFT JOIN g ON m.src = g.src AND m.size IS NOT NULL
), w AS (
  SELECT *, CAST(floor(expected) AS BIGINT) AS whole, expected - floor(expected) AS p FROM e
), q AS (
  SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM w
), r AS (
  SELECT *, row_number() OVER (PARTITION BY src ORDER BY q NULLS LAST, key) AS turn,
         places - sum(whole) OVER (PARTITION BY src) AS rest
  FROM q
)
SELECT doc_id, source,
       CAST(coalesce(whole, 0) + CASE WHEN q IS NOT NULL AND turn <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM r
"""
