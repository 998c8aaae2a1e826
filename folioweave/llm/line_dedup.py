"""Line dedup by content-defined line chunks.

A document is a list of lines. A rolling hash over the hashes of the last
``window`` lines decides after which lines a chunk ends, so the boundaries inside
a shared passage do not depend on what stands before it, once the window lies
within the passage. A chunk of two or more lines that occurs again anywhere in
the corpus (or in the same document) stays only at its first place, in (doc_id,
place) order.

At its ends a passage shares a chunk with lines of its document, so chunks alone
leave its first and last lines, and short passages whole. What no repeated chunk
covers is therefore compared window by window: two adjacent lines that occurred
next to each other before go, too, and so does a single line of more than
``LONG`` words that occurred before. In all, a line goes if and only if it lies
in a repeated run of two lines or is such a long line; chunks spare the windows
of all later copies.

Byte comparison: lines are grouped by hash *and text* first. Where every hash
stands for one text, as is all but certain, equal hashes are equal bytes, and all
else is done on hashes; otherwise it is done on the lines themselves.

Plan: one shuffle of lines with map-side combining for that comparison; chunks
and windows are shuffled as hashes and places only; the documents are shuffled
once, to meet their removal lists, and not at all where those are small enough
for Spark to broadcast.

Defined results: a null text stays null; an empty text stays empty; a text all of
whose lines go becomes empty; two blank lines are no repeated run; the first
occurrence of a line is never removed; very long texts count whole; rows that
repeat doc_id and text are one document and come out alike; a null doc_id ranks
after all others; other columns pass through, whatever their names; an empty table
gives an empty table. doc_id is an integer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh, let

WINDOW = 2
DIVISOR = 3
#: A line of more words than this is a passage by itself.
LONG = 50


def line_hash(line: Column) -> Column:
    return F.xxhash64(line)


def chunks(hashes: Column, last: Column, window: int = WINDOW, divisor: int = DIVISOR) -> Column:
    """array<struct<start, n>> of the content-defined chunks of lines with such hashes, of which ``last`` is the last number."""

    def ends(small: Column) -> Column:
        def is_end(i: Column) -> Column:
            roll = F.get(small, i)
            for back in range(1, window):
                roll = roll + F.lit(31**back) * F.get(small, i - back)
            return (i == last) | ((i >= window - 1) & (roll % divisor == 0))

        return F.filter(F.sequence(F.lit(0), last), is_end)

    def cut_at(end: Column) -> Column:
        def one(e: Column, k: Column) -> Column:
            return let(F.when(k == 0, F.lit(0)).otherwise(F.get(end, k - 1) + 1), lambda s: F.struct(s.alias("start"), (e - s + 1).alias("n")))

        return F.transform(end, one)

    return let(F.transform(hashes, lambda h: F.pmod(h, F.lit(1 << 28))), lambda h: let(ends(h), cut_at))


def _blank(line: Column) -> Column:
    return F.replace(line, F.lit(" "), F.lit("")) == ""


def _long(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) >= LONG


def ambiguous(docs: DataFrame) -> bool:
    """Whether some line hash stands for several texts."""
    lines = docs.where("text is not null").select(F.explode(F.split("text", "\n")).alias("line")).select(line_hash(F.col("line")).alias("h"), "line")
    texts = lines.groupBy("h", "line").agg(F.count("*").alias("n")).groupBy("h").agg(F.count("*").alias("texts"))
    return not texts.where("texts > 1").isEmpty()


def _listed(docs: DataFrame, exact: bool) -> DataFrame:
    """(doc, key, lines, ids): ``ids`` are the lines' hashes, or the lines themselves."""
    lines = F.split("text", "\n")
    of = docs.where("text is not null").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("doc"), F.xxhash64("doc_id", "text").alias("key"), lines.alias("lines"))
    return of.withColumn("ids", F.col("lines") if exact else F.transform("lines", line_hash))


def _later(found: DataFrame, what: list[str]) -> DataFrame:
    """The rows (doc, key, start, n) of ``found`` whose like, by the columns ``what``, stood at an earlier place."""
    place = F.struct("doc", "key", "start")
    first = found.groupBy(*what).agg(F.count("*").alias("times"), F.min(place).alias("first")).where("times > 1").drop("times")
    return found.join(first, what).where(place != F.col("first")).select("doc", "key", "start", "n")


def repeated_chunks(listed: DataFrame, window: int, divisor: int) -> DataFrame:
    """(doc, key, start, n) of the chunks of two lines or more that stood earlier; none with two blank lines in a row."""
    last = F.size("lines") - 1
    hashes = F.transform("lines", line_hash)
    found = listed.where("size(lines) > 1").select("doc", "key", "lines", "ids", F.explode(F.filter(chunks(hashes, last, window, divisor), lambda c: c["n"] >= 2)).alias("c"))
    part = lambda name: F.slice(name, F.col("c.start") + 1, F.col("c.n"))
    blank = let(F.transform(part("lines"), _blank), lambda b: F.exists(F.sequence(F.lit(1), F.size(b) - 1), lambda i: F.get(b, i) & F.get(b, i - 1)))
    return _later(found.where(~blank).select("doc", "key", F.col("c.start").alias("start"), F.col("c.n").alias("n"), part("ids").alias("body")), ["body"])


def repeated_windows(listed: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc, key, start, n) of windows, and of long lines, that stood earlier, apart from those inside ``spans``."""
    held = spans.groupBy("doc", "key").agg(F.sort_array(F.collect_set(F.struct("start", "n"))).alias("spans"))
    both = listed.join(held, ["doc", "key"], "left")

    def windows(lines: Column, ids: Column, inside: Column) -> Column:
        def one(i: Column) -> Column:
            return F.struct(i.alias("start"), F.lit(2).alias("n"), F.get(ids, i).alias("a"), F.get(ids, i + 1).alias("b"))

        def alone(i: Column) -> Column:
            return F.struct(i.alias("start"), F.lit(1).alias("n"), F.get(ids, i).alias("a"), F.lit(None).cast(dict(listed.dtypes)["ids"][6:-1]).alias("b"))

        places = F.sequence(F.lit(0), F.size(lines) - 1)
        pairs = F.filter(places, lambda i: (i < F.size(lines) - 1) & ~(_blank(F.get(lines, i)) & _blank(F.get(lines, i + 1))) & ~F.coalesce(F.get(inside, i), F.lit(False)))
        return F.concat(F.transform(pairs, one), F.transform(F.filter(places, lambda i: _long(F.get(lines, i)) & ~F.coalesce(F.get(inside, i), F.lit(False))), alone))

    # for each line up to the end of the last span, whether it and the next lie in one span
    gap = lambda n: F.array_repeat(F.lit(False), n)
    covered = F.transform(
        "spans",
        lambda s, k: F.concat(
            gap(s["start"] - F.when(k == 0, F.lit(0)).otherwise(F.get("spans", k - 1)["start"] + F.get("spans", k - 1)["n"])),
            F.array_repeat(F.lit(True), s["n"] - 1),
            gap(F.lit(1)),
        ),
    )
    inside = F.coalesce(F.flatten(covered), F.array().cast("array<boolean>"))
    found = both.withColumn("inside", inside).select("doc", "key", F.explode(windows(F.col("lines"), F.col("ids"), F.col("inside"))).alias("w")).select("doc", "key", "w.*")
    pairs = _later(found.where("n = 2"), ["a", "b"])
    return pairs.union(_later(found.where("n = 1").drop("b"), ["a"]))


def removals(docs: DataFrame, window: int = WINDOW, divisor: int = DIVISOR) -> DataFrame:
    """(doc, key, gone): per document the line spans that repeat earlier ones, in order and apart from each other."""
    listed = _listed(docs, ambiguous(docs))
    spans = cut(repeated_chunks(listed, window, divisor))
    every = spans.union(repeated_windows(listed, spans))
    order = Window.partitionBy("doc", "key").orderBy("start", "n")
    reach = F.max(F.col("start") + F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = every.withColumn("new", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int"))
    runs = marked.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy("doc", "key", "run")
    merged = runs.agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("n")).alias("end"))
    return merged.groupBy("doc", "key").agg(F.sort_array(F.collect_list(F.struct("start", (F.col("end") - F.col("start")).alias("n")))).alias("gone"))


def without(text: Column, gone: Column) -> Column:
    """The text without the sorted line spans ``gone``."""

    def of(lines: Column) -> Column:
        def between(k: Column) -> Column:
            start = F.when(k == 0, F.lit(0)).otherwise(F.get(gone, k - 1)["start"] + F.get(gone, k - 1)["n"])
            end = F.when(k == F.size(gone), F.size(lines)).otherwise(F.get(gone, k)["start"])
            return F.slice(lines, start + 1, end - start)

        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), between)), "\n")

    return let(F.split(text, "\n"), of)


def dedup_lines(docs: DataFrame, window: int = WINDOW, divisor: int = DIVISOR, report: bool = False) -> DataFrame:
    """The documents without repeated runs of lines; with ``report`` also runs_removed and lines_removed."""
    doc, key, gone = fresh(docs, "doc", "key", "gone")
    spans = removals(docs, window, divisor).toDF(doc, key, gone)
    joined = docs.withColumns(
        {doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)), key: F.xxhash64("doc_id", "text")}
    ).join(spans, [doc, key], "left")
    out = [
        F.when(F.col(gone).isNull(), F.col("text")).otherwise(without(F.col("text"), F.col(gone))).alias("text")
        if c == "text"
        else F.col(f"`{c}`")
        for c in docs.columns
    ]
    if report:
        removed, lines = fresh(docs, "runs_removed", "lines_removed")
        out += [
            F.coalesce(F.size(gone), F.lit(0)).cast("long").alias(removed),
            F.coalesce(F.aggregate(gone, F.lit(0), lambda s, x: s + x["n"]), F.lit(0)).cast("long").alias(lines),
        ]
    return joined.select(out)


SQL = f"""
WITH line AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i
  FROM documents WHERE text IS NOT NULL
), two AS (
  SELECT doc_id, i, line, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM line
), pair AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY line, next ORDER BY doc_id, i) AS k FROM two
  WHERE next IS NOT NULL AND NOT (replace(line, ' ', '') = '' AND replace(next, ' ', '') = '')
), alone AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY line ORDER BY doc_id, i) AS k FROM two
  WHERE length(line) - length(replace(line, ' ', '')) >= {LONG}
), gone AS (
  SELECT doc_id, i FROM pair WHERE k > 1 UNION SELECT doc_id, i + 1 FROM pair WHERE k > 1
  UNION SELECT doc_id, i FROM alone WHERE k > 1
), marked AS (
  SELECT l.doc_id, l.i, l.line, g.i IS NOT NULL AS gone,
         coalesce(lag(g.i IS NOT NULL) OVER (PARTITION BY l.doc_id ORDER BY l.i), false) AS before
  FROM line l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i
), rebuilt AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS text,
         count(*) FILTER (WHERE gone AND NOT before) AS runs_removed, count(*) FILTER (WHERE gone) AS lines_removed
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, r.text, d.lang, d.source, d.n_chars,
       coalesce(r.runs_removed, 0) AS runs_removed, coalesce(r.lines_removed, 0) AS lines_removed
FROM documents d LEFT JOIN rebuilt r ON d.doc_id = r.doc_id
"""
