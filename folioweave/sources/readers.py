"""Readers of captures, results, extractions, evidence, reviewed truth and labels."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import IMAGE_SUFFIXES, base_name, canonical_id, image_id, series_and_index, stem, to_boolean
from ..operators.pairs import sequence_index
from ..operators.ranks import counted_before
from . import schemas

c = F.col


def _checked(df: DataFrame, bad: Column, message: str) -> DataFrame:
    """The rows; an action fails if any is ``bad``."""
    first = df.columns[0]
    return df.withColumn(first, F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit(message)).cast(df.schema[first].dataType)).otherwise(c(f"`{first}`")))


# --- captures


def scan_images(spark: SparkSession, folder: str) -> DataFrame:
    """(image_id, path, sequence_id, sequence_index) of all images below a folder; each folder is a sequence, by file name.

    The contents are not read.
    """
    suffixes = "(?i)\\.(" + "|".join(IMAGE_SUFFIXES) + ")$"
    root = folder.rstrip("/")
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        .select(F.regexp_replace("path", "^file:/*", "/").alias("path")).where(c("path").rlike(suffixes))
    )
    inner = F.substring("path", F.lit(len(root) + 2), F.length("path"))
    parent = F.coalesce(F.nullif(F.regexp_extract(inner, "^(.*)/[^/]*$", 1), F.lit("")), F.lit("."))
    placed = files.select(parent.alias("sequence_id"), base_name(c("path")).alias("name"), "path")
    placed = sequence_index(placed, "sequence_id", ["name"])
    return placed.select(image_id(c("sequence_id"), c("name")).alias("image_id"), "path", "sequence_id", "sequence_index")


def with_global_index(images: DataFrame) -> DataFrame:
    return counted_before(images, ["sequence_id", "sequence_index"], "_i").withColumn("global_index", (c("_i") - 1).cast("int")).drop("_i")


def ordered_images(spark: SparkSession, paths: Sequence[str], sequence: str = ".") -> DataFrame:
    """The given files in the given order; names must be unique and have an image suffix."""
    names = [p.rsplit("/", 1)[-1] for p in paths]
    if not names:
        raise ValueError("no images")
    if len(set(names)) < len(names):
        raise ValueError("an image name appears twice")
    if odd := [n for n in names if n.rsplit(".", 1)[-1].lower() not in IMAGE_SUFFIXES]:
        raise ValueError(f"not an image: {odd[0]}")
    rows = spark.createDataFrame([(n, p, sequence, i) for i, (n, p) in enumerate(zip(names, paths))], "name string, path string, sequence_id string, sequence_index int")
    return rows.select(image_id(c("sequence_id"), c("name")).alias("image_id"), "path", "sequence_id", "sequence_index")


def join_group_manifest(manifest: DataFrame, images: DataFrame, max_group_size: int | None = None) -> DataFrame:
    """Images in the groups of a manifest (source_sample_row, neighbor_of, media_item_id, filename, optional relative_path, sequence_index).

    A file is found by its relative path, else by media_item_id/filename, else by
    its name where that is unique. An image in two groups, a repeated row, a
    missing file or a group that is too large is an error.
    """
    wanted = manifest.withColumns({k: c(k) if k in manifest.columns else F.lit(None).cast("string") for k in ("relative_path", "sequence_index")})
    names = images.select("image_id", "path", base_name(c("image_id")).alias("_name"))
    unique = names.groupBy("_name").agg(F.count("*").alias("_n"), F.first("image_id").alias("_id3"), F.first("path").alias("_p3")).where("_n = 1").drop("_n")
    by_id = lambda key, n: names.select(c("image_id").alias(key), c("image_id").alias(f"_id{n}"), c("path").alias(f"_p{n}"))
    found = (
        wanted.withColumns({"_k1": c("relative_path"), "_k2": F.concat_ws("/", "media_item_id", "filename"), "_name": c("filename")})
        .join(by_id("_k1", 1), "_k1", "left").join(by_id("_k2", 2), "_k2", "left").join(unique, "_name", "left")
        .withColumns({"image_id": F.coalesce("_id1", "_id2", "_id3"), "path": F.coalesce("_p1", "_p2", "_p3"), "sequence_id": F.coalesce("neighbor_of", "source_sample_row")})
    )
    image, group = Window.partitionBy("image_id"), Window.partitionBy("sequence_id")
    flagged = found.withColumns({"_groups": F.size(F.collect_set("sequence_id").over(image)), "_times": F.count("*").over(Window.partitionBy("sequence_id", "image_id")), "_size": F.count("*").over(group)})
    order = (c("sequence_index").cast("int").isNull(), c("sequence_index").cast("int"), c("source_sample_row").cast("int"), c("filename"))
    out = flagged.select("image_id", "path", "sequence_id", (F.row_number().over(group.orderBy(*order)) - 1).alias("sequence_index"), "_groups", "_times", "_size")
    out = _checked(out, c("image_id").isNull(), "a manifest row has no file")
    out = _checked(out, c("_groups") > 1, "an image lies in two groups")
    out = _checked(out, c("_times") > 1, "a manifest row is repeated")
    if max_group_size is not None:
        out = _checked(out, c("_size") > max_group_size, "a group is too large")
    return out.drop("_groups", "_times", "_size")


def group_order(key: Column) -> list[Column]:
    """Numbers first, by value, then the rest by text."""
    number = key.try_cast("long")
    return [number.isNull(), number, key]


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """(folder, files, bytes) and the SHA-256 of each folder's contents in order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"), "length", F.sha2("content", 256).alias("sha")).groupBy("folder").agg(
        F.count("*").alias("files"), F.sum("length").alias("bytes"), F.sha2(F.array_join(F.sort_array(F.collect_list("sha")), ","), 256).alias("sha256")
    )


def file_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """(path, folder, bytes, width, height, channels, error) of every image below a folder, each decoded once; an unreadable one has its error."""
    from ..operators.images import decode

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).where(c("path").rlike("(?i)\\.(" + "|".join(IMAGE_SUFFIXES) + ")$"))
    schema = "path string, folder string, bytes long, width int, height int, channels int, error string"

    def measured(raw: bytes) -> tuple:
        try:
            h, w, channels = decode(bytes(raw)).shape
        except ValueError as error:
            return None, None, None, str(error)
        return w, h, channels, None

    def run(batches):
        import pandas as pd

        for rows in batches:
            out = [(p, p.rsplit("/", 1)[0], len(raw), *measured(raw)) for p, raw in zip(rows["path"], rows["content"])]
            yield pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")]).astype({k: "Int32" for k in ("width", "height", "channels")})

    return files.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "content").mapInPandas(run, schema)


def resolve_library(rows: DataFrame, files: DataFrame) -> DataFrame:
    """(name, path, sha256, status): for each wanted name the smallest path of its files; missing, found, duplicate_same; conflict where bytes differ.

    ``rows`` has source_path, ``files`` path and sha256. Copy numbers in names do not count.
    """
    plain = lambda p: F.regexp_replace(base_name(p), r"\(\d+\)(\.[^.]*)$", "$1")
    by_name = files.groupBy(plain(c("path")).alias("name")).agg(F.min("path").alias("path"), F.min_by("sha256", "path").alias("sha256"), F.countDistinct("sha256").alias("_kinds"), F.count("*").alias("_n"))
    state = F.when(c("_n").isNull(), "missing").when(c("_kinds") > 1, "conflict").when(c("_n") > 1, "duplicate_same").otherwise("found")
    return rows.select(plain(c("source_path")).alias("name")).distinct().join(by_name, "name", "left").select("name", "path", "sha256", state.alias("status"))


# --- results and extractions


def read_result(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """images, clusters and comparisons of a result file of the known version."""
    schema = (
        f"schema_version int, config_fingerprint string, input_root string, grouping_mode string, images array<struct<{_fields(schemas.IMAGES)}>>, "
        f"clusters array<struct<{_fields(schemas.CLUSTERS)}>>, comparisons array<{schemas.PAIRS.simpleString()}>"
    )
    whole = _checked(spark.read.option("multiLine", True).schema(schema).json(path), ~c("schema_version").eqNullSafe(schemas.RESULT_VERSION), "unknown result version")
    return {k: whole.select("schema_version", F.explode(k).alias("r")).select("r.*") for k in ("images", "clusters", "comparisons")}


def _fields(ddl: str) -> str:
    return ", ".join(f.strip().replace(" ", ": ", 1) for f in ddl.split(", "))


_RECORD = "struct<role: string, record_role: string, event_type: string, fields: map<string,string>>"
#: What an extraction's payload holds, be it the object itself or its parsed_response.
_PAYLOAD = (
    f"struct<records: array<{_RECORD}>, source_filename: string, "
    "events: array<struct<event_type: string, event_place: map<string,string>, date_observations: array<map<string,string>>, records: array<string>>>>"
)
_NAMES = "struct<source_filename: string, image_stem: string, image_id: string, filename: string>"


def json_objects(spark: SparkSession, path: str) -> DataFrame:
    """(source, value): JSON objects of JSON lines, of a JSON list, or of an object that wraps items, results or extractions."""
    if path.lower().endswith(".jsonl"):
        lines = spark.read.text(path).where(F.trim("value") != "")
        return lines.select(c("_metadata.file_path").alias("source"), "value")
    whole = spark.read.text(path, wholetext=True).select(c("_metadata.file_path").alias("source"), "value")
    strings = "array<string>"
    lists = [F.from_json(F.get_json_object("value", f"$.{k}"), strings) for k in ("items", "results", "extractions")]
    objects = F.when(F.ltrim("value").startswith("["), F.from_json("value", strings)).otherwise(F.coalesce(*lists, F.array("value")))
    return whole.select("source", F.explode(objects).alias("value")).where(F.ltrim("value").startswith("{"))


def read_extractions(spark: SparkSession, *paths: str) -> DataFrame:
    """(image_id, sequence_key, sequence_index, records, quality, source) of flat and of event-shaped extractions."""
    parts = [json_objects(spark, p) for p in paths]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return extractions(rows)


_IGNORED = ("event_type", "role", "record_index", "record_id")


def _clean(fields: Column) -> Column:
    return F.map_filter(F.coalesce(fields, F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(*_IGNORED) & v.isNotNull() & (v != "") & ~v.rlike(r"^\s*[\[{]"))


def _flatten(event: Column) -> Column:
    """Records of one event: dotted places of the nested record become flat fields."""
    places = event["event_place"]
    dates = event["date_observations"]
    early = event["event_type"].isin("Declaration", "Petition", "Deposition", "Oath")
    day = F.when(F.size(dates) > 0, F.when(early, F.element_at(dates, 1)).otherwise(F.element_at(dates, -1)))
    base = {f"event_{k}": F.try_element_at(places, F.lit(k)) for k in ("city", "county", "state")} | {f"event_{k}": F.try_element_at(day, F.lit(k)) for k in ("day", "month", "year")}

    def person(at: str) -> dict[str, str]:
        return (
            {k: f"{at}.name.{k}" for k in ("prefix", "given_name", "surname", "suffix")}
            | {f"birth_{k}": f"{at}.birth.date.{k}" for k in ("day", "month", "year")}
            | {f"birth_{k}": f"{at}.birth.place.{k}" for k in ("city", "county", "state", "country")}
        )

    own = person("$.person") | {k: f"$.person.{k}" for k in ("age", "gender", "race")} | {k: f"$.{k}" for k in ("petition_number", "mode_of_travel", "vessel", "has_photo")}
    for name, at in (("marriage", "marriage.date"), ("arrival", "arrival_date"), ("departure", "departure_date")):
        own |= {f"{name}_{k}": f"$.{at}.{k}" for k in ("day", "month", "year")}
    for name, at in (("marriage", "marriage.place"), ("immigration", "immigration_place")):
        own |= {f"{name}_{k}": f"$.{at}.{k}" for k in ("city", "county", "state", "country")}

    def record(text: Column, paths: dict[str, str], role: Column) -> Column:
        pairs = [x for k, v in base.items() for x in (F.lit(k), v)] + [x for k, at in paths.items() for x in (F.lit(k), F.get_json_object(text, at))]
        return F.struct(role.alias("role"), event["event_type"].alias("event_type"), _clean(F.create_map(*pairs)).alias("fields"))

    def both(text: Column) -> Column:
        role = _role_or_self(F.coalesce(F.get_json_object(text, "$.record_role"), F.get_json_object(text, "$.role")))
        spouse = record(text, person("$.spouse.person"), F.lit("spouse"))
        told = F.exists(F.map_keys(spouse["fields"]), lambda k: k.isin("birth_city", "birth_year", "surname", "given_name"))
        first = F.array(record(text, own, role))
        return F.when((role == "self") & told, F.concat(first, F.array(spouse))).otherwise(first)

    return F.flatten(F.transform(F.coalesce(event["records"], F.array().cast("array<string>")), both))


def _role_or_self(value: Column) -> Column:
    from ..functions.text import role

    return role(value)


def extractions(rows: DataFrame) -> DataFrame:
    """Extractions from (source, value) rows of JSON objects; rows without an image name or a position are an error."""
    own, parsed = c("value"), F.get_json_object("value", "$.parsed_response")
    payload = F.when(F.ltrim(parsed).startswith("{"), parsed).otherwise(own)
    x = rows.select("source", "value", payload.alias("payload"), F.from_json("value", _NAMES).alias("o")).withColumn("p", F.from_json("payload", _PAYLOAD))
    named = lambda *names: F.coalesce(*(F.nullif(n, F.lit("")) for n in names))
    raw = named(c("o.source_filename"), c("p.source_filename"), c("o.image_stem"), c("o.image_id"), c("o.filename"))
    flat = F.transform("p.records", lambda r: F.struct(_role_or_self(F.coalesce(r["role"], r["record_role"])).alias("role"), r["event_type"].alias("event_type"), _clean(r["fields"]).alias("fields")))
    nested = F.flatten(F.transform(c("p.events"), _flatten))
    series, index = series_and_index(c("image_id"))
    # only JSON numbers (and truth values, as 1 and 0) are qualities; text that looks like a number is none
    told = F.nullif(F.get_json_object("payload", "$.quality"), F.lit("{}"))
    quality = F.try_parse_json(F.coalesce(told, F.get_json_object("value", "$.quality"))).try_cast("map<string,variant>")
    number = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.lit(None).cast("double")).otherwise(F.coalesce(F.try_variant_get(v, "$", "double"), F.try_variant_get(v, "$", "boolean").cast("double")))
    numbers = F.map_filter(F.transform_values(quality, lambda k, v: number(v)), lambda k, v: v.isNotNull())
    out = x.select(canonical_id(raw).alias("image_id"), F.coalesce(flat, nested, F.array().cast("array<struct<role:string,event_type:string,fields:map<string,string>>>")).alias("records"), F.coalesce(numbers, F.create_map().cast("map<string,double>")).alias("quality"), "source", (F.trim("value") != "").alias("_object"))
    out = out.select("image_id", series.alias("sequence_key"), index.alias("sequence_index"), "records", "quality", "source", "_object")
    # a filter on image_id may be evaluated before the one that drops blank lines, so these must not count as errors
    return _checked(out, c("_object") & c("sequence_index").isNull(), "an extraction has no image name with a position").drop("_object")


def read_evidence(rows: DataFrame) -> DataFrame:
    """(image_a, image_b, same_scene_probability, occlusion_probability, relation) under any of the known column names."""
    have = set(rows.columns)
    first_of = lambda kind, *names: F.coalesce(*[F.nullif(c(n).cast("string"), F.lit("")) for n in names if n in have], F.lit(None)).cast(kind)
    a, b = canonical_id(first_of("string", "first_image_id", "image_a")), canonical_id(first_of("string", "second_image_id", "image_b"))
    return rows.select(
        F.least(a, b).alias("image_a"), F.greatest(a, b).alias("image_b"),
        first_of("double", "same_document_probability", "same_scene_probability", "same_probability").alias("same_scene_probability"),
        first_of("double", "occluded_given_same_probability", "same_occluded_probability", "occlusion_probability").alias("occlusion_probability"),
        first_of("string", "relation", "branch").alias("relation"),
    ).where("image_a is not null and image_b is not null")


def add_quality(items: DataFrame, quality: DataFrame) -> DataFrame:
    """Extractions with the entries of (image_id, quality) laid over their own."""
    given = quality.select("image_id", c("quality").alias("_q"))
    merged = F.map_concat(F.map_filter("quality", lambda k, v: ~F.coalesce(F.array_contains(F.map_keys("_q"), k), F.lit(False))), F.coalesce("_q", F.create_map().cast("map<string,double>")))
    return items.join(given, "image_id", "left").withColumn("quality", merged).drop("_q")


class NpzSource(DataSource):
    """Embeddings from NumPy archives: ids with a matrix, or one array for each id. ``spark.read.format("npz").load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> str:
        return "image_id string, embedding array<float>"

    def reader(self, schema) -> DataSourceReader:
        return NpzReader(self.options["path"])


class NpzReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        import glob

        return [InputPartition(p) for p in sorted(glob.glob(self.path)) or [self.path]]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import numpy as np

        with np.load(partition.value, allow_pickle=False) as data:
            ids = next((k for k in ("filenames", "image_ids") if k in data.files), None)
            pairs = zip(data[ids], data["embeddings"]) if ids and "embeddings" in data.files else ((k, data[k]) for k in data.files)
            for name, vector in pairs:
                yield str(name), [float(v) for v in np.asarray(vector, np.float32).ravel()]


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, embedding) from NPZ, Parquet or JSON lines."""
    if path.endswith(".npz"):
        spark.dataSource.register(NpzSource)
        rows = spark.read.format("npz").load(path)
    elif path.endswith((".json", ".jsonl")):
        found = json_objects(spark, path).select(F.from_json("value", "image_id string, filename string, source_filename string, embedding array<float>, vector array<float>").alias("o"))
        rows = found.select(F.coalesce("o.image_id", "o.filename", "o.source_filename").alias("image_id"), F.coalesce("o.embedding", "o.vector").alias("embedding")).where("image_id is not null and embedding is not null")
    else:
        rows = spark.read.parquet(path)
    return rows.withColumn("image_id", canonical_id(c("image_id")))


# --- reviewed truth and labels


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The reviewed manifest from CSV or JSON lines; missing columns and odd booleans are errors."""
    names = [f.split()[0] for f in schemas.MANIFEST.split(", ")]
    kinds = dict(f.split() for f in schemas.MANIFEST.split(", "))
    rows = spark.read.option("header", True).csv(path) if path.endswith(".csv") else spark.read.option("primitivesAsString", True).json(path)
    rows = rows.toDF(*(x.lstrip("﻿") for x in rows.columns))
    if missing := [n for n in names if n not in rows.columns]:
        raise ValueError(f"the manifest lacks {', '.join(missing)}")
    return rows.select(*(to_boolean(c(n)).alias(n) if kinds[n] == "boolean" else c(n).cast(kinds[n]).alias(n) for n in names))


def manifest_problems(rows: DataFrame, expected: dict[str, int]) -> DataFrame:
    """(check, expected, actual) of every count that is not as it should be; known checks: rows, groups, accepted, rejected, gaps."""
    one = rows.agg(
        F.count("*").alias("rows"), F.countDistinct("original_cluster_id").alias("groups"),
        F.countDistinct(F.when(c("review_decision") == "accepted", c("original_cluster_id"))).alias("accepted"),
        F.countDistinct(F.when(c("review_decision") == "rejected", c("original_cluster_id"))).alias("rejected"),
        (F.max("index") - F.min("index") + 1 - F.countDistinct("index")).alias("gaps"),
    )
    wanted = {"gaps": 0} | expected
    checks = F.array(*(F.struct(F.lit(k).alias("check"), F.lit(v).cast("long").alias("expected"), c(k).cast("long").alias("actual")) for k, v in wanted.items()))
    return one.select(F.explode(checks).alias("x")).select("x.*").where("expected != actual")


def read_predictions(spark: SparkSession, path: str, mapping: DataFrame | None = None) -> DataFrame:
    """Pair predictions from CSV, JSON lines, a JSON list or a result file; ``mapping`` (alias, image_id) makes ids canonical."""
    if path.endswith(".csv"):
        rows = spark.read.option("header", True).option("inferSchema", True).csv(path)
    elif path.endswith(".jsonl"):
        rows = spark.read.json(path)
    else:
        whole = spark.read.option("multiLine", True).json(path)
        rows = whole.select(F.explode("comparisons").alias("r")).select("r.*") if "comparisons" in whole.columns else whole
    if mapping is not None:
        for column in ("first_image_id", "second_image_id", "image_a", "image_b"):
            if column in rows.columns:
                rows = rows.join(mapping.toDF(column, "_id"), column, "left").withColumn(column, F.coalesce("_id", column)).drop("_id")
    return rows


def read_native_components(spark: SparkSession, path: str) -> DataFrame | None:
    """(image_id, cluster_id) of a result file that names its clusters, else null."""
    if not path.endswith(".json"):
        return None
    whole = spark.read.option("multiLine", True).json(path)
    if "clusters" not in whole.columns:
        return None
    return whole.select(F.explode("clusters").alias("c")).select(F.explode("c.image_ids").alias("image_id"), c("c.cluster_id").cast("string").alias("cluster_id"))


def match_candidates(candidates: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates with manifest ids and cluster, matched by (sequence, file stem) in lower case; and one row of counts.

    Unmatched rows, rows across groups and all but the first (by ``index``) of a repeated pair go.
    """
    identity = lambda x: F.concat_ws("/", F.lower(F.element_at(F.split(x, "/"), -2)), F.lower(stem(x)))
    ids = manifest.select(identity(c("image_id")).alias("_k"), c("image_id").alias("_id"), c("original_cluster_id").alias("_g")).distinct()
    both = candidates
    for n, column in (("1", "first_image_id"), ("2", "second_image_id")):
        both = both.withColumn("_k", identity(c(column))).join(ids.withColumnsRenamed({"_id": f"_id{n}", "_g": f"_g{n}"}), "_k", "left").drop("_k")
    known = c("_id1").isNotNull() & c("_id2").isNotNull()
    pair = F.array_sort(F.array("_id1", "_id2"))
    turn = F.row_number().over(Window.partitionBy(pair).orderBy("index"))
    kind = F.when(~known, "unmatched").when(c("_g1") != c("_g2"), "cross_group").when(turn > 1, "duplicate").otherwise("kept")
    marked = both.withColumn("_kind", kind)
    kept = marked.where("_kind = 'kept'").withColumns({"first_image_id": c("_id1"), "second_image_id": c("_id2"), "original_cluster_id": c("_g1")})
    counts = marked.agg(*(F.count_if(c("_kind") == k).alias(k) for k in ("kept", "unmatched", "cross_group", "duplicate")))
    return kept.drop("_id1", "_id2", "_g1", "_g2", "_kind"), counts


def read_cases(spark: SparkSession, path: str, overrides: str | None = None) -> DataFrame:
    """Label cases from JSON lines, blank and # lines skipped, with the upserts and deletions of a second file."""
    from ..operators.review import apply_overrides

    def lines(p: str) -> DataFrame:
        return spark.read.text(p).where((F.trim("value") != "") & ~F.ltrim("value").startswith("#"))

    cases = lines(path).select(F.from_json("value", schemas.CASES).alias("o")).select("o.*")
    if overrides is None:
        return cases
    numbered = lines(overrides).withColumn("line", F.monotonically_increasing_id())
    given = numbered.select(F.from_json("value", schemas.CASES + ", delete_case_id string").alias("o"), "line").select("o.*", "line")
    given = given.withColumns({"delete": c("delete_case_id").isNotNull(), "case_id": F.coalesce("case_id", "delete_case_id")}).drop("delete_case_id")
    return apply_overrides(cases, given)


def read_subtypes(spark: SparkSession, path: str, allowed: Sequence[str]) -> DataFrame:
    """The subtype sidecar; a repeated id or an unknown subtype is an error."""
    rows = spark.read.option("header", True).csv(path)
    times = F.count("*").over(Window.partitionBy("original_cluster_id"))
    out = _checked(rows.withColumn("_n", times), c("_n") > 1, "a cluster has two subtypes").drop("_n")
    return _checked(out, c("occlusion_subtype").isNotNull() & ~c("occlusion_subtype").isin(*allowed), "unknown subtype")
