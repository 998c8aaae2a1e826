"""Names, roles and similarity of strings."""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "tif", "tiff", "j2k", "jp2")
#: Ids that stand at the end of longer names.
ID_ENDINGS = (r"(63129(?:_[A-Za-z0-9]+){2}-\d+)$", r"((?i:i)\d+-\d+)$")
ROLES = dict.fromkeys(("self", "petitioner", "applicant", "principal", "primary"), "self") | {x: x for x in ("child", "spouse")}


def normal_form(value: object) -> str:
    """Lower case without accents; everything but letters and digits is one blank."""
    if value is None:
        return ""
    folded = unicodedata.normalize("NFKD", f"{value}").casefold()
    plain = "".join(ch for ch in folded if not unicodedata.combining(ch))
    return " ".join(re.findall(r"[a-z0-9]+", plain))


@F.pandas_udf(StringType())
def normalized(values: pd.Series) -> pd.Series:
    return values.map(normal_form)


def normalized_ascii(value: Column) -> Column:
    """The same as ``normalized`` for text without accents, in generated code."""
    return F.coalesce(F.trim(F.regexp_replace(F.lower(value), "[^a-z0-9]+", " ")), F.lit(""))


def similarity_of(field: str, a: object, b: object, exact: frozenset[str] = frozenset()) -> float:
    x, y = normal_form(a), normal_form(b)
    if not x or not y:
        return 0.0
    if x == y:
        return 1.0
    return 0.0 if field in exact else SequenceMatcher(None, x, y).ratio()


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similarity_of("", x, y) for x, y in zip(a, b)], dtype="float64")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def canonical_id(name: Column) -> Column:
    """Base name without image suffix and copy number, cut to a known id at its end."""
    x = F.regexp_replace(base_name(name), r"(?i)\.(" + "|".join((*IMAGE_SUFFIXES, "webp")) + ")$", "")
    x = F.regexp_replace(x, r"\(\d+\)$", "")
    found = [F.nullif(F.regexp_extract(x, ending, 1), F.lit("")) for ending in ID_ENDINGS]
    return F.coalesce(*found, x)


def series_and_index(image_id: Column) -> tuple[Column, Column]:
    """What stands before the last hyphen, and the number after it; null where there is none."""
    at = r"^(.+)-(\d+)$"
    return F.nullif(F.regexp_extract(image_id, at, 1), F.lit("")), F.try_to_number(F.regexp_extract(image_id, at, 2), F.lit("999999999999")).cast("long")


def name_position(path: Column) -> tuple[Column, Column]:
    """Prefix and final digits of a file's stem; both null without either."""
    s = stem(path)
    at = r"^(.*?)(\d+)$"
    prefix = F.nullif(F.regexp_extract(s, at, 1), F.lit(""))
    return prefix, F.when(prefix.isNotNull(), F.regexp_extract(s, at, 2).try_cast("long"))


def image_id(sequence: Column, name: Column) -> Column:
    return F.when(sequence == ".", name).otherwise(F.concat_ws("/", sequence, name))


def role(value: Column) -> Column:
    x = normalized_ascii(value)
    known = F.create_map(*(F.lit(v) for pair in ROLES.items() for v in pair))
    return F.coalesce(F.try_element_at(known, x), F.nullif(x, F.lit("")), F.lit("self"))


def to_boolean(value: Column) -> Column:
    """True, false or null for the accepted spellings; anything else is an error."""
    x = F.lower(F.trim(value.cast("string")))
    return (
        F.when(x.isin("true", "1", "yes", "y"), F.lit(True))
        .when(x.isin("false", "0", "no", "n"), F.lit(False))
        .when(x.isNull() | (x == ""), F.lit(None).cast("boolean"))
        .otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), x)).cast("boolean"))
    )


def stable_number(value: Column) -> Column:
    """The first 16 hexadecimal digits of the SHA-256, as a number."""
    return F.conv(F.substring(F.sha2(value, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def pair_id(a: Column, b: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", F.least(a, b), F.greatest(a, b)), 256), 1, 20)


def slug(value: Column) -> Column:
    """Lower case; runs of anything but letters and digits are one dash, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(value), "[^a-z0-9]+", "-"), F.lit("-"))
