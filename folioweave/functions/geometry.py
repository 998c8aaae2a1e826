"""Boxes as structs of x0, y0, x1, y1, and 3x3 transforms as arrays of rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def area(b: Column) -> Column:
    return F.greatest(F.lit(0), b["x1"] - b["x0"]) * F.greatest(F.lit(0), b["y1"] - b["y0"])


def intersection(a: Column, b: Column) -> Column:
    """The common box; its area is 0 where there is none."""
    return box(F.greatest(a["x0"], b["x0"]), F.greatest(a["y0"], b["y0"]), F.least(a["x1"], b["x1"]), F.least(a["y1"], b["y1"]))


def hull(a: Column, b: Column) -> Column:
    return box(F.least(a["x0"], b["x0"]), F.least(a["y0"], b["y0"]), F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"]))


def iou(a: Column, b: Column) -> Column:
    common = area(intersection(a, b))
    either = area(a) + area(b) - common
    return F.when(either > 0, common / either).otherwise(F.lit(0.0))


def apply_transform(m: Column, x: Column, y: Column) -> tuple[Column, Column]:
    at = lambda i, j: F.get(F.get(m, F.lit(i)), F.lit(j))
    w = at(2, 0) * x + at(2, 1) * y + at(2, 2)
    return (at(0, 0) * x + at(0, 1) * y + at(0, 2)) / w, (at(1, 0) * x + at(1, 1) * y + at(1, 2)) / w


def transform_box(m: Column, b: Column, width: Column, height: Column) -> Column:
    """The box around the four moved corners, rounded outwards and kept inside the image."""
    xs, ys = zip(*(apply_transform(m, b[i], b[j]) for i in ("x0", "x1") for j in ("y0", "y1")))
    inside = lambda v, most: F.greatest(F.lit(0), F.least(most, v)).cast("int")
    return box(
        inside(F.floor(F.least(*xs)), width), inside(F.floor(F.least(*ys)), height),
        inside(F.ceil(F.greatest(*xs)), width), inside(F.ceil(F.greatest(*ys)), height),
    )


def multiply(a: Column, b: Column) -> Column:
    at = lambda m, i, j: F.get(F.get(m, F.lit(i)), F.lit(j))
    return F.array(*(F.array(*(at(a, i, 0) * at(b, 0, j) + at(a, i, 1) * at(b, 1, j) + at(a, i, 2) * at(b, 2, j) for j in range(3))) for i in range(3)))


def inverse(m: Column) -> Column:
    """The inverse of a 3x3 transform by cofactors; null where there is none."""
    at = lambda i, j: F.get(F.get(m, F.lit(i % 3)), F.lit(j % 3))
    cofactor = lambda i, j: at(i + 1, j + 1) * at(i + 2, j + 2) - at(i + 1, j + 2) * at(i + 2, j + 1)
    whole = at(0, 0) * cofactor(0, 0) + at(0, 1) * cofactor(0, 1) + at(0, 2) * cofactor(0, 2)
    return F.when(whole != 0, F.array(*(F.array(*(cofactor(j, i) / whole for j in range(3))) for i in range(3))))


def polygon_area(points: Column) -> Column:
    """The area of an array of structs x, y in order around the polygon."""
    ahead = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    crossed = F.zip_with(points, ahead, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.abs(F.aggregate(crossed, F.lit(0.0), lambda s, v: s + v.cast("double"))) / 2


def to_source(b: Column, scale: Column, width: Column, height: Column) -> Column:
    """A box in working pixels as one in the source image, rounded half to even and kept inside it."""
    at = lambda name: F.rint(b[name] / scale).cast("int")
    return box(F.greatest(F.lit(0), at("x0")), F.greatest(F.lit(0), at("y0")), F.least(width, at("x1")), F.least(height, at("y1")))


def box_problem(b: Column, width: Column, height: Column) -> Column:
    """Why a box is refused, or null."""
    return (
        F.when((b["x1"] <= b["x0"]) | (b["y1"] <= b["y0"]), F.lit("box without area"))
        .when((b["x0"] < 0) | (b["y0"] < 0) | (b["x1"] > width) | (b["y1"] > height), F.lit("box outside the image"))
    )
