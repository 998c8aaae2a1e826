import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_images import form, png

import folioweave
from folioweave.functions import geometry, text
from folioweave.operators import pages
from folioweave.sources import readers

c = F.col


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def test_slugs(spark):
    assert [value(spark, text.slug(F.lit(x))) for x in ("A b/C", "--x__9--", "")] == ["a-b-c", "x-9", ""]


def test_inverse_and_areas(spark):
    m = np.array([[1.1, 0.2, 5], [-0.1, 0.9, 3], [1e-3, 0, 1]])
    matrix = F.array(*(F.array(*map(F.lit, map(float, r))) for r in m))
    assert np.allclose(value(spark, geometry.inverse(matrix)), np.linalg.inv(m))
    assert value(spark, geometry.inverse(F.array(*[F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))] * 3))) is None
    points = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0, 0), (4, 0), (4, 3), (0, 3))))
    assert value(spark, geometry.polygon_area(points)) == 12.0
    b = geometry.to_source(geometry.box(*map(F.lit, (1, 2, 30, 41))), F.lit(0.5), F.lit(55), F.lit(90))
    assert tuple(value(spark, b)) == (2, 4, 55, 82)


def test_lowest_and_upper_tail(spark):
    rng = np.random.default_rng(0)
    rows = [(g, float(v), i) for g in "ab" for i, v in enumerate(rng.integers(0, 9, 37 if g == "a" else 2))]
    df = spark.createDataFrame(rows, "g string, v double, i int")
    got = {(r["g"], r["i"]) for r in pages.lowest(df, "g", "v", "i", 5).collect()}
    assert got == {(g, i) for g in "ab" for _, i in sorted((v, i) for h, v, i in rows if h == g)[:5]}
    for r in pages.upper_tail(df, "g", "v", 0.2).collect():
        mine = np.sort([v for g, v, _ in rows if g == r["g"]])
        assert r["upper_tail"] == pytest.approx(mine[-max(1, round(0.2 * len(mine))) :].mean())
        assert (r["p50"], r["p95"]) == (pytest.approx(np.percentile(mine, 50)), pytest.approx(np.percentile(mine, 95)))


def test_inventory_of_files_with_their_faults(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(form()))
    (tmp_path / "b.png").write_bytes(b"no image")
    (tmp_path / "note.txt").write_bytes(b"x")
    got = {r["path"].rsplit("/", 1)[1]: r for r in readers.file_inventory(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.png", "b.png"}
    assert (got["a.png"]["width"], got["a.png"]["height"], got["a.png"]["channels"], got["a.png"]["error"]) == (420, 600, 1, None)
    assert got["b.png"]["width"] is None and got["b.png"]["error"]


def test_native_components_of_result_files(spark, tmp_path):
    path = tmp_path / "result.json"
    path.write_text(json.dumps({"clusters": [{"cluster_id": "1", "image_ids": ["a", "b"]}], "comparisons": [{"first_image_id": "a", "second_image_id": "b"}]}))
    assert {tuple(r) for r in readers.read_native_components(spark, str(path)).collect()} == {("a", "1"), ("b", "1")}
    path.write_text(json.dumps({"comparisons": [{"first_image_id": "a", "second_image_id": "b"}]}))
    assert readers.read_native_components(spark, str(path)) is None and readers.read_native_components(spark, "x.csv") is None


def test_package_exports_its_entry_points():
    assert folioweave.cluster_directory is not None and "crop_result" in dir(folioweave)
    with pytest.raises(AttributeError):
        folioweave.nothing
