import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioweave.functions import text
from folioweave.operators import linkage
from folioweave.sources import readers, writers
from folioweave.streaming import bands

c = F.col


def extraction(name, fields, quality=None, event="Petition", spouse=None):
    records = [{"role": "self", "event_type": event, "fields": fields}] + ([{"role": "spouse", "event_type": event, "fields": spouse}] if spouse else [])
    return {"source_filename": f"{name}.jpg", "records": records, "quality": quality or {}}


FULL = {"given_name": "José", "surname": "Alvarez", "petition_number": "123", "birth_year": "1888", "birth_city": "Lima", "vessel": "Aurora"}


@pytest.fixture
def items(spark, tmp_path):
    rows = [
        extraction("i0001-0001", FULL, spouse={"given_name": "Ana", "surname": "Alvarez"}),
        extraction("i0001-0002", {k: FULL[k] for k in ("given_name", "surname", "petition_number")}, {"occlusion_risk": 0.9}),
        extraction("i0001-0003", {"given_name": "Otto", "surname": "Klein", "petition_number": "777", "birth_year": "1901"}),
        extraction("i0002-0001", FULL),
    ]
    path = tmp_path / "x.jsonl"
    path.write_text("\n".join(map(json.dumps, rows)) + "\n\n")
    return readers.read_extractions(spark, str(path))


def test_links_roles_and_groups(items):
    links = linkage.link_pairs(items).cache()
    by = {(r["image_a"], r["image_b"]): r for r in links.collect()}
    assert set(by) == {("i0001-0001", "i0001-0002"), ("i0001-0001", "i0001-0003"), ("i0001-0002", "i0001-0003")}
    same = by["i0001-0001", "i0001-0002"]
    assert same["link_tier"] == "automatic" and same["likely_occluded_image_id"] == "i0001-0002" and same["possible_occlusion_event"]
    assert all(by[k]["link_tier"] == "rejected" for k in by if "i0001-0003" in k)
    (group,) = linkage.link_groups(items, links).collect()
    assert group["image_ids"] == ["i0001-0001", "i0001-0002"] and group["canonical_image_id"] == "i0001-0001"
    flags = {r["image_id"]: r for r in linkage.image_flags(items, links).collect()}
    assert flags["i0001-0002"]["possible_occluded_view"] and flags["i0001-0003"]["linked_image_ids"] == []


def test_missing_evidence_shrinks_the_denominator(items, spark):
    plain = {r["image_b"]: r["same_document_score"] for r in linkage.link_pairs(items).where("image_a = 'i0001-0001'").collect()}
    none = spark.createDataFrame([], "image_a string, image_b string, same_scene_probability double, occlusion_probability double, relation string")
    assert plain == {r["image_b"]: r["same_document_score"] for r in linkage.link_pairs(items, evidence=none).where("image_a = 'i0001-0001'").collect()}
    low = spark.createDataFrame([("i0001-0002", "i0001-0001", 0.0, None, None)], none.schema)
    got = {r["image_b"]: r["same_document_score"] for r in linkage.link_pairs(items, evidence=low).where("image_a = 'i0001-0001'").collect()}
    assert got["i0001-0002"] < plain["i0001-0002"] and got["i0001-0003"] == plain["i0001-0003"]


def test_mass_and_completeness(items):
    row = items.where("image_id = 'i0001-0003'").select(linkage.field_mass(c("records")).alias("m"), linkage.completeness(c("records"), c("quality")).alias("k")).first()
    mass = 1.5 + 2.25 + 3.0 + 1.1
    assert abs(row["m"] - mass) < 1e-12
    assert abs(row["k"] - (0.58 * (1 - math.exp(-mass / 12)) + 0.17 * (1 - math.exp(-1 / 3)) + 0.125)) < 1e-12


def test_consensus_takes_the_first_of_equals_in_its_longest_spelling():
    r = lambda **f: {"role": "self", "event_type": None, "fields": f}
    assert linkage.consensus([r(a="X"), r(a="Y"), r(a="x."), r(a="y")])["fields"] == {"a": "x."}
    runs = [[r(surname="Alvarez", birth_year="1888")], [r(surname="ALVAREZ", birth_year="1888", given_name="J")], [r(surname="Klein")]]
    merged = linkage.merge_record_lists(runs)
    assert [x["fields"].get("given_name") for x in merged] == ["J", None] and merged[0]["fields"]["surname"] == "Alvarez"


def test_event_shaped_extractions(spark, tmp_path):
    record = {"record_role": "Petitioner", "petition_number": "9", "person": {"name": {"given_name": "Ivo", "surname": "Ban"}, "birth": {"date": {"year": "1890"}}}, "spouse": {"person": {"name": {"given_name": "Eva"}}}}
    event = {"event_type": "Oath", "event_place": {"city": "Troy"}, "date_observations": [{"year": "1910"}, {"year": "1911"}], "records": [record]}
    path = tmp_path / "e.json"
    path.write_text(json.dumps({"items": [{"image_id": "i7-3.jpg", "events": [event]}]}))
    (got,) = readers.read_extractions(spark, str(path)).collect()
    assert (got["image_id"], got["sequence_key"], got["sequence_index"]) == ("i7-3", "i7", 3)
    first, second = got["records"]
    assert first["role"] == "self" and first["fields"] == {"event_city": "Troy", "event_year": "1910", "given_name": "Ivo", "surname": "Ban", "birth_year": "1890", "petition_number": "9"}
    assert second["role"] == "spouse" and second["fields"]["given_name"] == "Eva"


def test_names(spark):
    rows = spark.createDataFrame([("a/x_12(3).JPG",), ("63129_ab_cd-7.png",), ("deep/Scan i55-8.tif",), ("plain",)], "p string")
    got = [r[0] for r in rows.select(text.canonical_id(c("p"))).collect()]
    assert got == ["x_12", "63129_ab_cd-7", "i55-8", "plain"]
    assert text.normal_form("  Ångström--Straße ") == "angstrom strasse" and text.similarity_of("birth_year", "1888", "1889", linkage.EXACT) == 0.0
    with pytest.raises(Exception, match="not a boolean"):
        spark.createDataFrame([("maybe",)], "b string").select(text.to_boolean(c("b"))).collect()


def test_image_scan_and_embeddings(spark, tmp_path):
    for name in ("b/2.JPG", "b/1.png", "a/c/x.tif", "top.jpeg", "b/notes.txt"):
        (tmp_path / "t" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / name).write_bytes(b"x")
    got = {r["image_id"]: (r["sequence_id"], r["sequence_index"]) for r in readers.scan_images(spark, str(tmp_path / "t")).collect()}
    assert got == {"b/1.png": ("b", 0), "b/2.JPG": ("b", 1), "a/c/x.tif": ("a/c", 0), "top.jpeg": (".", 0)}
    np.savez(tmp_path / "e.npz", image_ids=np.array(["i1-1.jpg", "i1-2.jpg"]), embeddings=np.eye(2, dtype=np.float32))
    assert [(r[0], list(r[1])) for r in readers.read_embeddings(spark, str(tmp_path / "e.npz")).orderBy("image_id").collect()] == [("i1-1", [1.0, 0.0]), ("i1-2", [0.0, 1.0])]
    with pytest.raises(ValueError):
        readers.ordered_images(spark, ["x/a.jpg", "y/a.jpg"])


def test_label_file_with_overrides(spark, tmp_path):
    case = lambda i, rel: json.dumps({"case_id": i, "relation": rel, "expected_cluster": True, "images": ["b", "a"]})
    (tmp_path / "c.jsonl").write_text("# head\n\n" + "\n".join([case("1", "near_duplicate"), case("2", "near_duplicate"), case("3", "near_duplicate")]))
    (tmp_path / "o.jsonl").write_text("\n".join([case("2", "exact_duplicate"), json.dumps({"delete_case_id": "3"}), case("4", "near_duplicate"), json.dumps({"delete_case_id": "4"})]))
    got = readers.read_cases(spark, str(tmp_path / "c.jsonl"), str(tmp_path / "o.jsonl")).collect()
    assert {(r["case_id"], r["relation"]) for r in got} == {("1", "near_duplicate"), ("2", "exact_duplicate")}


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.12345678)], "b int, a double")
    writers.write_json_lines(df, str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first()[0] == '{"a":0.123457,"b":1}'
    writers.write_new(df, str(tmp_path / "n"))
    with pytest.raises(Exception, match="already exists"):
        writers.write_new(df, str(tmp_path / "n"))


def test_streamed_pairs_equal_batch_pairs(spark, tmp_path):
    rows = [("s", i, f"k{i}") for i in range(6)] + [("t", i, f"m{i}") for i in range(3)]
    for part in range(3):
        spark.createDataFrame(rows[part * 2 : part * 2 + 2] + ([rows[6 + part]]), "s string, i long, k string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    feed = spark.readStream.schema("s string, i long, k string").parquet(str(tmp_path / "in"))
    query = bands.stream_pairs(feed, "s", "i", "k", 2).writeStream.format("memory").queryName("pairs_out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {tuple(r) for r in spark.table("pairs_out").select("a", "b", "gap").collect()} >= {("k0", "k1", 1), ("k0", "k2", 2), ("m1", "m2", 1)}
