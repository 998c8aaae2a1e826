import random

import pytest
from pyspark.sql import functions as F

from folioweave.functions.numeric import interpolate
from folioweave.operators import evaluate, pages, ranks, review

c = F.col


def test_isotonic_fit_is_monotone_and_best():
    rng = random.Random(0)
    points = [(rng.randrange(20) / 20, float(rng.random() < 0.5), 1.0) for _ in range(60)]
    knots = evaluate.isotonic_knots(points)
    values = [v for _, v in knots]
    assert values == sorted(values) and all(0 <= v <= 1 for v in values)
    assert evaluate.isotonic_knots([(0.1, 1, 1), (0.2, 0, 1), (0.3, 1, 1)]) == [(0.1, 0.5), (0.2, 0.5), (0.3, 1.0)]


def test_isotonic_fit_in_spark_equals_single_points(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(30) / 30, int(rng.random() < 0.4)) for _ in range(200)] + [(None, 1)]
    got = [(r["score"], r["value"]) for r in evaluate.fit_isotonic(spark.createDataFrame(rows, "p double, t int"), "p", "t").orderBy("knot").collect()]
    single = evaluate.isotonic_knots([(p, t, 1) for p, t in rows if p is not None])
    at = lambda knots, x: spark.range(1).select(interpolate(F.lit(x), knots)).first()[0]
    assert all(abs(at(got, x / 17) - at(single, x / 17)) < 1e-12 for x in range(18))
    assert evaluate.fit_isotonic(spark.createDataFrame([], "p double, t int"), "p", "t").count() == 0


def test_splits_hold_families_together(spark):
    rows = [(i // 3, "accepted" if i % 4 else "rejected") for i in range(120)]
    groups = spark.createDataFrame(rows, "family int, truth string")
    split = evaluate.grouped_splits(groups, "family", "truth").collect()
    assert len(split) == 40 and {r["split"] for r in split} == set(evaluate.TARGETS)
    # each family goes where totals and truths then stray least, relative to their targets
    assert split == evaluate.grouped_splits(groups.repartition(3), "family", "truth").collect()
    joined = groups.selectExpr("cast(family as string) family").join(spark.createDataFrame(split), "family")
    assert evaluate.leaking_families(joined, "family").count() == 0
    with pytest.raises(ValueError):
        evaluate.assign_families({"a": {"x": 1}}, targets={"one": 0.5})


def test_missing_predictions_and_statuses(spark):
    truth = spark.createDataFrame([("b", "a", "accepted"), ("a", "c", "accepted"), ("c", "d", "rejected"), ("a", "d", "rejected")], "image_a string, image_b string, truth string")
    raw = spark.createDataFrame([("a", "b", True, False, 0.9), ("d", "c", True, True, 0.8)], "first_image_id string, second_image_id string, same_document boolean, hard_contradiction boolean, same_document_probability double")
    predictions = evaluate.normalize_predictions(raw)
    assert predictions.where("problem is not null").count() == 0
    predictions = predictions.withColumn("reason", F.lit("x"))
    parts = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("d", 1)], "image_id string, root int")
    got = {(r["image_a"], r["image_b"]): (r["pair_status"], r["reason"]) for r in evaluate.pair_rows(truth, predictions, parts).collect()}
    assert got == {("a", "b"): ("deterministically_linked", "x"), ("a", "c"): ("transitively_connected", "pair_not_compared"), ("c", "d"): ("contaminated_component", "x"), ("a", "d"): ("contaminated_component", "pair_not_compared")}


def test_incoherent_predictions_are_told(spark):
    rows = spark.createDataFrame([("a", "a", 0.5, 0.5), ("a", "b", 1.5, 0.0), ("a", "c", 0.5, 0.9), ("a", "d", 0.5, 0.5)], "image_a string, image_b string, same_document_probability double, different_document_probability double")
    problems = [r["problem"] for r in evaluate.normalize_predictions(rows).orderBy("image_b").collect()]
    assert problems == ["needs two images", "no probability", "same and different do not add up", None]


def test_ranks_equal_a_global_sort(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(50) / 49) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, p double")
    got = {r["id"]: r["rank"] for r in ranks.ranked(df, "p", [c("id")]).collect()}
    assert got == {i: n for n, (i, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1)}


def test_review_log(spark):
    members = spark.createDataFrame([(k, f"{k}{i}", i) for k in "abcdef" for i in range(2 if k < "d" else 3)], "cluster_id string, image_id string, sequence_index int")
    log = [("a", 1, "membership", "a0", False), ("b", 2, "approve", None, None), ("c", 3, "irregular", None, None), ("d", 4, "membership", "d1", False), ("e", 5, "dissolve", None, None), ("e", 6, "reopen", None, None)]
    events = spark.createDataFrame(log, "cluster_id string, seq int, action string, image_id string, included boolean")
    states = {r["cluster_id"]: (r["status"], r["kept_image_count"]) for r in review.cluster_states(members, events).collect()}
    assert states == {"a": ("dissolved", 0), "b": ("approved", 2), "c": ("irregular", 0), "d": ("edited", 2), "e": ("unreviewed", 3), "f": ("unreviewed", 3)}
    out = {tuple(r["image_ids"]) for r in review.corrected_clusters(members, events).collect()}
    assert out == {("a0",), ("a1",), ("b0", "b1"), ("d0", "d2"), ("d1",), ("e0", "e1", "e2"), ("f0", "f1", "f2")}
    assert review.exclusions(members, events).count() == 2
    again = review.approve_remaining(members, events)
    assert review.progress(members, again).first()["approved"] == 2


def test_boxes_match_greedily(spark):
    e = spark.createDataFrame([("s", 1, 0, 0, 10, 10), ("s", 2, 20, 0, 30, 10), ("t", 1, 0, 0, 5, 5)], "k string, n int, x0 int, y0 int, x1 int, y1 int")
    a = spark.createDataFrame([("s", 1, 20, 0, 30, 10), ("s", 2, 0, 0, 10, 5), ("s", 3, 50, 50, 60, 60)], "k string, n int, x0 int, y0 int, x1 int, y1 int")
    found = pages.match_boxes(e, a, ["k"])
    assert sorted(tuple(r) for r in found.collect()) == [("s", 1, 2, 0.5), ("s", 2, 1, 1.0)]
    m = pages.match_metrics(e, a, found).first()
    assert (m["missed_count"], m["false_positive_count"], m["exact"], m["mean_iou"]) == (1, 1, False, 0.75)


def test_label_cases(spark):
    from folioweave.sources import schemas

    rows = [("ok", ["a", "b"], "near_duplicate", True), ("one", ["a"], "near_duplicate", True), ("odd", ["a", "a"], "hard_negative", True)]
    cases = spark.createDataFrame([(i, im, rel, ex, 0, None, None, None, None) for i, im, rel, ex in rows], schemas.CASES)
    assert {(r["case_id"], r["problem"]) for r in review.case_problems(cases).collect()} == {("one", "fewer than two images"), ("odd", "an image twice"), ("odd", "relation and expected_cluster disagree")}
