"""Decision logs, replays, pooled fits, components and extraction payloads, with results worked out by hand."""

import random

import pytest
from pyspark.sql import functions as F

from folioweave.operators import components, evaluate, graph, ranks, review
from folioweave.sources import readers

MEMBERS = [(f"c{n}", f"c{n}i{k}", k) for n in (1, 2, 3, 4) for k in range(n)]
EVENTS = "cluster_id string, seq int, action string, image_id string, included boolean, restored_status string, restored_excluded array<string>"


def states(spark, *events):
    members = spark.createDataFrame(MEMBERS, "cluster_id string, image_id string, sequence_index int")
    rows = [(k, i, action, image, into, status, out) for i, (k, action, image, into, status, out) in enumerate(events)]
    log = spark.createDataFrame(rows, EVENTS)
    found = {r["cluster_id"]: (r["status"], sorted(r["excluded"])) for r in review.folded(members, log).collect()}
    return found, members, log


def change(cluster, image, into):
    return (cluster, "membership", image, into, None, None)


def whole(cluster, action):
    return (cluster, action, None, None, None, None)


def test_losing_a_member_dissolves_a_pair_and_edits_a_triple(spark):
    found, *_ = states(spark, change("c2", "c2i0", False), change("c3", "c3i2", False), change("c4", "c4i0", False), change("c4", "c4i0", True))
    assert found == {"c1": ("unreviewed", []), "c2": ("dissolved", ["c2i0"]), "c3": ("edited", ["c3i2"]), "c4": ("edited", [])}


def test_a_member_put_back_restores_a_pair_as_edited(spark):
    found, *_ = states(spark, change("c2", "c2i0", False), change("c2", "c2i0", True))
    assert found["c2"] == ("edited", [])


def test_irregular_and_approved_clusters_stay_so_where_nobody_is_excluded(spark):
    found, members, log = states(spark, whole("c3", "irregular"), change("c3", "c3i1", True), whole("c4", "approve"), change("c4", "c4i1", True), whole("c2", "irregular"), change("c2", "c2i1", False))
    assert found == {"c1": ("unreviewed", []), "c2": ("dissolved", ["c2i1"]), "c3": ("irregular", []), "c4": ("approved", [])}
    assert {r["cluster_id"] for r in review.exclusions(members, log).collect()} == {"c3"}


def test_irregular_keeps_exclusions_and_a_later_change_edits(spark):
    found, *_ = states(spark, change("c4", "c4i0", False), change("c4", "c4i1", False), whole("c4", "irregular"), change("c4", "c4i0", True), change("c3", "c3i0", False), whole("c3", "irregular"))
    assert found["c4"] == ("edited", ["c4i1"]) and found["c3"] == ("irregular", ["c3i0"])


def test_dissolve_reopen_and_restore(spark):
    found, *_ = states(
        spark, whole("c4", "dissolve"), whole("c3", "dissolve"), whole("c3", "reopen"), ("c2", "restore", None, None, "edited", ["c2i1", "unknown"]), change("c1", "nobody", False)
    )
    assert found == {"c1": ("unreviewed", []), "c2": ("edited", ["c2i1"]), "c3": ("unreviewed", []), "c4": ("dissolved", ["c4i0", "c4i1", "c4i2", "c4i3"])}
    with pytest.raises(Exception, match="unknown cluster status"):
        states(spark, ("c2", "restore", None, None, "odd", []))


def test_separated_images_are_numbered_over_all_clusters(spark):
    _, members, log = states(spark, whole("c2", "dissolve"), change("c4", "c4i3", False), whole("c3", "irregular"))
    out = {r["cluster_id"]: (r["origin_cluster_id"], r["image_ids"]) for r in review.corrected_clusters(members, log).collect()}
    assert out == {
        "c1": ("c1", ["c1i0"]), "c4": ("c4", ["c4i0", "c4i1", "c4i2"]),
        "c2__separated_00001": ("c2", ["c2i0"]), "c2__separated_00002": ("c2", ["c2i1"]), "c4__separated_00003": ("c4", ["c4i3"]),
    }


def test_boxes_are_checked_approved_and_queued(spark):
    boxes = [("a", [0.0, 0.0, 10.4, 9.6]), ("b", [0.0, 0.0, 10.0]), ("c", [-1.0, 0.0, 5.0, 5.0]), ("d", [5.0, 5.0, 5.2, 9.0]), ("e", [0.0, 0.0, 11.0, 5.0]), ("f", None)]
    rows = spark.createDataFrame(boxes, "k string, box array<double>").select("k", review.box_problem(F.col("box"), F.lit(10), F.lit(10)).alias("p")).collect()
    assert {r["k"]: r["p"] for r in rows} == {
        "a": None, "b": "a box needs four numbers", "c": "a box starts outside the image", "d": "a box is empty", "e": "a box ends outside the image", "f": "a box needs four numbers",
    }
    proposed = spark.createDataFrame([("x", "p"), ("y", "p")], "image_id string, boxes string")
    log = spark.createDataFrame([("x", 1, "set", "q"), ("x", 2, "approve", None), ("x", 3, "unapprove", None)], "image_id string, seq int, action string, boxes string")
    done = review.final_boxes(proposed, review.approve_remaining_boxes(proposed, log)).collect()
    assert {r["image_id"]: (r["boxes"], r["bbox_status"]) for r in done} == {"x": ("q", "edited"), "y": ("p", "approved")}
    clusters = spark.createDataFrame([("k1", ["a", "b"]), ("k2", ["c", "d"]), ("k3", ["e"])], "cluster_id string, image_ids array<string>")
    pairs = spark.createDataFrame([("a", "b", True, 0.9, 1, "affine"), ("c", "d", True, 0.6, 2, "affine"), ("a", "c", True, 0.1, 1, "x")], "first_image_id string, second_image_id string, same_document boolean, confidence double, index_gap int, registration_model string")
    queue = {r["cluster_id"]: (r["queue_position"], r["confidence_min"]) for r in review.confidence_queue(clusters, pairs).collect()}
    assert queue == {"k2": (1, 0.6), "k1": (2, 0.9), "k3": (3, None)}


def replay(spark, rows, configs):
    schema = "original_cluster_id int, first_image_id string, second_image_id string, p double, index_gap int, registration_alignment_score double"
    pairs = spark.createDataFrame(rows, schema).withColumns({"deterministic_same_document": F.lit(True), "automatic_link_eligible": F.lit(True), "hard_contradiction": F.lit(False)})
    groups = spark.createDataFrame([(1, "accepted", ["a", "b", "c"]), (2, "rejected", ["d", "e"]), (3, "accepted", ["f", "g"])], "original_cluster_id int, review_decision string, image_ids array<string>")
    return evaluate.replay_metrics(pairs, groups, configs, "p")


ROWS = [(1, "a", "b", 0.9, 1, 0.5), (1, "b", "c", 0.8, 2, None), (2, "d", "e", 0.6, 1, 0.9), (3, "f", "g", 0.7, 1, 0.1)]


def test_replay_counts_groups_and_pairs(spark):
    got = {(r["threshold"], r["max_gap"], r["min_alignment"]): r for r in replay(spark, ROWS, [(0.65, None, None), (0.5, None, None), (0.65, 1, None), (0.65, None, 0.2)]).collect()}
    loose = got[0.65, None, None]
    assert (loose["accepted_groups_recovered"], loose["rejected_groups_separated"], loose["positive_pairs"], loose["positive_pairs_connected"]) == (2, 1, 4, 4)
    assert loose["zero_false_links"] and loose["perfect_group_fit"] and loose["automatic_edge_tp"] == 3
    wrong = got[0.5, None, None]
    assert (wrong["automatic_edge_fp"], wrong["negative_pairs_connected"], wrong["zero_false_links"]) == (1, 1, False)
    assert got[0.65, 1, None]["positive_pairs_connected"] == 2 and got[0.65, None, 0.2]["automatic_edge_tp"] == 1


def test_best_replay_prefers_safety_then_groups_then_open_gates_then_the_higher_threshold(spark):
    best = lambda configs, rows=ROWS: evaluate.best_replay(replay(spark, rows, configs)).first()
    assert best([(0.5, None, None), (0.65, None, None), (0.75, None, None)])["threshold"] == 0.65
    assert best([(0.62, None, None), (0.65, None, None), (0.65, 5, None)])["threshold"] == 0.65
    assert best([(0.65, 5, None), (0.62, None, None)])["max_gap"] is None
    # no safe one: the fewest false edges, not the most true ones
    never = [*ROWS, (2, "d", "e", 0.95, 1, 0.9)]
    assert best([(0.1, None, None), (0.93, None, None)], never)["threshold"] == 0.93


def test_replayed_predictions_follow_the_gates(spark):
    rows = spark.createDataFrame([(1, 0.9, 0.5, 1, 0.5), (2, 0.9, 0.5, 9, 0.5), (3, 0.9, 0.5, None, None), (4, 0.2, 0.5, 1, 0.5)], "k int, same_document_probability double, occluded_given_same_probability double, index_gap int, registration_alignment_score double")
    rows = rows.withColumns({"deterministic_same_document": F.lit(True), "automatic_link_eligible": F.lit(True)})
    out = {r["k"]: r for r in evaluate.replayed_predictions(rows, 0.5, 3, 0.2, "same_document_probability", 0.6).collect()}
    assert [out[k]["automatic_link_eligible"] for k in (1, 2, 3, 4)] == [True, False, False, False]
    assert out[1]["same_clean_probability"] == 0.45 and not out[4]["occlusion_candidate_flag"]


@pytest.mark.parametrize("seed", range(3))
def test_isotonic_fit_by_ranges_equals_the_whole(spark, seed):
    rng = random.Random(seed)
    points = [(round(rng.random(), 3), int(rng.random() < 0.5)) for _ in range(400)]
    got = [(r["score"], r["value"]) for r in evaluate.fit_isotonic(spark.createDataFrame(points, "s double, t int"), "s", "t").orderBy("knot").collect()]
    want = evaluate.isotonic_knots((s, t, 1) for s, t in points)
    assert len(got) == len(want) and all(a == c and abs(b - d) < 1e-12 for (a, b), (c, d) in zip(got, want))


@pytest.mark.parametrize("one_task", [0, 10**6])
def test_components_by_stars_and_in_one_task(spark, one_task):
    rng = random.Random(6)
    edges = [("s", f"n{rng.randrange(90):02d}", f"n{rng.randrange(90):02d}") for _ in range(60)] + [("s", f"p{i:02d}", f"p{i + 1:02d}") for i in range(30)] + [("t", "n01", "n02"), ("s", "n01", "nobody")]
    items = [("s", f"n{i:02d}") for i in range(90)] + [("s", f"p{i:02d}") for i in range(31)] + [("t", f"n0{i}") for i in range(4)]
    got = {(r["sequence_id"], r["image_id"]): r["root"] for r in components.components(spark.createDataFrame(items, "sequence_id string, image_id string").withColumn("o", F.col("image_id")), spark.createDataFrame(edges, "sequence_id string, a string, b string"), ["sequence_id", "image_id"], "o", one_task).collect()}
    root = {x: x for x in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for s, a, b in edges:
        if (s, a) in root and (s, b) in root:
            x, y = sorted((find((s, a)), find((s, b))))
            root[y] = x
    assert got == {x: find(x)[1] for x in items}


def brute_union(nodes, edges):
    """The same union with all pairs of two groups looked at."""
    group, facts = {n: {n} for n in nodes}, {frozenset(e[:2]): e[2:] for e in edges}
    for _, a, b in sorted(((e[3], e[0], e[1]) for e in edges if e[2]), key=lambda e: -e[0]):
        left, right = group[a], group[b]
        if left is right:
            continue
        bad = False
        for x in left:
            for y in right:
                f = facts.get(frozenset((x, y)))
                if f and f[2]:
                    third = any(facts.get(frozenset((x, z)), (0,) * 5)[4] and facts.get(frozenset((y, z)), (0,) * 5)[4] for z in (left | right) - {x, y})
                    bad |= not (f[3] and third)
        if not bad:
            left |= right
            for n in right:
                group[n] = left
    return {n: min(group[n]) for n in nodes}


def test_constrained_union_equals_a_look_at_all_pairs():
    rng = random.Random(8)
    for _ in range(200):
        nodes = list(range(9))
        pairs = [(a, b) for a in nodes for b in range(a + 1, 9) if rng.random() < 0.6]
        edges = [(a, b, same := rng.random() < 0.5, round(rng.random(), 3), not same and rng.random() < 0.5, rng.random() < 0.6, same and rng.random() < 0.7) for a, b in pairs]
        assert graph.union_constrained(nodes, edges) == brute_union(nodes, edges)


def test_numbering_follows_the_order_over_ranges(spark):
    rows = [(random.Random(i).random(), i) for i in range(500)]
    got = {r["i"]: r["rank"] for r in ranks.counted_before(spark.createDataFrame(rows, "x double, i int"), ["x", "i"]).collect()}
    assert got == {i: n for n, (_, i) in enumerate(sorted(rows), 1)}


def test_events_inside_a_parsed_response_give_records_and_only_numbers_are_qualities(spark):
    import json

    event = {"event_type": "Arrival", "records": [{"record_role": "self", "person": {"name": {"given_name": "Ada", "surname": "Low"}}}]}
    rows = [
        {"source_filename": "s-0001.jpg", "parsed_response": {"events": [event], "quality": {"sharp": 0.5, "text": "0.9", "ok": True, "none": None}}, "quality": {"sharp": 9}},
        {"source_filename": "s-0002.jpg", "events": [event], "quality": {"sharp": 1}},
        {"source_filename": "s-0003.jpg", "parsed_response": {"records": []}, "events": [event], "quality": {"sharp": 2.5}},
    ]
    out = readers.extractions(spark.createDataFrame([("f", json.dumps(r)) for r in rows], "source string, value string")).orderBy("sequence_index").collect()
    assert [len(r["records"]) for r in out] == [1, 1, 0]
    assert out[0]["records"][0]["fields"]["surname"] == out[1]["records"][0]["fields"]["surname"] == "Low"
    assert [r["quality"] for r in out] == [{"sharp": 0.5, "ok": 1.0}, {"sharp": 1.0}, {"sharp": 2.5}]


def test_failure_category_tells_filename_demotions_apart(spark):
    rows = spark.createDataFrame([("review only: filename prefixes differ", 1), ("review only: dirty exterior without strong registration support", 1), ("ink disagrees outside the block", 0), ("other", 0)], "reason string, truth int")
    got = rows.select(evaluate.failure_category(F.col("reason"), F.lit(True), F.lit(False), F.col("truth"), F.lit("review_only")).alias("k")).collect()
    assert [r["k"] for r in got] == ["filename_safety_demotion", "registration", "exterior_agreement", "suspicious_negative_probability"]
