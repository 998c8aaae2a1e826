import random

import pytest
from pyspark.sql import functions as F

from folioweave.operators import graph, pairs
from folioweave.plans import captures

#: (a, b, accepted, confidence, blocks, bridgeable, bridge)
EDGE = lambda a, b, conf=0.9, bridge=False: (a, b, True, conf, False, False, bridge)
WALL = lambda a, b, bridgeable=False: (a, b, False, 0.1, True, bridgeable, False)


def groups(nodes, edges, **more):
    roots = graph.union_constrained(nodes, edges, **more)
    return sorted(sorted(n for n in nodes if roots[n] == r) for r in set(roots.values()))


def test_contradiction_blocks_a_bridge():
    assert groups("abc", [EDGE("a", "b"), EDGE("b", "c", 0.8)]) == [["a", "b", "c"]]
    assert groups("abc", [EDGE("a", "b"), EDGE("b", "c", 0.8), WALL("a", "c")]) == [["a", "b"], ["c"]]
    assert groups("abc", [EDGE("a", "b", 0.7), EDGE("b", "c", 0.8), WALL("a", "c")]) == [["a"], ["b", "c"]]


def test_two_localised_occlusions_explain_a_contradiction():
    assert groups("abc", [EDGE("a", "b", bridge=True), EDGE("b", "c", bridge=True), WALL("a", "c", True)]) == [["a", "b", "c"]]
    assert groups("abc", [EDGE("a", "b", bridge=True), EDGE("b", "c"), WALL("a", "c", True)]) == [["a", "b"], ["c"]]
    assert groups("abc", [EDGE("a", "b", bridge=True), EDGE("b", "c", bridge=True), WALL("a", "c")]) == [["a", "b"], ["c"]]


def test_size_cap_and_singletons():
    assert groups("abcd", [EDGE("a", "b"), EDGE("b", "c", 0.8)], max_size=2) == [["a", "b"], ["c"], ["d"]]


@pytest.mark.parametrize("seed", range(8))
def test_no_unexplained_contradiction_inside_a_group(seed):
    rng = random.Random(seed)
    nodes = list(range(14))
    edges = []
    for i in nodes:
        for j in range(i + 1, min(i + 4, 14)):
            wall = rng.random() < 0.3
            edges.append((i, j, not wall and rng.random() < 0.7, rng.random(), wall, rng.random() < 0.5, rng.random() < 0.5))
    roots = graph.union_constrained(nodes, edges)
    known = {(a, b): e for a, b, *e in edges}
    strong = lambda x, y: known.get((min(x, y), max(x, y)), [0] * 5)[4]
    for (a, b), (_, _, blocks, bridgeable, _) in known.items():
        if blocks and roots[a] == roots[b]:
            assert bridgeable and any(roots[z] == roots[a] and strong(a, z) and strong(b, z) for z in nodes if z not in (a, b))


def test_neighbours_and_index_pairs_agree(spark):
    items = spark.createDataFrame([(s, i, 10 * s + i) for s in range(3) for i in range(7)], "s int, i int, k int")
    by_place = {tuple(r) for r in pairs.neighbour_pairs(items, "s", ["i"], ["k"], 3).selectExpr("s", "a.k", "b.k", "gap").collect()}
    by_index = {tuple(r) for r in pairs.index_pairs(items, "s", "i", "k", 3).collect()}
    assert by_place == by_index and len(by_place) == 3 * (6 + 5 + 4)
    twins = spark.createDataFrame([(1, 5, 1), (1, 5, 2), (1, 9, 3)], "s int, i int, k int")
    assert {tuple(r) for r in pairs.index_pairs(twins, "s", "i", "k", 3).collect()} == {(1, 1, 2, 0)}


def test_islands(spark):
    rows = spark.createDataFrame([(1, i, i in (0, 1, 3, 6, 7)) for i in range(9)], "g int, i int, on boolean")
    assert sorted((r["first"], r["last"], r["n"]) for r in pairs.islands(rows, "g", "i", "on", 1).collect()) == [(0, 3, 3), (6, 7, 2)]


def test_transforms_follow_the_first_path():
    import pandas as pd

    move = lambda dx: [1.0, 0, dx, 0, 1, 0, 0, 0, 1]
    out = graph.transforms_to_anchor(pd.DataFrame({"a": [1, 3], "b": [2, 2], "m": [move(5), move(2)]}), 1)
    assert out[2][0, 2] == 5 and out[3][0, 2] == 3


@pytest.mark.parametrize("block", [4, 50_000])
def test_neighbours_equal_a_loop_whatever_the_blocks(spark, monkeypatch, block):
    """One sequence holds most rows; there are short ones, one without a name, and ties in the order."""
    monkeypatch.setattr(pairs, "BLOCK", block)
    rows = [("hot" if i % 3 else None if i % 2 else f"s{i % 15}", i // 2, i) for i in range(90)]
    items = spark.createDataFrame(rows, "s string, o int, k int").repartition(7)
    by: dict = {}
    for s, o, k in sorted(rows, key=lambda r: (r[1], r[2])):
        by.setdefault(s, []).append(k)
    got = {(r["s"], r["a"]["k"], r["b"]["k"], r["gap"]) for r in pairs.neighbour_pairs(items, "s", ["o", "k"], ["k"], 3).collect()}
    assert got == {(s, v[i], v[j], j - i) for s, v in by.items() for i in range(len(v)) for j in range(i + 1, min(i + 4, len(v)))}
    index = {(r["s"], r["k"]): r["sequence_index"] for r in pairs.sequence_index(items, "s", ["o", "k"]).collect()}
    assert index == {(s, k): i for s, v in by.items() for i, k in enumerate(v)}
    assert pairs.neighbour_pairs(items.limit(0), "s", ["o"], ["k"]).count() == 0


def test_equal_confidences_tie_in_whatever_order_they_come(spark):
    """Added in the order of rows, the same three confidences differ in the last bit, and the later member would win."""
    x, y, z = 0.2849, 0.49, 0.35
    assert x + y + z != z + y + x
    rows = [(1, 3, x), (1, 4, y), (1, 5, z), (2, 6, z), (2, 7, y), (2, 8, x)]
    members = spark.createDataFrame([("s", i, i, 1) for i in range(1, 9)], "sequence_id string, image_id int, sequence_index int, root int")
    for order in (rows, rows[::-1]):
        linked = spark.createDataFrame([("s", *r, True) for r in order], "sequence_id string, first_image_id int, second_image_id int, confidence double, same_document boolean").coalesce(1)
        assert [r["representative"] for r in graph.representatives(members, linked).collect()] == [1]


def test_groups_of_many_components_in_small_batches_run_once(spark):
    """The groups equal those of a loop, although batches end inside components, and no later step runs the union again."""
    rng = random.Random(5)
    rows = []
    for s in "xyz":
        for i in range(30):
            for j in range(i + 1, min(i + 4, 30)):
                wall = rng.random() < 0.3
                rows.append((s, i, j, j - i, not wall and rng.random() < 0.4, rng.random(), wall))
    found = spark.createDataFrame(rows, "sequence_id string, first_image_id int, second_image_id int, index_gap int, same_document boolean, confidence double, hard_contradiction boolean")
    measures = ("unmatched_ink_union_fraction", "ink_mismatch_tiles_fraction", "residual_tiles_changed_fraction", "valid_fraction", "feature_overlap", "changed_fraction", "occlusion_area_fraction", "occlusion_residual_capture", "occlusion_material_fraction",
                "occlusion_material_median", "outside_unmatched_ink_union_fraction", "outside_ink_mismatch_tiles_fraction", "inside_unmatched_ink_union_fraction", "occlusion_evidence", "occlusion_ink_mismatch_capture", "occlusion_localization_contrast")
    found = found.withColumns({m: F.lit(0.0) for m in measures} | {n: F.lit(0) for n in ("occlusion_candidate_count", "full_page_occlusion_count")})
    found = found.withColumns({"registration_model": F.lit("affine"), "branch": F.lit("near_duplicate"), "automatic_link_eligible": F.lit(True)})
    items = spark.createDataFrame([(s, i, i) for s in "xyz" for i in range(30)], "sequence_id string, image_id int, sequence_index int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        members = graph.constrained_groups(items, found)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for s in "xyz":
        roots = graph.union_constrained(list(range(30)), [(a, b, same, confidence, wall, False, False) for q, a, b, _, same, confidence, wall in rows if q == s])
        want |= {(s, n): r for n, r in roots.items()}
    assert {(r["sequence_id"], r["image_id"]): r["root"] for r in members.collect()} == want
    plan = members._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan and "InArrow" not in plan


def test_measurements_of_one_block_are_spread_over_tasks(spark):
    rows = captures.pairs(spark, "/root/testdata/sf0.001").select(F.spark_partition_id().alias("task")).distinct().count()
    assert rows > 1
