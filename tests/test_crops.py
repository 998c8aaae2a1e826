import numpy as np
import pandas as pd
import pytest
from test_images import form, frame, png, sheet, shifted, writing

from folioweave import api
from folioweave.config import LinkConfig
from folioweave.operators import crops, images, pixels

CFG, SET = LinkConfig(), crops.CropSettings()
SAME = {0: np.eye(3), 1: np.eye(3)}


def test_ends_of_little_weight_are_left_out():
    scores, changed = np.zeros((7, 3)), np.zeros((7, 3), bool)
    changed[:, 1] = True
    scores[:, 1] = [0.11, 0.12, 0.70, 0.90, 0.75, 0.12, 0.11]
    (box, tiles), = crops.changed_parts(crops.Tiles(scores, changed, 10, (70, 30), 0.10), SET)
    assert box == (10, 20, 20, 50) and tiles.sum() == 7
    assert crops.changed_parts(crops.Tiles(scores, changed, 10, (70, 30), 0.10), SET, (0, 0, 10, 70)) == []


def test_tall_sheets_get_room_above_and_below():
    assert crops.padded_tall((55, 60, 97, 160), (50, 2, 100, 198), SET) == (55, 36, 97, 176)
    assert crops.padded_tall((55, 60, 70, 160), (50, 2, 100, 198), SET) == (55, 60, 70, 160)


def told(scores):
    """A region whose scores are told by its image's first pixel."""

    class Told(crops.Region):
        def __init__(self, image, box):
            super().__init__(image, box)
            self.detail, self.content, self.frontness, self.border = scores[int(image[0, 0])]

    return Told


def flat(*values):
    return {i: np.full((100, 100), v, np.uint8) for i, v in enumerate(values)}


def test_a_page_seen_from_behind_is_not_submitted():
    scene = crops.Scene(flat(0, 1), SAME, told(dict.fromkeys((0, 1), (0.5, 0.3, 0.4, 0.0))))
    found, chosen = crops.best_pages(scene, [("single", (0, 0, 100, 100))], [], SET)
    assert found == [] and set(chosen) == {"single"}


def test_a_strip_in_all_images_leaves_the_page_partial():
    scene = crops.Scene(flat(0, 1), SAME, told(dict.fromkeys((0, 1), (0.8, 0.4, 1.0, 0.0))))
    pages = [("single", (0, 0, 100, 100))]
    strip = [{"side": "single", "box": (5, 40, 95, 60), "confidence": 1.0}]
    (page,), _ = crops.best_pages(scene, pages, strip, SET)
    assert page["completeness"] == "partial_best_available" and page["occlusion_fraction"] == pytest.approx(0.35 * 0.18)
    (page,), _ = crops.best_pages(scene, pages, [], SET)
    assert page["completeness"] == "complete" and page["box"] == (0, 0, 100, 100)
    assert crops.best_pages(scene, pages, strip, crops.CropSettings(submit_partial=0))[0] == []


def test_both_other_states_of_a_region_are_kept():
    rng = np.random.default_rng(0)
    shown = {k: rng.integers(0, 255, (100, 100), dtype=np.uint8) for k in range(3)}
    for k, v in enumerate((40, 90, 150)):
        shown[k][0, 0] = v
    scores = {40: (0.55, 0.42, 1.0, 2.0), 90: (0.70, 0.55, 1.0, 2.0), 150: (0.85, 0.68, 1.0, 2.0)}
    scene = crops.Scene(shown, SAME | {2: np.eye(3)}, told(scores))
    pages, one = [("right", (50, 0, 100, 100))], [{"side": "right", "box": (50, 20, 100, 80), "confidence": 1.0}]
    states = crops.other_states(scene, pages, {"right": 2}, one, SET)
    assert [x["image"] for x in states] == [1, 0] and {x["kind"] for x in states} == {"data_bearing_overlay"}
    page = [{"side": "right", "completeness": "partial_best_available", "occlusion_fraction": 0.3, "reason": "r"}]
    assert crops.resolved(page, states)[0]["completeness"] == "complete" and crops.resolved(page, [])[0]["occlusion_fraction"] == 0.3
    shown[1] = shown[2].copy()
    same = crops.Scene(shown, SAME | {2: np.eye(3)}, told(scores))
    assert [x["image"] for x in crops.other_states(same, pages, {"right": 2}, one, SET)] == [0]


def test_a_group_without_submissions_gets_a_page_or_a_review():
    pages = [("single", (0, 0, 100, 100))]
    made = lambda scores: crops.fallback_pages(crops.Scene(flat(7), {0: np.eye(3)}, told({7: scores})), pages, SET)
    assert [x["completeness"] for x in made((0.2, 0.3, 0.9, 0))] == ["complete"]
    assert [x["completeness"] for x in made((0.2, 0.3, 0.1, 0))] == ["review_required"]
    assert made((0.001, 0.001, 0.9, 0)) == []


def test_overlapping_candidates_leave_the_surest():
    a, b, d = ({"side": s, "box": x, "confidence": p} for s, x, p in (("left", (0, 0, 10, 10), 0.5), ("left", (2, 0, 12, 10), 0.9), ("right", (0, 0, 10, 10), 0.4)))
    assert crops.merged([a, b, d], SET) == [b, d]


def test_anchor_has_the_best_registrations():
    edges = pd.DataFrame([("x", "y", 0.9, 1.0, 0.0), ("y", "z", 0.8, 1.0, 0.1)], columns=["a", "b", "inlier_ratio", "overlap_fraction", "stable_residual"])
    assert crops.anchor_of(["x", "y", "z"], edges) == "y" and crops.anchor_of(["x", "y"], edges[:0]) == "x"


def seen(gray):
    at = images.corners(gray, 5000)
    return {"gray": gray, "points": at, "described": images.patches(gray, at)}


def test_edges_need_the_same_scene():
    still = form(1, 1)
    moving, truth = shifted(still)
    found = crops.edge(seen(still), seen(moving), SET)
    assert found["model"] == "affine" and found["overlap_fraction"] > 0.9 and found["stable_residual"] < 0.05
    corner = np.array([[0, 0], [419, 599.0]])
    assert np.abs(pixels.moved(np.array(found["m"]).reshape(3, 3), corner) - pixels.moved(truth, corner)).max() < 2
    other = np.full((600, 420), 238, np.uint8)
    for k in range(12):
        writing(other, 30, 60 + 40 * k, 350, 25, 1000 + k)
    assert crops.edge(seen(still), seen(other), SET) is None


def test_scores_tell_writing_from_blank_paper():
    page = crops.Region(form(1, 1), (30, 60, 390, 560))
    blank = crops.Region(np.full((600, 420), 238, np.uint8), (30, 60, 390, 560))
    assert page.detail > blank.detail and page.frontness > 0.58 > blank.frontness
    box = np.full((200, 200), 230, np.uint8)
    frame(box, 40, 40, 160, 160, 60)
    assert crops.Region(box, (40, 40, 160, 160)).border > crops.Region(box, (60, 60, 140, 140)).border


def test_directory_to_submissions(spark, tmp_path):
    """A page, the page under a sheet, and a capture that shows something else."""
    d = tmp_path / "s"
    d.mkdir()
    page = form(1, 1)
    covered = sheet(page, 35, 130, 385, 360)
    for k in range(8):
        writing(covered, 50, 160 + 24 * k, 320, 20, 300 + k)
    for i, shot in enumerate([page, covered, np.full((600, 420), 238, np.uint8)]):
        (d / f"p{i}.png").write_bytes(png(shot))
    found = api.crop_directory(spark, str(tmp_path))
    rows = found["submissions"].collect()
    groups = {r["image_id"]: r["group_id"] for r in found["members"].collect()}
    assert groups["s/p0.png"] == groups["s/p1.png"] != groups["s/p2.png"]
    kinds = {(r["image_id"], r["kind"]) for r in rows}
    assert any(k == "base_page" for _, k in kinds) and any(k == "data_bearing_overlay" for _, k in kinds)
    assert {(r["completeness"], r["bucket"]) for r in rows if r["image_id"] == "s/p2.png"} == {("review_required", "review_queue")}
    assert all(0 <= r["bbox"][0] < r["bbox"][2] <= 420 and 0 <= r["bbox"][1] < r["bbox"][3] <= 600 for r in rows)
    assert {r["bucket"] for r in rows if r["image_id"] != "s/p2.png"} == {"submissions"}
