import numpy as np
import pytest

from folioweave import api
from folioweave.config import LinkConfig
from folioweave.operators import pixels
from folioweave.plans import captures

CFG = LinkConfig()


def form(seed=0, h=210, w=300):
    rng = np.random.default_rng(seed)
    page = np.full((h, w), 235.0)
    for y in range(20, h - 10, 18):
        page[y : y + 2, 20 : w - 20] = 90
        for x in range(24, w - 40, 12):
            if rng.random() < 0.6:
                page[y - 8 : y - 2, x : x + int(rng.integers(3, 9))] = 40
    return page


@pytest.fixture(scope="module")
def valid():
    return np.ones((210, 300), bool)


def test_exposure_shift_is_no_change(valid):
    a = form()
    m = pixels.pair_metrics(a, np.clip(a * 0.9 + 8, 0, 255), valid, CFG)
    assert m["changed_fraction"] < 0.05 and m["unmatched_ink_union_fraction"] < 0.02


def test_other_writing_disagrees_all_over(valid):
    m = pixels.pair_metrics(form(0), form(5), valid, CFG)
    assert m["unmatched_ink_union_fraction"] > 0.1 and m["ink_mismatch_tiles_fraction"] > 0.2


def test_a_sheet_changes_one_block(valid):
    a = form()
    b = a.copy()
    b[60:150, 60:220] = 205
    m = pixels.pair_metrics(a, b, valid, CFG)
    assert 0.1 < m["changed_fraction"] < 0.5 and m["largest_change_share"] > 0.8


def test_dissimilarity_bounds_and_dark_borders():
    z = np.zeros((40, 40))
    assert pixels.dissimilarity(z, z).max() < 1e-9
    assert 0 <= pixels.dissimilarity(z, z + 255).min() and pixels.dissimilarity(z, z + 255).max() <= 1


def test_registration_finds_the_map():
    rng = np.random.default_rng(1)
    still = rng.uniform(0, 300, (60, 2))
    m = np.array([[1.02, 0.03, 5], [-0.02, 0.98, -4], [0, 0, 1]])
    moving = pixels.moved(np.linalg.inv(m), still)
    moving[:15] = rng.uniform(0, 300, (15, 2))
    found, inside = pixels.robust_affine(moving, still)
    assert inside[15:].all() and np.abs(found - m).max() < 0.05
    assert pixels.registration_checks(found, inside, moving, still, (300, 300), (300, 300), CFG)["inlier_ratio"] >= 0.75
    assert pixels.robust_affine(moving[:2], still[:2])[0] is None
    assert not pixels.plausible(np.diag([0.2, 0.2, 1.0]), (100, 100), (100, 100))
    d = rng.normal(size=(20, 8))
    assert (pixels.match_points(d, d[::-1])[:, 1] == np.arange(20)[::-1]).all()


def test_warp_and_components():
    a = form()
    moved, seen = pixels.warp(a, np.array([[1.0, 0, 3], [0, 1, 2], [0, 0, 1]]), a.shape)
    assert np.allclose(moved[2:, 3:], a[:-2, :-3]) and not seen[:2].any()
    mask = np.zeros((6, 6), bool)
    mask[0, 0] = mask[1, 1] = mask[4, 4] = True
    assert pixels.components(mask).max() == 2 and pixels.components(mask)[0, 0] == pixels.components(mask)[1, 1]


def test_fingerprints_rank_likeness():
    a, b = form(0), form(5)
    assert pixels.correlation(pixels.fingerprint(a), pixels.fingerprint(a * 0.8 + 10)) > 0.95 > pixels.correlation(pixels.fingerprint(a), pixels.fingerprint(b))


def test_pairs_in_spark(spark, valid):
    raw = lambda x: bytearray(x.astype(np.uint8).tobytes())
    rows = [(1, 210, 300, raw(form()), raw(form()), None), (2, 210, 300, raw(form()), raw(form(5)), raw(valid * 0))]
    got = {r["pair_id"]: r for r in pixels.score_pairs(spark.createDataFrame(rows, "pair_id int, height int, width int, first_gray binary, second_gray binary, valid binary")).collect()}
    assert got[1]["changed_fraction"] == 0 and got[2]["changed_fraction"] == 1.0 and got[2]["valid_fraction"] == 0


def test_cluster_round_trip(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    items = captures.images(spark, d)
    from folioweave.operators.pairs import sequence_index

    items = sequence_index(items, "sequence_id", ["image_id"])
    result = api.cluster(items, captures.pairs(spark, d).drop("first_path", "second_path"))
    assert result["clusters"].selectExpr("sum(size(image_ids))").first()[0] == items.count()
    api.write_result(result, str(tmp_path))
    again = api.read_result(spark, str(tmp_path))
    assert again["pairs"].count() == result["pairs"].count()
    assert api.rank_candidates(again, include_accepted=True, include_unflagged=True).count() == again["pairs"].count()
