import struct
import zlib

import numpy as np
import pytest

from folioweave import api
from folioweave.config import LinkConfig
from folioweave.operators import content, decide, images, pixels

CFG = LinkConfig()


def writing(image, x, y, w, h, seed, ink=25):
    """Strokes that differ from seed to seed, on the line y."""
    rng = np.random.default_rng(seed)
    for k in range(x, x + w, 8):
        tall, wide = int(rng.integers(h // 2, h)), int(rng.integers(3, 7))
        image[y - tall : y, k : k + 2] = ink
        if rng.random() < 0.6:
            image[y - tall // 2 : y - tall // 2 + 2, k : k + wide] = ink
        if rng.random() < 0.5:
            image[y - 2 : y, k : k + wide] = ink


def frame(image, x0, y0, x1, y1, ink, thick=2):
    image[y0 : y0 + thick, x0:x1] = image[y1 - thick : y1, x0:x1] = ink
    image[y0:y1, x0 : x0 + thick] = image[y0:y1, x1 - thick : x1] = ink


def form(name=1, entries=None):
    image = np.full((600, 420), 238, np.uint8)
    frame(image, 20, 20, 400, 580, 40)
    image[70:550:45, 35:385] = 100
    for x in (140, 270):
        image[70:520, x] = 150
    writing(image, 70, 50, 280, 14, 99, 40)
    if name:
        writing(image, 55, 112, 80, 20, name)
        writing(image, 90, 540, 200, 20, name + 50)
    if entries:
        for i, (x, y) in enumerate([(48, 112), (150, 157), (285, 157), (55, 247), (150, 337), (85, 517), (180, 247), (290, 292), (60, 427), (290, 427)]):
            writing(image, x, y, 95, 30, 100 * entries + i, 15)
    return image


def sheet(image, x0, y0, x1, y1, paper=245, seed=7):
    out = image.copy()
    out[y0:y1, x0:x1] = paper
    frame(out, x0, y0, x1, y1, 80)
    writing(out, x0 + 40, y0 + 40, x1 - x0 - 80, 16, seed, 30)
    writing(out, x0 + 50, y0 + 110, (x1 - x0) // 2, 24, seed + 1)
    return out


def decided(spark, a, b, overlap=0.30):
    metrics = content.measure(a.astype(float), b.astype(float), np.ones(a.shape, bool), CFG)
    row = metrics | {"feature_overlap": overlap, "registration_fallback_used": False, "registration_alignment_score": 0.0}
    return decide.decide(spark.createDataFrame([row]), CFG).first(), metrics


def test_exposure_is_no_difference(spark):
    row, _ = decided(spark, form(), np.clip(form().astype(int) + 4, 0, 255))
    assert row["same_document"] and row["branch"] == "near_duplicate"


def test_same_form_with_other_entries_is_refused(spark):
    row, metrics = decided(spark, form(0, 1), form(0, 2))
    assert not row["same_document"] and row["branch"] is None and row["hard_contradiction"]
    assert metrics["unmatched_ink_union_fraction"] > 0.06


def test_a_sheet_on_the_page_is_an_occlusion(spark):
    row, metrics = decided(spark, form(), sheet(form(), 35, 130, 385, 360), 0.40)
    assert row["same_document"] and row["branch"] == "physical_occlusion"
    assert metrics["occlusion_candidate_count"] == 1 and 0.3 < metrics["occlusion_area_fraction"] < 0.5
    assert metrics["outside_unmatched_ink_union_fraction"] < 0.01 < 0.9 < metrics["occlusion_ink_mismatch_capture"]


def test_too_little_in_common_is_pessimistic():
    seen = np.zeros((600, 420), bool)
    seen[:30, :30] = True
    metrics = content.measure(form().astype(float), form().astype(float), seen, CFG)
    assert metrics["unmatched_ink_fraction"] == metrics["changed_fraction"] == 1.0 and metrics["occlusion_candidate_count"] == 0 and metrics["page_count"] == 1


def tiles():
    ink = np.zeros((18, 24), bool)
    ink[5:15, 2:22] = True
    return ink, np.ones((18, 24), bool), (np.full((180, 240), 238.0),) * 2


def test_a_dense_block_is_its_rectangle():
    ink, page, pair = tiles()
    block = content.dense_ink_block(ink, page, slice(0, 24), (0, 0, 240, 180), pair, CFG)
    assert (block.tiles == ink).all() and block.fill == 1.0 and not block.whole


def test_sparse_disagreement_is_no_block():
    _, page, pair = tiles()
    ink = np.zeros((18, 24), bool)
    ink[::3, ::4] = True
    assert content.dense_ink_block(ink, page, slice(0, 24), (0, 0, 240, 180), pair, CFG) is None


def test_dense_block_only_where_it_explains_more():
    ink, page, _ = tiles()
    dense = content.Block((20, 50, 220, 150), ink, 1.0, 0.0)
    small = np.zeros_like(ink)
    small[5:8, 2:6] = True
    residual = content.Block((20, 50, 60, 80), small, 1.0, 0.0)
    assert content.better_block(None, dense, ink, page) is dense
    assert content.better_block(residual, dense, ink, page) is dense
    most = ink.copy()
    most[14, 2:22] = False
    assert content.better_block(r := content.Block((20, 50, 220, 140), most, 1.0, 0.0), dense, ink, page) is r


def test_pages_part_at_the_fold():
    wide = np.full((300, 600), 235.0)
    wide[:, 296:304] = 30
    at = content.fold(wide, CFG)
    assert 290 <= at <= 310 and len(content.page_parts(wide.shape, 24, at)) == 2
    assert content.fold(np.full((300, 600), 235.0), CFG) is None and content.fold(wide[:, :300], CFG) is None


def test_parts_equal_a_plain_search():
    rng = np.random.default_rng(4)
    for share in (0.0, 0.3, 0.5, 1.0):
        mask = rng.random((23, 31)) < share
        found, plain = content.parts(mask), pixels.components(mask) if mask.any() else np.zeros(mask.shape, int)
        assert (found > 0).tolist() == mask.tolist()
        pairs = set(zip(found[mask].tolist(), plain[mask].tolist()))
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


# --- files


def png(image, kinds=(0,), depth=8):
    """A PNG whose lines use the given filters in turn."""
    h, w = image.shape[:2]
    step = image.shape[2] if image.ndim == 3 else 1
    lines, above = [], np.zeros(w * step, np.int64)
    for i, line in enumerate(image.reshape(h, -1).astype(np.int64)):
        kind = kinds[i % len(kinds)]
        left, corner = (np.concatenate([np.zeros(step, np.int64), x[:-step]]) for x in (line, above))
        p = np.abs(above - corner), np.abs(left - corner), np.abs(left + above - 2 * corner)
        paeth = np.where((p[0] <= p[1]) & (p[0] <= p[2]), left, np.where(p[1] <= p[2], above, corner))
        guess = [0 * line, left, above, (left + above) // 2, paeth][kind]
        lines.append(bytes([kind]) + ((line - guess) % 256).astype(np.uint8).tobytes())
        above = line
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", w, h, depth, {1: 0, 3: 2, 4: 6}[step], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")


@pytest.mark.parametrize("channels", [1, 3, 4])
def test_png_round_trip(channels):
    image = np.random.default_rng(channels).integers(0, 256, (13, 17, channels), dtype=np.uint8)
    raw = png(image if channels > 1 else image[..., 0], kinds=(0, 1, 2, 3, 4))
    assert (images.decode(raw) == image).all()
    assert images.as_colour(images.decode(raw)).shape == (13, 17, 3)


def test_pnm_and_broken_files():
    image = np.arange(12, dtype=np.uint8).reshape(3, 4)
    assert (images.decode(b"P5\n# note\n4 3\n255\n" + image.tobytes())[..., 0] == image).all()
    for raw in (b"", b"\x89PNG\r\n\x1a\n", png(image)[:40], b"\xff\xd8\xff"):
        with pytest.raises(ValueError):
            images.decode(raw)


def test_shrinking_keeps_areas():
    image = np.random.default_rng(2).integers(0, 256, (40, 60), dtype=np.uint8)
    small, scale = images.bounded(image, 30)
    assert small.shape == (20, 30) and scale == 0.5
    assert np.abs(small.astype(float) - image.reshape(20, 2, 30, 2).mean((1, 3))).max() <= 0.5
    assert images.bounded(image, 60)[0] is image and images.bounded(np.zeros((3, 900), np.uint8), 30, 2)[0].shape == (2, 30)


def shifted(image, angle=0.01, dx=5.0, dy=-4.0):
    m = np.array([[np.cos(angle), np.sin(angle), dx], [-np.sin(angle), np.cos(angle), dy], [0, 0, 1]])
    out, seen = pixels.warp(image.astype(float), m, image.shape)
    return np.where(seen, out, 238).round().astype(np.uint8), np.linalg.inv(m)


def seen(gray):
    at = images.corners(gray, CFG.max_features)
    return at, images.patches(gray, at)


def test_points_and_pixels_find_the_motion():
    still = form(1, 1)
    moving, truth = shifted(still)
    (p, d), (q, e) = seen(still), seen(moving)
    by_points = images.register(still, moving, (p, q), (d, e), CFG)
    assert by_points.accepted and by_points.model == "affine" and by_points.measures["feature_overlap"] > 0.2
    blank = np.zeros((0, 2), np.float32), np.zeros((0, images.KEPT**2), np.float32)
    by_pixels = images.register(still, moving, (p, blank[0]), (d, blank[1]), CFG)
    assert by_pixels.accepted and by_pixels.measures["registration_fallback_used"] and by_pixels.measures["registration_alignment_score"] > 0.9
    for found in (by_points, by_pixels):
        corner = np.array([[0, 0], [419, 0], [0, 599], [419, 599.0]])
        assert np.abs(pixels.moved(found.matrix, corner) - pixels.moved(truth, corner)).max() < 2
    noise = np.random.default_rng(1).integers(0, 255, still.shape, dtype=np.uint8)
    assert not images.register(still, noise, (p, blank[0]), (d, blank[1]), CFG).accepted


def test_homography_is_found_where_affine_does_not_fit():
    rng = np.random.default_rng(5)
    moving = rng.uniform(0, 400, (80, 2))
    m = np.array([[1.0, 0.05, 4], [-0.03, 0.95, 7], [3e-4, 2e-4, 1]])
    still = pixels.moved(m, moving)
    still[:20] += rng.uniform(30, 60, (20, 2))
    found, inside = images.robust_homography(moving, still)
    assert inside[20:].all() and not inside[:20].any() and np.abs(found - m).max() < 0.05
    assert images.robust_homography(moving[:3], still[:3])[0] is None


def test_directory_to_groups(spark, tmp_path):
    """Two shots of a page, the page under a sheet, another record; an unreadable file in a folder of its own."""
    a, b = tmp_path / "a", tmp_path / "b"
    a.mkdir(), b.mkdir()
    shots = [form(1, 1), shifted(form(1, 1), 0.0)[0], sheet(form(1, 1), 35, 130, 385, 360), form(0, 2)]
    for i, shot in enumerate(shots):
        (a / f"p{i:03}.png").write_bytes(png(shot))
    (b / "p000.png").write_bytes(png(shots[0]))
    (b / "p001.png").write_bytes(b"no image")
    result = api.cluster_directory(spark, str(tmp_path))
    pairs = {(r["first_image_id"], r["second_image_id"]): r for r in result["pairs"].collect()}
    assert len(pairs) == 7
    assert pairs["a/p000.png", "a/p001.png"]["branch"] == "near_duplicate"
    assert pairs["a/p000.png", "a/p002.png"]["occlusion_candidate_count"] == 1
    assert not any(r["same_document"] for k, r in pairs.items() if "a/p003.png" in k)
    odd = pairs["b/p000.png", "b/p001.png"]
    assert odd["reason"] == "image cannot be read" and not odd["same_document"] and odd["different_document_probability"] == 1.0
    groups = {tuple(r["image_ids"]) for r in result["clusters"].collect()}
    assert ("a/p003.png",) in groups and {"a/p000.png", "a/p001.png"} <= set(next(g for g in groups if "a/p000.png" in g))
    api.write_result(result, str(tmp_path / "out"))
    assert api.cluster_images(spark, [str(a / "p000.png"), str(a / "p001.png")])["clusters"].count() == 1
