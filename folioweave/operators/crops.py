"""Recovering every page and every sheet that lies on one from a group of captures of the same scene.

Images of a group are registered pair by pair, laid on one of them (the anchor),
and compared by tiles. Parts that change become candidate sheets. For each page
the image that shows it best is submitted, and so is every other state of a
candidate that carries data.

Plan: pairs are registered in Arrow batches over two joins on ids; groups are the
components of the edges, or given; one group, a handful of captures, is recovered
by one call. Kernels are numpy and close to, not bit for bit equal with, those of
image libraries.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass
from functools import cached_property
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import LinkConfig
from . import content, images, pixels
from .content import Box, clipped, fold, parts, soft, steepness
from .graph import transforms_to_anchor
from .pixels import Shape

c = F.col

#: Settings by name; ``CropSettings`` takes others.
DEFAULTS: dict[str, float] = dict(
    window=3, min_fingerprint_correlation=0.20, max_dimension=1500, features=5000, ratio_test=0.76, min_good_matches=18, min_inliers=14, min_inlier_ratio=0.18,
    ransac_reprojection_px=5.0, min_cells=5, min_x_span=0.30, min_y_span=0.24, min_overlap=0.70, max_stable_residual=0.19, homography_gain=0.018,
    tiles=34, upper_tail=0.20, weight_absolute=0.35, weight_tail=0.40, weight_gradient=0.25, stable_fraction=0.62, changed_z=2.4, changed_least=0.075, close_tiles=1,
    min_component_tiles=2, trim_x=0.0, trim_y=0.12, outer_margin=0.018, fold_margin=0.010, search_padding=0.20, max_expansion=0.38, smoothing=0.012, edge_prominence=1.30,
    fallback_padding=0.035, tall_min_width=0.68, tall_min_height=0.45, tall_top=0.12, tall_bottom=0.08, min_area=0.025, max_area=0.62, min_contrast=0.025, merge_overlap=0.55,
    complete_occlusion=0.025, partial_occlusion=0.55, submit_partial=1, visibility=0.90, min_content=0.055, min_page_frontness=0.58, frontness_weight=0.20, detail_weight=0.80,
    shallow_height=0.27, shallow_width=0.52, shallow_weight=0.35, min_region_frontness=0.72, blank_detail=0.67, blank_content=0.65, blank_frontness=0.72, blank_boundary=1.50,
    min_region_coverage=0.25, min_state_change=0.05, min_boundary=1.35, page_state_coverage=0.85, same_state=0.985, fallback_content=0.045, fallback_detail=0.020,
    fallback_frontness=0.30,
)


class CropSettings:
    """All settings as attributes; unknown names are refused."""

    def __init__(self, **given: float):
        if odd := sorted(set(given) - set(DEFAULTS)):
            raise ValueError(f"no such settings: {', '.join(odd)}")
        self.__dict__.update(DEFAULTS | given)


def area(b: Box) -> int:
    return max(0, b[2] - b[0]) * max(0, b[3] - b[1])


def common(a: Box, b: Box) -> Box:
    return max(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), min(a[3], b[3])


def moved_box(b: Box, m: np.ndarray, shape: Shape) -> Box:
    """The box around the moved corners, rounded outwards, inside an image."""
    x, y = pixels.moved(m, np.array([[i, j] for i in (b[0], b[2]) for j in (b[1], b[3])], float)).T
    return max(0, int(np.floor(x.min()))), max(0, int(np.floor(y.min()))), min(shape[1], int(np.ceil(x.max()))), min(shape[0], int(np.ceil(y.max())))


# --- registration


def like_exposed(still: np.ndarray, aligned: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """The aligned image with the other's median and spread over what both show."""
    if valid.sum() < 1000:
        return aligned
    middle, other = np.median(still[valid]), np.median(aligned[valid])
    spread, others = (np.median(np.abs(x[valid] - m)) for x, m in ((still, middle), (aligned, other)))
    gain = float(np.clip(spread / others, 0.72, 1.38)) if min(spread, others) >= 1 else 1.0
    return np.clip(aligned * gain + middle - gain * other, 0, 255)


def laid(image: np.ndarray, m: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """The image in another's frame, and where it is seen, without the rim."""
    out, valid = pixels.warp(image.astype(float), m, shape)
    return np.where(valid, out, 0.0), pixels.shrink(valid, 2)


def calm_residual(still: np.ndarray, aligned: np.ndarray, valid: np.ndarray, share: float = 0.62) -> float:
    """The mean difference of the calmest tiles; 1 where too few are seen."""
    off = pixels.blur(np.abs(still - like_exposed(still, aligned, valid)) / 255, 7)
    size = max(16, round(max(still.shape) / 24))
    found = []
    for y in range(0, still.shape[0], size):
        for x in range(0, still.shape[1], size):
            seen = valid[y : y + size, x : x + size]
            if seen.mean() >= 0.75:
                found.append(off[y : y + size, x : x + size][seen].mean())
    return float(np.mean(np.sort(found)[: max(4, round(share * len(found)))])) if len(found) >= 8 else 1.0


def edge(a: dict, b: dict, s: CropSettings) -> dict | None:
    """How image b lies on image a, or null where they do not show the same scene; an affine map unless a projective one is clearly better."""
    pairs = pixels.match_points(b["described"], a["described"], s.ratio_test)
    if len(pairs) < s.min_good_matches:
        return None
    ours, theirs = b["points"][pairs[:, 0]].astype(float), a["points"][pairs[:, 1]].astype(float)
    still, size = a["gray"].astype(float), np.array(a["gray"].shape[::-1], float)

    def checked(model: str, m: np.ndarray | None, inside: np.ndarray) -> dict | None:
        n = int(inside.sum())
        if m is None or n < s.min_inliers or n / len(pairs) < s.min_inlier_ratio:
            return None
        at = theirs[inside] / size
        cells, spans = {tuple(x) for x in np.clip((at * 4).astype(int), 0, 3).tolist()}, np.ptp(at, axis=0)
        aligned, valid = laid(b["gray"], m, still.shape)
        if len(cells) < s.min_cells or spans[0] < s.min_x_span or spans[1] < s.min_y_span or valid.mean() < s.min_overlap:
            return None
        residual = calm_residual(still, aligned, valid, s.stable_fraction)
        found = {"model": model, "m": m.ravel().tolist(), "inlier_ratio": n / len(pairs), "overlap_fraction": float(valid.mean()), "stable_residual": residual}
        return found if residual <= s.max_stable_residual else None

    plain = checked("affine", *pixels.robust_affine(ours, theirs, s.ransac_reprojection_px))
    bent = checked("homography", *images.robust_homography(ours, theirs, s.ransac_reprojection_px))
    if plain and bent and plain["stable_residual"] - bent["stable_residual"] >= s.homography_gain:
        return bent
    return plain or bent


# --- tiles that change


@dataclass
class Tiles:
    """Scores of square tiles of an aligned pair; NaN where too little of one is seen."""

    scores: np.ndarray
    changed: np.ndarray
    size: int
    shape: Shape
    baseline: float

    @property
    def seen(self) -> np.ndarray:
        return ~np.isnan(self.scores)

    def box(self, row: int, column: int) -> Box:
        y, x = row * self.size, column * self.size
        return x, y, min(self.shape[1], x + self.size), min(self.shape[0], y + self.size)


def gradient_size(image: np.ndarray) -> np.ndarray:
    return np.hypot(*steepness(image, 1, 2))


def change_tiles(still: np.ndarray, aligned: np.ndarray, valid: np.ndarray, s: CropSettings) -> Tiles:
    """Differences and their upper tails, and differences of gradients; tiles that stand out against the calm ones are changed."""
    a, b = still / 255, like_exposed(still, aligned, valid) / 255
    off, steep = pixels.blur(np.abs(a - b), 5), np.clip(pixels.blur(np.abs(gradient_size(a) - gradient_size(b)), 5), 0, 1)
    size = max(12, round(max(a.shape) / s.tiles))
    scores = np.full((-(-a.shape[0] // size), -(-a.shape[1] // size)), np.nan)
    for r, k in np.ndindex(*scores.shape):
        here = slice(r * size, (r + 1) * size), slice(k * size, (k + 1) * size)
        seen = valid[here]
        x = np.sort(off[here][seen])
        if seen.mean() >= 0.72 and x.size >= 20:
            scores[r, k] = s.weight_absolute * x.mean() + s.weight_tail * x[-max(1, round(s.upper_tail * x.size)) :].mean() + s.weight_gradient * steep[here][seen].mean()
    seen = ~np.isnan(scores)
    if not seen.any():
        return Tiles(scores, seen, size, a.shape, 0.0)
    calm = np.sort(scores[seen])[: max(4, round(s.stable_fraction * seen.sum()))]
    middle = float(np.median(calm))
    scale = max(1.4826 * float(np.median(np.abs(calm - middle))), 0.012)
    loud = np.nan_to_num(scores)
    changed = seen & ((loud - middle) / scale >= s.changed_z) & (loud >= s.changed_least)
    reach = int(s.close_tiles)
    return Tiles(scores, pixels.shrink(pixels.spread(changed, reach), reach) & seen if reach else changed, size, a.shape, middle)


def weighted_quantile(values: np.ndarray, weights: np.ndarray, q: float) -> float:
    """The least value up to which the weights make up a share q."""
    order = np.argsort(values, kind="stable")
    total = np.cumsum(weights[order])
    return float(values[order][min(np.searchsorted(total, q * total[-1]), len(values) - 1)])


def changed_parts(t: Tiles, s: CropSettings, page: Box | None = None) -> list[tuple[Box, np.ndarray]]:
    """(box, tiles) of connected changed tiles whose centres lie on a page, the largest first; a box leaves out ends of little weight."""
    mask = t.changed.copy()
    for r, k in zip(*np.nonzero(mask)):
        x0, y0, x1, y1 = t.box(r, k)
        mask[r, k] = page is None or (page[0] <= (x0 + x1) / 2 < page[2] and page[1] <= (y0 + y1) / 2 < page[3])
    labels, out = parts(mask), []
    for label in range(1, labels.max() + 1):
        tiles = labels == label
        if tiles.sum() < s.min_component_tiles:
            continue
        boxes = np.array([t.box(r, k) for r, k in zip(*np.nonzero(tiles))])
        weights, keep = np.maximum(t.scores[tiles] - t.baseline, 1e-4), np.ones(len(boxes), bool)
        for first, trim in ((0, s.trim_x), (1, s.trim_y)):
            middle = (boxes[:, first] + boxes[:, first + 2]) / 2
            keep &= (middle >= weighted_quantile(middle, weights, trim)) & (middle <= weighted_quantile(middle, weights, 1 - trim))
        kept = boxes[keep] if keep.any() else boxes
        out.append((tuple(int(v) for v in (*kept[:, :2].min(0), *kept[:, 2:].max(0))), tiles))
    return sorted(out, key=lambda x: -x[1].sum())


# --- pages and sheets


def page_boxes(image: np.ndarray, cfg: LinkConfig, s: CropSettings) -> list[tuple[str, Box]]:
    """The page, or the two pages of a spread, without their margins."""
    h, w = image.shape
    rim, at = round(s.outer_margin * min(h, w)), fold(image.astype(float), cfg)
    if at is None:
        return [("single", (rim, rim, w - rim, h - rim))]
    gap = round(s.fold_margin * w)
    return [("left", (rim, rim, max(rim + 1, at - gap), h - rim)), ("right", (min(w - rim - 1, at + gap), rim, w - rim, h - rim))]


def padded_tall(box: Box, page: Box, s: CropSettings) -> Box:
    """A broad, tall sheet with room above and below, as changes show its writing only."""
    w, h = max(page[2] - page[0], 1), max(page[3] - page[1], 1)
    if box[2] - box[0] < s.tall_min_width * w or box[3] - box[1] < s.tall_min_height * h:
        return box
    return box[0], max(page[1], box[1] - round(s.tall_top * h)), box[2], min(page[3], box[3] + round(s.tall_bottom * h))


def sheet_box(image: np.ndarray, box: Box, page: Box, s: CropSettings) -> Box:
    """The box grown to the nearest strong edges around it, else by a little."""
    w, h = page[2] - page[0], page[3] - page[1]
    x0, y0, x1, y1 = clipped(box, page, round(s.search_padding * w), round(s.search_padding * h))
    if x1 <= x0 or y1 <= y0:
        return padded_tall(box, page, s)
    across, down = (np.abs(g) for g in steepness(pixels.blur(image[y0:y1, x0:x1].astype(float), 5), 1, 2))

    def side(profile: np.ndarray, at: int, step: int, reach: int, little: int) -> int:
        """From ``at`` outwards; an edge stands out against the median of the way."""
        size = max(3, round(s.smoothing * len(profile)) | 1)
        smooth = pixels._along(profile[None, :], pixels._taps(size), 1)[0] if len(profile) > size else profile
        low, high = (max(0, at - reach), min(len(profile), at + 1)) if step < 0 else (max(0, at), min(len(profile), at + reach + 1))
        way = smooth[low:high]
        strong = np.flatnonzero(way >= s.edge_prominence * max(float(np.median(way)), 1e-5)) if len(way) else way
        if len(strong):
            return low + int(strong[-1] if step < 0 else strong[0])
        return max(0, at - little) if step < 0 else min(len(profile), at + little)

    dx, dy, px, py = round(s.max_expansion * w), round(s.max_expansion * h), round(s.fallback_padding * w), round(s.fallback_padding * h)
    rows, columns = down.mean(1), across.mean(0)
    grown = clipped(
        (x0 + side(columns, box[0] - x0, -1, dx, px), y0 + side(rows, box[1] - y0, -1, dy, py), x0 + side(columns, box[2] - x0, 1, dx, px), y0 + side(rows, box[3] - y0, 1, dy, py)), page
    )
    return padded_tall(box if area(grown) < area(box) else grown, page, s)


# --- what a region shows


class Region:
    """Scores of a part of an image: how much writing, detail, and the front of a sheet it shows."""

    def __init__(self, image: np.ndarray, box: Box):
        self.image, self.box = image, box
        self.pixels = image[box[1] : box[3], box[0] : box[2]].astype(np.float32) / 255

    def _apart(self, x: np.ndarray, share: float) -> np.ndarray:
        return x - soft(x, max(2.0, min(x.shape) / share))

    @cached_property
    def steep(self) -> np.ndarray:
        return gradient_size(self.pixels)

    @cached_property
    def detail(self) -> float:
        if self.pixels.size < 100:
            return 0.0
        return 0.55 * float(np.percentile(np.abs(self._apart(self.pixels, 65)), 85)) + 0.45 * float(np.percentile(self.steep, 80))

    @cached_property
    def content(self) -> float:
        if self.pixels.size < 100:
            return 0.0
        low, high = self.pixels.min(), self.pixels.max()
        x = (self.pixels - low) / (high - low) if high > low else np.zeros_like(self.pixels)
        return 0.35 * float((x < 0.62).mean()) + 0.35 * float(np.percentile(np.abs(self._apart(x, 70)), 85)) + 0.30 * float(np.percentile(gradient_size(x), 80))

    @cached_property
    def frontness(self) -> float:
        """Ink is darker than its paper; what shines through a sheet is as often lighter."""
        if self.pixels.size < 400:
            return 0.0
        off = self._apart(self.pixels, 45)
        dark, light = np.percentile(np.maximum(-off, 0), 95), np.percentile(np.maximum(off, 0), 95)
        skew = np.clip((dark / max(light, 1e-4) - 1.35) / 0.85, 0, 1)
        return float(0.80 * skew + 0.20 * np.clip(np.percentile(self.steep, 85) / 1.10, 0, 1))

    @cached_property
    def border(self) -> float:
        return content.border_score(self.image.astype(float), self.box)

    @cached_property
    def print(self) -> np.ndarray:
        h, w = self.pixels.shape
        if min(h, w) < 1:
            return np.zeros(0)
        size = 64
        x = np.repeat(np.repeat(self.pixels, -(-size // h), 0), -(-size // w), 1)
        return pixels.fingerprint(images.area_resized((x * 255).round(), (size, size)), size)


class Scene:
    """A group's images, their transforms to the anchor, and regions of the anchor's frame in each of them."""

    def __init__(self, grays: Mapping[Any, np.ndarray], to_anchor: Mapping[Any, np.ndarray], region: type = Region):
        self.grays, self.region = grays, region
        self.back = {k: np.linalg.inv(m) for k, m in to_anchor.items()}
        self._known: dict[tuple, Region] = {}

    def views(self, box: Box) -> dict[Any, Region]:
        for k, m in self.back.items():
            if (box, k) not in self._known:
                self._known[box, k] = self.region(self.grays[k], moved_box(box, m, self.grays[k].shape))
        return {k: self._known[box, k] for k in self.back}


# --- candidates and choices


def change_candidates(still: np.ndarray, aligned: np.ndarray, valid: np.ndarray, pages: list[tuple[str, Box]], s: CropSettings) -> list[dict]:
    """Sheets that one of two aligned images shows and the other does not."""
    t, out = change_tiles(still, aligned, valid, s), []
    for side, page in pages:
        for raw, tiles in changed_parts(t, s, page):
            support = common(raw, page)
            if not area(support):
                continue
            grown = [sheet_box(x, support, page, s) for x in (still, aligned)]
            box = min(g[0] for g in grown), min(g[1] for g in grown), max(g[2] for g in grown), max(g[3] for g in grown)
            share = area(box) / max(still.size, 1)
            inside, outside = t.scores[tiles & t.seen], t.scores[t.seen & ~tiles]
            contrast = (np.percentile(inside, 65) if inside.size else 0.0) - (np.percentile(outside, 70) if outside.size else 0.0)
            if s.min_area <= share <= s.max_area and contrast > s.min_contrast:
                support_share = tiles.sum() / max(t.seen.sum(), 1)
                out.append({"side": side, "box": box, "confidence": float(np.clip(0.35 + 2.2 * contrast + 0.7 * support_share, 0, 1))})
    return out


def merged(found: Iterable[dict], s: CropSettings) -> list[dict]:
    """The surest candidates of those of one side that overlap by most of the smaller."""
    out: list[dict] = []
    for one in sorted(found, key=lambda x: -x["confidence"]):
        if not any(one["side"] == k["side"] and area(common(one["box"], k["box"])) / max(min(area(one["box"]), area(k["box"])), 1) >= s.merge_overlap for k in out):
            out.append(one)
    return out


def hidden_share(scene: Scene, page: Box, best: Any, boxes: Iterable[Box], s: CropSettings) -> float:
    """How much of a page the candidates may hide in the image chosen for it."""
    total = 0.0
    for box in boxes:
        detail = {k: v.detail for k, v in scene.views(box).items()}
        most, least, size = max(detail.values()), min(detail.values()), area(common(page, box))
        wide, tall = (box[2] - box[0]) / max(page[2] - page[0], 1), (box[3] - box[1]) / max(page[3] - page[1], 1)
        if detail.get(best, 0.0) < s.visibility * max(most, 1e-8):
            total += size
        elif wide >= max(s.shallow_width, 0.82) and tall <= max(s.shallow_height, 0.42) and least >= 0.55 * max(most, 1e-8):
            total += s.shallow_weight * size
        elif size / max(area(page), 1) >= min(s.min_region_coverage, 0.34) and wide >= 0.70 and least >= 0.90 * max(most, 1e-8):
            total += size
    return total / max(area(page), 1)


def best_pages(scene: Scene, pages: list[tuple[str, Box]], candidates: list[dict], s: CropSettings) -> tuple[list[dict], dict[str, Any]]:
    """A submission for each page that some image shows from the front, and the image chosen for each page."""
    out, chosen = [], {}
    for side, page in pages:
        views = scene.views(page)
        if not views:
            continue
        top = max(v.detail for v in views.values())

        def quality(k: Any) -> float:
            v = views[k]  # noqa: B023
            h, w = scene.grays[k].shape
            at_rim = v.box[0] <= 1 or v.box[1] <= 1 or v.box[2] >= w - 1 or v.box[3] >= h - 1
            return s.frontness_weight * v.frontness + s.detail_weight * v.detail / max(top, 1e-8) - 0.025 * at_rim  # noqa: B023

        best = chosen[side] = max(views, key=lambda k: (quality(k), k))
        view = views[best]
        if view.frontness < s.min_page_frontness:
            continue
        hidden = hidden_share(scene, page, best, [x["box"] for x in candidates if x["side"] == side], s)
        state = "complete" if hidden <= s.complete_occlusion else "partial_best_available" if s.submit_partial and hidden <= s.partial_occlusion else None
        if state:
            sure = float(np.clip(0.45 + 0.45 * view.frontness + 0.20 * view.detail - hidden, 0, 1))
            out.append(dict(image=best, kind="base_page", side=side, box=view.box, completeness=state, confidence=sure, content_score=view.content, occlusion_fraction=hidden, reason="best view of the page"))
    return out, chosen


def other_states(scene: Scene, pages: list[tuple[str, Box]], chosen: Mapping[str, Any], candidates: list[dict], s: CropSettings) -> list[dict]:
    """A submission for each state of a candidate that the chosen page does not show and that carries data."""
    out, page_of = [], dict(pages)
    for number, one in enumerate(candidates, 1):
        page, canonical = page_of[one["side"]], chosen.get(one["side"])
        coverage = area(common(one["box"], page)) / max(area(page), 1)
        if coverage < s.min_region_coverage:
            continue
        views = {k: v for k, v in scene.views(one["box"]).items() if v.pixels.size}
        if not views:
            continue
        most = {name: max(max(getattr(v, name) for v in views.values()), 1e-8) for name in ("detail", "content", "frontness")}
        distinct: list[Any] = []
        for k in sorted(views, key=lambda k: (-views[k].frontness, -views[k].detail)):
            if not any(pixels.correlation(views[k].print, views[j].print) >= s.same_state for j in distinct):
                distinct.append(k)
        for turn, k in enumerate(distinct, 1):
            v, base = views[k], views.get(canonical)
            if k == canonical or v.content < s.min_content or v.frontness < s.min_region_frontness:
                continue
            if base is not None and max(abs(getattr(v, n) - getattr(base, n)) / m for n, m in most.items()) < s.min_state_change:
                continue
            blank = v.detail < s.blank_detail * most["detail"] and v.content < s.blank_content * most["content"] and v.frontness < s.blank_frontness * most["frontness"]
            if blank and v.border < s.blank_boundary:
                continue
            kind = "page_state" if coverage >= s.page_state_coverage and v.border < s.min_boundary else "data_bearing_overlay"
            sure = float(np.clip(0.30 + 0.55 * v.frontness + 0.25 * min(v.detail, 1.0), 0, 1))
            out.append(dict(image=k, kind=kind, side=f"{one['side']}_change_{number}_state_{turn}", box=v.box, completeness="complete", confidence=sure, content_score=v.content, occlusion_fraction=0.0, reason="a state that the page's best view does not show"))
    return out


def resolved(found: list[dict], states: list[dict]) -> list[dict]:
    """Pages whose covering sheet was recovered as a state of its own are complete."""
    sides = {x["side"].split("_change_")[0] for x in states}
    return [x | {"completeness": "complete", "occlusion_fraction": 0.0, "reason": x["reason"] + "; its other state is submitted apart"} if x["side"] in sides else x for x in found]


def fallback_pages(scene: Scene, pages: list[tuple[str, Box]], s: CropSettings) -> list[dict]:
    """For a group without submissions: the best view of each page that is not blank; if all fail, the best at all, unless blank."""
    views = [(0.45 * v.frontness + 0.35 * v.content + 0.20 * min(v.detail, 1.0), k, side, v) for side, page in pages for k, v in scene.views(page).items()]
    if not views:
        return []
    best: dict[str, tuple] = {}
    for x in views:
        if x[2] not in best or x[0] > best[x[2]][0]:
            best[x[2]] = x
    use = [x for x in best.values() if x[3].content >= s.fallback_content and x[3].detail >= s.fallback_detail and x[3].frontness >= s.fallback_frontness]
    if not use:
        top = max(views, key=lambda x: x[:3])
        if top[3].content < 0.5 * s.fallback_content and top[3].detail < 0.5 * s.fallback_detail:
            return []
        use = [top]
    return [
        dict(image=k, kind="base_page", side=side, box=v.box, completeness="complete" if v.frontness >= s.min_page_frontness else "review_required",
             confidence=float(np.clip(0.30 + 0.35 * v.frontness + 0.20 * v.content, 0, 1)), content_score=v.content, occlusion_fraction=0.0, reason="fallback: the group gave no other submission")
        for _, k, side, v in use
    ]


def anchor_of(members: list, edges: pd.DataFrame) -> Any:
    """The image with the best registrations in all; ties to the first."""
    score = dict.fromkeys(members, 0.0)
    for a, b, ratio, overlap, residual in edges[["a", "b", "inlier_ratio", "overlap_fraction", "stable_residual"]].itertuples(index=False):
        for k in (a, b):
            score[k] += ratio + overlap - residual
    return max(members, key=lambda k: (score[k], -members.index(k)))


def recover(grays: Mapping[Any, np.ndarray], edges: pd.DataFrame, cfg: LinkConfig, s: CropSettings) -> list[dict]:
    """All submissions of a group; boxes in working pixels of their image. Images that no edge leads to are left out."""
    members = list(grays)
    anchor = anchor_of(members, edges)
    to_anchor = transforms_to_anchor(edges, anchor) if len(members) > 1 else {anchor: np.eye(3)}
    still = grays[anchor]
    pages, found = page_boxes(still, cfg, s), []
    for a, b in edges[["a", "b"]].itertuples(index=False):
        if a in to_anchor and b in to_anchor:
            (x, seen), (y, too) = (laid(grays[k], to_anchor[k], still.shape) for k in (a, b))
            found += change_candidates(x, y, seen & too, pages, s)
    candidates, scene = merged(found, s), Scene(grays, to_anchor)
    shown, chosen = best_pages(scene, pages, candidates, s)
    states = other_states(scene, pages, chosen, candidates, s)
    return resolved(shown, states) + states or fallback_pages(scene, pages, s)


# --- Spark

EDGES = "a string, b string, model string, m array<double>, inlier_ratio double, overlap_fraction double, stable_residual double"
SUBMISSIONS = (
    "group_id string, submission_id string, image_id string, kind string, side string, bbox array<int>, completeness string, confidence double, "
    "content_score double, occlusion_fraction double, reason string"
)


def _opened(row: dict) -> dict | None:
    if row["gray"] is None:
        return None
    return {
        "gray": np.frombuffer(row["gray"], np.uint8).reshape(int(row["height"]), int(row["width"])), "points": np.frombuffer(row["points"], np.float32).reshape(-1, 2),
        "described": np.frombuffer(row["described"], np.float32).reshape(-1, images.KEPT**2),
    }


def crop_edges(pairs: DataFrame, loaded: DataFrame, s: CropSettings | None = None) -> DataFrame:
    """``EDGES`` of those pairs (a, b) that show the same scene."""
    s = s or CropSettings()
    image = F.struct("height", "width", "gray", "points", "described")
    both = pairs.select("a", "b").join(loaded.select(c("image_id").alias("a"), image.alias("_a")), "a").join(loaded.select(c("image_id").alias("b"), image.alias("_b")), "b")
    names = [x.split()[0] for x in EDGES.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for a, b, left, right in zip(rows["a"], rows["b"], rows["_a"], rows["_b"]):
                x, y = _opened(left), _opened(right)
                if x and y and pixels.correlation(pixels.fingerprint(x["gray"]), pixels.fingerprint(y["gray"])) >= s.min_fingerprint_correlation and (found := edge(x, y, s)):
                    out.append({"a": a, "b": b} | found)
            yield pd.DataFrame(out, columns=names)

    return both.select("a", "b", "_a", "_b").mapInPandas(run, EDGES)


def recover_crops(members: DataFrame, loaded: DataFrame, edges: DataFrame, cfg: LinkConfig | None = None, s: CropSettings | None = None) -> DataFrame:
    """``SUBMISSIONS`` of groups (group_id, image_id, position); boxes in source pixels, scores to six digits.

    A group is recovered in one task. Images that could not be read are left out.
    """
    cfg, s = cfg or LinkConfig(), s or CropSettings()
    own = members.select(c("group_id").alias("of"), "image_id", "position").join(loaded.where("gray is not null").select("image_id", "height", "width", "scale", "gray"), "image_id")
    inside = edges.join(members.select(c("image_id").alias("a"), "group_id"), "a").join(members.select(c("image_id").alias("b"), c("group_id").alias("_g")), "b").where("group_id = _g").select(c("group_id").alias("of"), *edges.columns)
    names = [x.split()[0] for x in SUBMISSIONS.split(", ")]

    def run(key: tuple, rows: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["position", "image_id"])
        if not len(rows):
            return pd.DataFrame(columns=names)
        grays = {r.image_id: np.frombuffer(r.gray, np.uint8).reshape(r.height, r.width) for r in rows.itertuples()}
        scale = dict(zip(rows["image_id"], rows["scale"]))
        order = {k: i for i, k in enumerate(grays)}
        links = links[links["a"].isin(order) & links["b"].isin(order)]
        links = links.iloc[np.lexsort([links["b"].map(order), links["a"].map(order)])] if len(links) else links
        out = []
        for n, x in enumerate(recover(grays, links, cfg, s), 1):
            k = scale[x["image"]]
            h, w = (round(v / k) for v in grays[x["image"]].shape)
            box = [max(0, round(x["box"][0] / k)), max(0, round(x["box"][1] / k)), min(w, round(x["box"][2] / k)), min(h, round(x["box"][3] / k))]
            digits = {name: round(float(x[name]), 6) for name in ("confidence", "content_score", "occlusion_fraction")}
            out.append({"group_id": key[0], "submission_id": f"{key[0]}__submission_{n:06d}", "image_id": x["image"], "bbox": box} | {name: x[name] for name in ("kind", "side", "completeness", "reason")} | digits)
        return pd.DataFrame(out, columns=names)

    return own.groupBy("of").cogroup(inside.groupBy("of")).applyInPandas(run, SUBMISSIONS)


def by_bucket(submissions: DataFrame) -> DataFrame:
    """The submissions with the bucket that their crops belong in."""
    return submissions.withColumn("bucket", F.when(c("completeness") == "review_required", "review_queue").otherwise("submissions"))
