"""Pixel kernels in numpy, and the scan that scores aligned pairs of gray images.

Feature detectors need an image library and stay behind ``match_points``' inputs:
descriptors and points come from outside. What follows from them (matching,
robust fit, plausibility, warp, exposure, dissimilarity, tiles, ink) is here.
Kernels follow published definitions and are close to, not bit for bit equal
with, those of image libraries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..config import LinkConfig

Shape = tuple[int, int]
Two = tuple[np.ndarray, np.ndarray]

# --- filters ---


def _taps(size: int) -> np.ndarray:
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    x = np.arange(size) - size // 2
    w = np.exp(-(x**2) / (2 * sigma**2))
    return w / w.sum()


def _along(image: np.ndarray, taps: np.ndarray, axis: int) -> np.ndarray:
    half = len(taps) // 2
    pad = [(half, half) if a == axis else (0, 0) for a in (0, 1)]
    padded = np.pad(image, pad, mode="reflect" if image.shape[axis] > half else "edge")
    windows = np.lib.stride_tricks.sliding_window_view(padded, len(taps), axis=axis)
    return windows @ taps


def blur(image: np.ndarray, size: int) -> np.ndarray:
    return _along(_along(np.asarray(image, np.float64), _taps(size), 0), _taps(size), 1)


def spread(mask: np.ndarray, reach: int) -> np.ndarray:
    """Dilation by a square."""
    out = mask
    for axis in (0, 1):
        padded = np.pad(out, [(reach, reach) if a == axis else (0, 0) for a in (0, 1)])
        out = np.lib.stride_tricks.sliding_window_view(padded, 2 * reach + 1, axis=axis).any(-1)
    return out


def shrink(mask: np.ndarray, reach: int) -> np.ndarray:
    return ~spread(~mask, reach)


def components(mask: np.ndarray) -> np.ndarray:
    """Labels from 1 of the 8-connected parts."""
    labels = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        padded = np.pad(labels, 1)
        best = np.lib.stride_tricks.sliding_window_view(padded, (3, 3)).max((2, 3)) * mask
        if (best == labels).all():
            return np.unique(labels, return_inverse=True)[1].reshape(mask.shape) if not mask.all() else np.ones(mask.shape, int)
        labels = best


# --- registration ---


def match_points(a: np.ndarray, b: np.ndarray, ratio: float = 0.72) -> np.ndarray:
    """(n, 2) indexes of descriptors of a and b: nearest, and clearly nearer than the second nearest."""
    if len(a) < 1 or len(b) < 2:
        return np.zeros((0, 2), int)
    far = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T
    two = np.argpartition(far, 1, axis=1)[:, :2]
    two = np.take_along_axis(two, np.argsort(np.take_along_axis(far, two, 1), axis=1), 1)
    d = np.sqrt(np.maximum(np.take_along_axis(far, two, 1), 0))
    good = d[:, 0] < ratio * d[:, 1]
    return np.stack([np.flatnonzero(good), two[good, 0]], axis=1)


def fit_affine(moving: np.ndarray, still: np.ndarray) -> np.ndarray:
    """The least-squares 3x3 affine map."""
    m, *_ = np.linalg.lstsq(np.c_[moving, np.ones(len(moving))], still, rcond=None)
    return np.vstack([m.T, [0, 0, 1]])


def moved(m: np.ndarray, points: np.ndarray) -> np.ndarray:
    h = np.c_[points, np.ones(len(points))] @ m.T
    return h[:, :2] / h[:, 2:]


def robust_affine(moving: np.ndarray, still: np.ndarray, reach: float = 3.5, tries: int = 400, seed: int = 0) -> tuple[np.ndarray | None, np.ndarray]:
    """The map that most points agree on within ``reach`` pixels, refitted to them; null with fewer than three points."""
    best = np.zeros(len(moving), bool)
    if len(moving) < 3:
        return None, best
    rng = np.random.default_rng(seed)
    for _ in range(tries):
        pick = rng.choice(len(moving), 3, replace=False)
        inside = np.linalg.norm(moved(fit_affine(moving[pick], still[pick]), moving) - still, axis=1) <= reach
        if inside.sum() > best.sum():
            best = inside
    return (fit_affine(moving[best], still[best]), best) if best.sum() >= 3 else (None, best)


def plausible(m: np.ndarray, shape: Shape, onto: Shape) -> bool:
    """Whether the moved page keeps a sensible area and covers enough of the other."""
    h, w = shape
    corner = moved(m, np.array([[0, 0], [w - 1, 0], [w - 1, h - 1], [0, h - 1]], float))
    if not np.isfinite(corner).all():
        return False
    x, y = corner.T
    diagonals = corner[2:] - corner[:2]
    area = abs(diagonals[0, 0] * diagonals[1, 1] - diagonals[0, 1] * diagonals[1, 0]) / 2 / max(w * h, 1)
    return bool(0.45 <= area <= 2.2 and np.ptp(x) >= 0.35 * onto[1] and np.ptp(y) >= 0.35 * onto[0])


def registration_checks(m: np.ndarray | None, inside: np.ndarray, moving: np.ndarray, still: np.ndarray, shape: Shape, onto: Shape, cfg: LinkConfig) -> dict[str, float] | None:
    """Inlier ratio, spans and error of a fit that passes every check, or null."""
    n = int(inside.sum())
    if m is None or n < cfg.min_inliers or n / len(inside) < cfg.min_inlier_ratio or not plausible(m, shape, onto):
        return None
    at = still[inside]
    cells = len(set(map(tuple, np.floor(at / np.array([onto[1], onto[0]]) * 4).astype(int))))
    spans = np.ptp(at, axis=0) / np.array([onto[1], onto[0]])
    error = float(np.median(np.linalg.norm(moved(m, moving[inside]) - at, axis=1)))
    if cells < cfg.min_grid_cells or spans[0] < cfg.min_x_span or spans[1] < cfg.min_y_span or error > 0.015 * np.hypot(*onto):
        return None
    return {"inlier_ratio": n / len(inside), "x_span": float(spans[0]), "y_span": float(spans[1]), "median_reprojection_error": error}


def warp(image: np.ndarray, m: np.ndarray, shape: Shape) -> Two:
    """The image seen through the map, bilinear, and where it has pixels."""
    y, x = np.mgrid[: shape[0], : shape[1]]
    u, v = moved(np.linalg.inv(m), np.stack([x.ravel(), y.ravel()], 1).astype(float)).T
    h, w = image.shape
    valid = (u >= 0) & (v >= 0) & (u <= w - 1) & (v <= h - 1)
    u, v = np.clip(u, 0, w - 1), np.clip(v, 0, h - 1)
    i, j = np.minimum(v.astype(int), h - 2 if h > 1 else 0), np.minimum(u.astype(int), w - 2 if w > 1 else 0)
    a, b = v - i, u - j
    i1, j1 = np.minimum(i + 1, h - 1), np.minimum(j + 1, w - 1)
    out = (1 - a) * ((1 - b) * image[i, j] + b * image[i, j1]) + a * ((1 - b) * image[i1, j] + b * image[i1, j1])
    return out.reshape(shape), valid.reshape(shape)


def match_exposure(still: np.ndarray, aligned: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """The aligned image brought to the other's median and spread over the valid pixels."""
    if not valid.any():
        return aligned
    middle = lambda x: np.median(x[valid])
    mad = lambda x: np.median(np.abs(x[valid] - middle(x)))
    # a page that is mostly background has no spread to go by
    gain = np.clip(mad(still) / mad(aligned), 0.6, 1.6) if min(mad(still), mad(aligned)) >= 1 else 1.0
    return np.clip((aligned - middle(aligned)) * gain + middle(still), 0, 255)


# --- content ---


def dissimilarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """0 to 1 at every pixel: a blurred absolute difference and the lack of structural similarity."""
    a, b = np.asarray(a, np.float64) / 255, np.asarray(b, np.float64) / 255
    ma, mb = blur(a, 11), blur(b, 11)
    va, vb = np.maximum(blur(a * a, 11) - ma * ma, 0), np.maximum(blur(b * b, 11) - mb * mb, 0)
    both = blur(a * b, 11) - ma * mb
    luminance = (2 * ma * mb + 1e-4) / (ma * ma + mb * mb + 1e-4)
    structure = (2 * both + 9e-4) / (va + vb + 9e-4)
    return np.clip(0.55 * blur(np.abs(a - b), 9) + 0.45 * (1 - np.clip(luminance * structure, -1, 1)), 0, 1)


def _tiles(shape: Shape, rows: int, columns: int) -> Iterator[tuple[int, int, slice, slice]]:
    at = lambda i, n, size: round(i * size / n)
    for r in range(rows):
        for k in range(columns):
            yield r, k, slice(at(r, rows, shape[0]), at(r + 1, rows, shape[0])), slice(at(k, columns, shape[1]), at(k + 1, columns, shape[1]))


def tile_scores(values: np.ndarray, core: np.ndarray, cfg: LinkConfig) -> np.ndarray:
    """Mean and upper tail of each content tile; NaN where too little of it is seen."""
    out = np.full((cfg.content_tile_rows, cfg.content_tile_columns), np.nan)
    for r, k, ys, xs in _tiles(values.shape, *out.shape):
        seen = values[ys, xs][core[ys, xs]]
        if core[ys, xs].size and core[ys, xs].mean() >= 0.5 and seen.size >= 20:
            tail = np.sort(seen)[-max(1, round(cfg.residual_upper_tail_fraction * seen.size)) :]
            out[r, k] = 0.4 * seen.mean() + 0.6 * tail.mean()
    return out


def changed_tiles(scores: np.ndarray, cfg: LinkConfig) -> Two:
    """z against the calmest tiles' median and deviation, and which tiles stand out; small holes are closed."""
    valid = ~np.isnan(scores)
    if not valid.any():
        return np.zeros_like(scores), valid
    calm = np.sort(scores[valid])[: max(4, round(cfg.residual_stable_fraction * valid.sum()))]
    scale = max(1.4826 * np.median(np.abs(calm - np.median(calm))), cfg.residual_min_scale)
    z = np.where(valid, (np.nan_to_num(scores) - np.median(calm)) / scale, 0)
    out = valid & (z >= cfg.residual_changed_z_threshold) & (np.nan_to_num(scores) >= cfg.residual_changed_min_absolute)
    p = np.pad(out, 1)
    grown = p.copy()
    grown[1:-1, 1:-1] |= p[:-2, 1:-1] | p[2:, 1:-1] | p[1:-1, :-2] | p[1:-1, 2:]
    q = np.pad(grown, 1, constant_values=True)[1:-1, 1:-1]
    closed = q[1:-1, 1:-1].copy()
    for dy, dx in ((0, 1), (2, 1), (1, 0), (1, 2)):
        side = grown[dy : dy + out.shape[0], dx : dx + out.shape[1]]
        inside = np.ones_like(out)
        inside[0 if dy == 0 else slice(None), :] &= dy != 0
        closed &= side | ~inside if dy == 0 else side
    return z, (out | closed) & valid


def otsu(values: np.ndarray, bins: int = 256) -> float:
    counts, edges = np.histogram(values, bins)
    middle = (edges[1:] + edges[:-1]) / 2
    below, total = np.cumsum(counts), counts.sum()
    sums = np.cumsum(counts * middle)
    with np.errstate(invalid="ignore", divide="ignore"):
        between = (sums[-1] * below / total - sums) ** 2 / (below * (total - below))
    return float(middle[np.nanargmax(np.nan_to_num(between))])


def ink_response(image: np.ndarray, cfg: LinkConfig) -> np.ndarray:
    """How much darker than its surroundings a pixel is, and how steep its edges are."""
    x = np.asarray(image, np.float64) / 255
    size = max(3, 2 * round(min(x.shape) * cfg.ink_background_sigma_fraction * 3) + 1)
    gy, gx = np.gradient(x)
    return np.maximum(blur(x, size) - x, 0) + cfg.ink_gradient_weight * np.hypot(gx, gy)


def ink_masks(a: np.ndarray, b: np.ndarray, core: np.ndarray, cfg: LinkConfig) -> Two:
    """Ink in both images under one threshold."""
    ra, rb = ink_response(a, cfg), ink_response(b, cfg)
    seen = np.concatenate([ra[core], rb[core]])
    limit = max(cfg.ink_min_response, otsu(seen)) if seen.size else cfg.ink_min_response
    return (ra >= limit) & core, (rb >= limit) & core


def unmatched_ink(a: np.ndarray, b: np.ndarray, core: np.ndarray, cfg: LinkConfig) -> Two:
    """Ink of one image without ink of the other nearby, and all ink."""
    ia, ib = ink_masks(a, b, core, cfg)
    reach = max(1, round(min(a.shape) * cfg.ink_tolerance_fraction))
    return ((ia & ~spread(ib, reach)) | (ib & ~spread(ia, reach))) & core, ia | ib


METRICS = ("valid_fraction", "changed_fraction", "tiles_changed_fraction", "largest_change_share", "unmatched_ink_fraction", "unmatched_ink_union_fraction", "ink_mismatch_tiles_fraction", "residual_tiles_changed_fraction")
PESSIMISTIC = dict(zip(METRICS, (0.0, 1.0, 1.0, 0.0, 1.0, 1.0, 1.0, 1.0)))


def pair_metrics(still: np.ndarray, aligned: np.ndarray, valid: np.ndarray, cfg: LinkConfig) -> dict[str, float]:
    """Change and ink metrics of an aligned pair; with fewer than 1000 common pixels, the pessimistic ones."""
    core = shrink(valid, 4)
    if core.sum() < 1000:
        return PESSIMISTIC | {"valid_fraction": float(core.mean())}
    aligned = match_exposure(still, aligned, core)
    far = dissimilarity(still, aligned)
    changed = (far > cfg.change_threshold) & core
    coarse = [changed[ys, xs][core[ys, xs]].mean() > cfg.tile_changed_threshold for _, _, ys, xs in _tiles(core.shape, cfg.tile_rows, cfg.tile_columns) if core[ys, xs].mean() >= 0.5]
    areas = np.bincount(components(spread(shrink(changed, 2), 2)).ravel())[1:]
    mismatch, ink = unmatched_ink(still, aligned, core, cfg)
    tiles = tile_scores(far, core, cfg)
    seen = ~np.isnan(tiles)
    loud = np.zeros_like(seen)
    for r, k, ys, xs in _tiles(core.shape, *tiles.shape):
        m, u = mismatch[ys, xs][core[ys, xs]], ink[ys, xs][core[ys, xs]]
        loud[r, k] = bool(seen[r, k] and m.sum() / max(u.sum(), 10) >= cfg.ink_tile_union_threshold and m.mean() >= cfg.ink_tile_valid_threshold)
    return {
        "valid_fraction": float(core.mean()),
        "changed_fraction": float(changed.sum() / core.sum()),
        "tiles_changed_fraction": float(np.mean(coarse)) if coarse else 1.0,
        "largest_change_share": float(areas.max() / areas.sum()) if areas.size and areas.sum() else 0.0,
        "unmatched_ink_fraction": float(mismatch.sum() / core.sum()),
        "unmatched_ink_union_fraction": float(mismatch.sum() / max(ink.sum(), 1)),
        "ink_mismatch_tiles_fraction": float(loud.sum() / max(seen.sum(), 1)),
        "residual_tiles_changed_fraction": float(changed_tiles(tiles, cfg)[1].sum() / max(seen.sum(), 1)),
    }


def gutter(image: np.ndarray, cfg: LinkConfig) -> int | None:
    """The column of a dark fold in the middle of a wide image, or null."""
    h, w = image.shape
    if w / h < cfg.gutter_min_aspect_ratio:
        return None
    profile = 1 - np.asarray(image, float).mean(0) / 255
    low, high = round(w * cfg.gutter_search_min_fraction), round(w * cfg.gutter_search_max_fraction)
    at = low + int(profile[low:high].argmax())
    return at if profile[at] - np.median(profile[low:high]) >= cfg.gutter_min_prominence else None


# --- fingerprints of whole images ---


def fingerprint(image: np.ndarray, size: int = 96) -> np.ndarray:
    """Unit vector of the shrunken, contrast-normalised image and its gradients."""
    edges = lambda n: np.linspace(0, n, size + 1).astype(int)
    x = np.add.reduceat(np.add.reduceat(np.asarray(image, float), edges(image.shape[0])[:-1], 0), edges(image.shape[1])[:-1], 1)
    low, high = np.percentile(x, [2, 98])
    x = np.clip((x - low) / (high - low), 0, 1) if high > low else np.zeros_like(x)
    gy, gx = np.gradient(x)
    v = np.concatenate([x.ravel(), np.hypot(gx, gy).ravel()])
    v -= v.mean()
    return v / max(np.linalg.norm(v), 1e-12)


def correlation(a: np.ndarray, b: np.ndarray) -> float:
    return float(a @ b) if a.size == b.size else -1.0


def score_pairs(pairs: DataFrame, cfg: LinkConfig | None = None) -> DataFrame:
    """The metrics of pairs (pair_id, height, width, first_gray, second_gray, valid): raw bytes of aligned images; valid may be null for all."""
    cfg = cfg or LinkConfig()
    kind = dict(pairs.dtypes)["pair_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for key, h, w, a, b, valid in rows[["pair_id", "height", "width", "first_gray", "second_gray", "valid"]].itertuples(index=False):
                image = lambda raw: np.frombuffer(raw, np.uint8).reshape(h, w)  # noqa: B023, E731
                mask = np.ones((h, w), bool) if valid is None else image(valid) > 0
                out.append({"pair_id": key} | pair_metrics(image(a).astype(float), image(b).astype(float), mask, cfg))
            yield pd.DataFrame(out, columns=["pair_id", *METRICS])

    return pairs.mapInPandas(run, f"pair_id {kind}, " + ", ".join(f"{m} double" for m in METRICS))
