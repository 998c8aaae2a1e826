"""From image files to the full measurements of neighbouring pairs.

PNG and PNM are decoded here, in numpy; other formats need Pillow. Points are
corners with normalised patches, which serve captures of one camera position, not
rotated or rescaled ones; where they do not suffice, two images are registered by
their pixels: phase correlation, then the rigid motion of the greatest correlation,
on a small canvas.

Plan: every image is decoded once, into working pixels and points, and written;
pairs meet them by two joins on ids and are measured in Arrow batches, of which a
task holds one. Rules and probabilities follow as columns (see ``decide``).
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import LinkConfig
from ..materialize import materialize
from . import content, pixels
from .pixels import Shape, Two

c = F.col
#: Corners are described by a patch of so many pixels a side, at a quarter of them.
PATCH, KEPT = 24, 6
#: Below this share of inliers a projective map is tried, too.
AFFINE_ENOUGH = 0.75


# --- decoding


def _png(raw: bytes) -> np.ndarray:
    """(h, w, channels) of a PNG that is not interlaced."""
    at, parts, palette, head = 8, [], None, b""
    while at + 8 <= len(raw):
        n, kind = struct.unpack(">I4s", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = body
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            parts.append(body)
        at += 12 + n
    if len(head) < 13:
        raise ValueError("PNG without a header")
    w, h, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", head[:13])
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    if interlaced:
        raise ValueError("interlaced PNG")
    width, step = (w * channels * depth + 7) // 8, max(1, channels * depth // 8)
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(h, width + 1)
    out, above = np.empty((h, width), np.uint8), np.zeros(width, np.uint8)
    for i, line in enumerate(lines):
        out[i] = above = _unfiltered(int(line[0]), line[1:], above, step)
    if depth == 16:
        out = out.reshape(h, w, channels, 2)[..., 0]
    elif depth == 8:
        out = out.reshape(h, w, channels)
    else:
        bits = np.unpackbits(out, axis=1)[:, : w * depth].reshape(h, w, depth)
        out = (bits @ (1 << np.arange(depth)[::-1])).astype(np.uint8)[..., None]
        if palette is None:
            out = out * (255 // ((1 << depth) - 1))
    return palette[out[..., 0]] if palette is not None else out


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 2:
        return line + above
    if kind == 1:
        out = np.pad(line, (0, -len(line) % step)).reshape(-1, step).cumsum(0, dtype=np.uint8)
        return out.ravel()[: len(line)]
    got, up = bytearray(line.tobytes()), above.tolist()
    for i in range(len(got)):
        left, upper = (got[i - step], up[i - step]) if i >= step else (0, 0)
        if kind == 3:
            guess = (left + up[i]) >> 1
        else:
            p, q, r = abs(up[i] - upper), abs(left - upper), abs(left + up[i] - 2 * upper)
            guess = left if p <= q and p <= r else up[i] if q <= r else upper
        got[i] = (got[i] + guess) & 255
    return np.frombuffer(bytes(got), np.uint8)


def _pnm(raw: bytes) -> np.ndarray:
    fields, at = [], 2
    while len(fields) < 3:
        while raw[at : at + 1].isspace():
            at += 1
        if raw[at : at + 1] == b"#":
            at = raw.index(b"\n", at)
            continue
        end = at
        while not raw[end : end + 1].isspace():
            end += 1
        fields.append(int(raw[at:end]))
        at = end
    w, h, top = fields
    found = np.frombuffer(raw[at + 1 :], np.uint8 if top < 256 else ">u2").reshape(h, w, -1)
    return found if top == 255 else (found.astype(float) * 255 / top).round().astype(np.uint8)


def decode(raw: bytes) -> np.ndarray:
    """(h, w, channels) pixels of an image file; a ValueError where it cannot be read."""
    try:
        if raw[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(raw)
        if raw[:2] in (b"P5", b"P6"):
            return _pnm(raw)
    except (IndexError, KeyError, struct.error, zlib.error) as error:
        raise ValueError(f"broken image: {error}") from error
    try:
        from PIL import Image
    except ImportError:
        raise ValueError("only PNG and PNM are read without Pillow") from None
    try:
        return np.asarray(Image.open(io.BytesIO(raw)).convert("RGB"))
    except OSError as error:
        raise ValueError(f"broken image: {error}") from error


def as_colour(image: np.ndarray) -> np.ndarray:
    """(h, w, 3), transparency left out."""
    return image[..., :3] if image.shape[2] >= 3 else np.repeat(image[..., :1], 3, axis=2)


def as_gray(image: np.ndarray) -> np.ndarray:
    """Luma of weights .299, .587 and .114."""
    return image[..., 0] if image.shape[2] < 3 else (image[..., :3] @ np.array([0.299, 0.587, 0.114])).round().astype(np.uint8)


def area_resized(image: np.ndarray, shape: Shape) -> np.ndarray:
    """The image shrunken to a shape; every pixel is the mean of the area it comes from."""

    def along(x: np.ndarray, axis: int, n: int) -> np.ndarray:
        size = x.shape[axis]
        total = np.concatenate([np.zeros_like(x.take([0], axis)), x.cumsum(axis)], axis)
        edge = np.linspace(0, size, n + 1)
        low = np.minimum(edge.astype(int), size - 1)
        part = (edge - low).reshape([-1 if a == axis else 1 for a in range(x.ndim)])
        at_edge = total.take(low, axis) + part * x.take(low, axis)
        return np.diff(at_edge, axis=axis) * (n / size)

    return np.clip(along(along(image.astype(np.float64), 0, shape[0]), 1, shape[1]).round(), 0, 255).astype(np.uint8)


def bounded(image: np.ndarray, most: int, least: int = 1) -> tuple[np.ndarray, float]:
    """The image with no side above ``most``, nor below ``least``, and the scale."""
    h, w = image.shape[:2]
    scale = min(1.0, most / max(h, w))
    return (area_resized(image, (max(least, round(h * scale)), max(least, round(w * scale)))), scale) if scale < 1 else (image, 1.0)


# --- points


def corners(gray: np.ndarray, most: int) -> np.ndarray:
    """(n, 2) places x, y where both gradients are strong, to fractions of a pixel, the strongest first, none next to another."""
    across, down = content.steepness(content.soft(gray, 1.0), 1, 2)
    xx, yy, xy = (content.soft(v, 1.5) for v in (across * across, down * down, across * down))
    least = (xx + yy) / 2 - np.hypot((xx - yy) / 2, xy)
    reach = 3
    peak = np.lib.stride_tricks.sliding_window_view(np.pad(least, reach), (2 * reach + 1, 2 * reach + 1)).max((2, 3))
    half = PATCH // 2
    inside = np.zeros(gray.shape, bool)
    inside[half : gray.shape[0] - half, half : gray.shape[1] - half] = True
    y, x = np.nonzero((least == peak) & (least > 0.01 * least.max(initial=0)) & inside)
    order = np.argsort(-least[y, x], kind="stable")[:most]
    y, x = y[order], x[order]

    def peak_of(before: np.ndarray, at: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Where the parabola through three neighbours is highest."""
        return np.clip((before - after) / (2 * np.minimum(before - 2 * at + after, -1e-9)), -0.5, 0.5)

    across, down = (peak_of(least[y - b, x - a], least[y, x], least[y + b, x + a]) for a, b in ((1, 0), (0, 1)))
    return np.stack([x + across, y + down], axis=1).astype(np.float32)


def patches(gray: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Unit vectors without mean of the pixels around the points."""
    if not len(points):
        return np.zeros((0, KEPT * KEPT), np.float32)
    step, half = PATCH // KEPT, PATCH // 2
    smooth = content.soft(gray, step / 2)
    offset = np.arange(KEPT) * step - half + step // 2
    at = points.round().astype(int)
    found = smooth[at[:, 1, None, None] + offset[None, :, None], at[:, 0, None, None] + offset[None, None, :]].reshape(len(points), -1)
    found = found - found.mean(1, keepdims=True)
    return (found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-6)).astype(np.float32)


# --- registration


@dataclass
class Registered:
    """How the second image lies on the first; ``matrix`` maps its points."""

    accepted: bool = False
    reason: str | None = None
    model: str | None = None
    matrix: np.ndarray | None = None
    measures: dict[str, float] = field(default_factory=dict)


def robust_homography(moving: np.ndarray, still: np.ndarray, reach: float = 3.5, tries: int = 600, seed: int = 0) -> tuple[np.ndarray | None, np.ndarray]:
    """The projective map that most points agree on within ``reach`` pixels, refitted to them; null with fewer than four points."""
    best = np.zeros(len(moving), bool)
    if len(moving) < 4:
        return None, best

    def fit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        (x, y), (u, v), o, z = a.T, b.T, np.ones(len(a)), np.zeros(len(a))
        rows = np.concatenate([np.stack([x, y, o, z, z, z, -u * x, -u * y, -u], 1), np.stack([z, z, z, x, y, o, -v * x, -v * y, -v], 1)])
        return np.linalg.svd(rows)[2][-1].reshape(3, 3)

    def inside(m: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            return np.nan_to_num(np.linalg.norm(pixels.moved(m, moving) - still, axis=1), nan=np.inf) <= reach

    rng = np.random.default_rng(seed)
    for _ in range(tries):
        pick = rng.choice(len(moving), 4, replace=False)
        found = inside(fit(moving[pick], still[pick]))
        best = found if found.sum() > best.sum() else best
    if best.sum() < 4:
        return None, best
    m = fit(moving[best], still[best])
    return (m / m[2, 2], best) if abs(m[2, 2]) > 1e-12 else (None, best)


def flattened(image: np.ndarray) -> np.ndarray:
    """The image without its broad shading, of mean 0 and deviation 1."""
    x = np.asarray(image, np.float32) / 255
    x = pixels.blur(x - content.soft(x, max(5.0, min(x.shape) * 0.03)), 5)
    return (x - x.mean()) / max(float(x.std()), 1e-6)


def phase_shift(a: np.ndarray, b: np.ndarray) -> tuple[float, float, float]:
    """(dx, dy, response): how far b lies from a, and the share of the correlation's energy around its peak."""
    window = np.outer(np.hanning(a.shape[0]), np.hanning(a.shape[1]))
    cross = np.fft.rfft2(b * window) * np.conj(np.fft.rfft2(a * window))
    found = np.fft.irfft2(cross / np.maximum(np.abs(cross), 1e-12), s=a.shape)
    y, x = np.unravel_index(found.argmax(), found.shape)
    around = found[np.ix_(np.arange(y - 2, y + 3) % a.shape[0], np.arange(x - 2, x + 3) % a.shape[1])]
    wrap = lambda v, n: float(v - n if v > n / 2 else v)
    return wrap(x, a.shape[1]), wrap(y, a.shape[0]), float(around.sum())


def rigid_alignment(a: np.ndarray, b: np.ndarray, start: np.ndarray, rounds: int, epsilon: float) -> tuple[float, np.ndarray] | None:
    """(correlation, map from a to b): Gauss-Newton steps of the enhanced correlation over an angle and a shift; null where they diverge."""
    gy, gx = np.gradient(b)
    stack = np.stack([b, gx, gy]).astype(np.float32)
    y, x = np.mgrid[: a.shape[0], : a.shape[1]].astype(np.float32)
    h, w = b.shape
    angle, tx, ty = float(np.arctan2(start[1, 0], start[0, 0])), float(start[0, 2]), float(start[1, 2])
    last = -1.0
    for _ in range(rounds):
        cos, sin = np.cos(angle), np.sin(angle)
        m = np.array([[cos, -sin, tx], [sin, cos, ty], [0, 0, 1]])
        u, v = np.float32(cos) * x - np.float32(sin) * y + np.float32(tx), np.float32(sin) * x + np.float32(cos) * y + np.float32(ty)
        valid = (u >= 0) & (v >= 0) & (u < w - 1) & (v < h - 1)
        if valid.sum() < 100:
            return None
        u, v = u[valid], v[valid]
        i, j = v.astype(np.int32), u.astype(np.int32)
        p, q = v - i, u - j
        seen, dx, dy = (1 - p) * ((1 - q) * stack[:, i, j] + q * stack[:, i, j + 1]) + p * ((1 - q) * stack[:, i + 1, j] + q * stack[:, i + 1, j + 1])
        t, s = a[valid] - a[valid].mean(), seen - seen.mean()
        correlation = float(t @ s / max(np.sqrt((t @ t) * (s @ s)), 1e-12))
        jacobian = np.stack([dx * (-sin * x[valid] - cos * y[valid]) + dy * (cos * x[valid] - sin * y[valid]), dx, dy], axis=1).astype(np.float64)
        if abs(correlation - last) < epsilon:
            return correlation, m
        last = correlation
        hessian = jacobian.T @ jacobian
        try:
            inverse = np.linalg.inv(hessian)
        except np.linalg.LinAlgError:
            return None
        js, jt = jacobian.T @ s, jacobian.T @ t
        above, below = s @ s - js @ inverse @ js, t @ s - jt @ inverse @ js
        if below <= 0:
            return None
        angle, tx, ty = np.array([angle, tx, ty]) + inverse @ (jacobian.T @ (above / below * t - s))
    return last, m


def by_pixels(still: np.ndarray, moving: np.ndarray, seed: np.ndarray | None, matches: int, cfg: LinkConfig) -> Registered:
    """Registration of small motions without points."""

    def refused(reason: str, used: bool = True, score: float = 0.0) -> Registered:
        return Registered(reason=reason, measures={"registration_alignment_score": score, "registration_fallback_used": used, "good_match_count": matches})

    shape = max(still.shape[0], moving.shape[0]), max(still.shape[1], moving.shape[1])

    def canvas(image: np.ndarray, most: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """On a common canvas, shrunken; and the map from the image's points to there."""
        border = np.concatenate([image[0], image[-1], image[:, 0], image[:, -1]])
        out = np.full(shape, int(np.median(border)), np.uint8)
        y, x = (shape[0] - image.shape[0]) // 2, (shape[1] - image.shape[1]) // 2
        out[y : y + image.shape[0], x : x + image.shape[1]] = image
        small, _ = bounded(out, most, least)
        sx, sy = small.shape[1] / shape[1], small.shape[0] / shape[0]
        return flattened(small), np.array([[sx, 0, sx * x], [0, sy, sy * y], [0, 0, 1]])

    coarse = [canvas(x, cfg.ecc_coarse_dimension, 32)[0] for x in (still, moving)]
    response = phase_shift(*coarse)[2]
    seeded = seed is not None and small_motion(seed, moving.shape, still.shape, cfg)
    if not seeded and matches < cfg.ecc_min_descriptor_matches and response < cfg.ecc_min_phase_correlation:
        return refused("too little evidence of a small motion", False, response)
    if not cfg.ecc_fallback_enabled:
        return refused("registration by pixels is off", False, response)
    aspect = (still.shape[1] / still.shape[0]) / (moving.shape[1] / moving.shape[0])
    if not 0.85 <= aspect <= 1.18:
        return refused("image shapes differ too much", True, response)
    (a, to_a), (b, to_b) = (canvas(x, cfg.ecc_working_dimension, 64) for x in (still, moving))
    if seeded:
        start = to_b @ np.linalg.inv(seed) @ np.linalg.inv(to_a)
    else:
        dx, dy, strength = phase_shift(a, b)
        start = np.array([[1, 0, dx], [0, 1, dy], [0, 0, 1.0]]) if strength >= cfg.ecc_min_phase_correlation else np.eye(3)
    found = rigid_alignment(a, b, start, cfg.ecc_max_iterations, cfg.ecc_epsilon)
    if found is None:
        return refused("registration by pixels did not converge", True, response)
    correlation, m = found
    affine = np.linalg.inv(to_a) @ np.linalg.inv(m) @ to_b
    if correlation < cfg.ecc_min_correlation or not small_motion(affine, moving.shape, still.shape, cfg, scaled=False):
        return refused("registration by pixels out of bounds", True, correlation)
    measures = {
        "inlier_ratio": correlation, "registration_alignment_score": correlation, "x_span": 1.0, "y_span": 1.0,
        "registration_fallback_used": True, "good_match_count": matches, "inlier_count": 0, "feature_overlap": 0.0,
    }
    return Registered(True, None, "rigid_by_pixels", affine, measures)


def small_motion(m: np.ndarray, shape: Shape, onto: Shape, cfg: LinkConfig, scaled: bool = True) -> bool:
    """Whether a map moves a page no more than a hand between two captures."""
    if not np.isfinite(m).all():
        return False
    angle, scale = np.degrees(np.arctan2(m[1, 0], m[0, 0])), np.hypot(m[0, 0], m[1, 0])
    shift = abs(m[0, 2]) / onto[1], abs(m[1, 2]) / onto[0]
    return bool((not scaled or 0.85 <= scale <= 1.18) and abs(angle) <= cfg.ecc_max_rotation_degrees and max(shift) <= cfg.ecc_max_translation_fraction and pixels.plausible(m, shape, onto))


def register(still: np.ndarray, moving: np.ndarray, points: Two, described: Two, cfg: LinkConfig) -> Registered:
    """The better of an affine and a projective fit to matched points, else registration by pixels."""
    pairs = pixels.match_points(described[1], described[0], cfg.ratio_test)
    ours, theirs = points[1][pairs[:, 0]].astype(float), points[0][pairs[:, 1]].astype(float)
    if len(pairs) < cfg.min_inliers:
        seed = pixels.robust_affine(ours, theirs, 2 * cfg.ransac_reprojection_px)[0] if len(pairs) >= 4 else None
        return by_pixels(still, moving, seed, len(pairs), cfg)
    affine, inside = pixels.robust_affine(ours, theirs, cfg.ransac_reprojection_px)
    least = max(1, min(map(len, points)))
    fits = []

    def checked(model: str, m: np.ndarray | None, agree: np.ndarray) -> None:
        got = pixels.registration_checks(m, agree, ours, theirs, moving.shape, still.shape, cfg)
        if got:
            n = int(agree.sum())
            fits.append(Registered(True, None, model, m, got | {"inlier_count": n, "feature_overlap": n / least, "good_match_count": len(pairs), "registration_alignment_score": got["inlier_ratio"], "registration_fallback_used": False}))

    checked("affine", affine, inside)
    if not fits or fits[0].measures["inlier_ratio"] < AFFINE_ENOUGH:
        checked("homography", *robust_homography(ours, theirs, cfg.ransac_reprojection_px))
    if not fits:
        return by_pixels(still, moving, affine, len(pairs), cfg)
    return max(fits, key=lambda f: (f.measures["inlier_count"], f.measures["inlier_ratio"], -f.measures["median_reprojection_error"]))


# --- Spark

LOADED = "image_id string, height int, width int, scale double, gray binary, points binary, described binary, error string"
COUNTS = ("good_match_count", "inlier_count", *content.WHOLE)
REALS = (
    "inlier_ratio", "feature_overlap", "median_reprojection_error", "registration_alignment_score", "x_span", "y_span", "valid_fraction", "changed_fraction", "stable_fraction",
    "tiles_changed_fraction", "largest_change_share", *(k for k in content.UNSEEN if k not in content.WHOLE),
)
NONE = dict.fromkeys(COUNTS, 0) | dict.fromkeys(REALS, 0.0) | content.UNSEEN | {"changed_fraction": 1.0, "tiles_changed_fraction": 1.0, "registration_fallback_used": False}


def load_images(images: DataFrame, cfg: LinkConfig | None = None) -> DataFrame:
    """``LOADED`` of images (image_id, content): working pixels and points. What cannot be read has no pixels and says why."""
    cfg = cfg or LinkConfig()

    def one(raw: bytes | None) -> list:
        try:
            gray, scale = bounded(as_gray(decode(bytes(raw or b""))), cfg.max_working_dimension)
        except ValueError as error:
            return [None, None, None, None, None, None, str(error)]
        at = corners(gray, cfg.max_features)
        return [*gray.shape, scale, gray.tobytes(), at.tobytes(), patches(gray, at).tobytes(), None]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame([[key, *one(raw)] for key, raw in rows[["image_id", "content"]].itertuples(index=False)], columns=[x.split()[0] for x in LOADED.split(", ")]).astype({"height": "Int32", "width": "Int32"})

    return images.select("image_id", "content").mapInPandas(run, LOADED)


def score_one(a: dict, b: dict, cfg: LinkConfig) -> dict:
    """All measurements of two loaded images."""
    if a["gray"] is None or b["gray"] is None:
        return NONE | {"registration_reason": "image cannot be read", "registration_model": None, "transform": None}
    gray = [np.frombuffer(x["gray"], np.uint8).reshape(int(x["height"]), int(x["width"])) for x in (a, b)]
    points = tuple(np.frombuffer(x["points"], np.float32).reshape(-1, 2) for x in (a, b))
    described = tuple(np.frombuffer(x["described"], np.float32).reshape(-1, KEPT * KEPT) for x in (a, b))
    found = register(gray[0], gray[1], points, described, cfg)
    out = NONE | found.measures | {"registration_reason": found.reason, "registration_model": found.model, "transform": None}
    if not found.accepted:
        return out
    aligned, valid = pixels.warp(gray[1].astype(float), found.matrix, gray[0].shape)
    source = np.diag([1 / a["scale"], 1 / a["scale"], 1]) @ found.matrix @ np.diag([b["scale"], b["scale"], 1])
    aligned = np.where(valid, aligned, 255.0)
    return out | content.measure(gray[0].astype(float), aligned, valid, cfg) | {"transform": (source / source[2, 2]).tolist()}


def score_images(pairs: DataFrame, loaded: DataFrame, cfg: LinkConfig | None = None) -> DataFrame:
    """``pairs`` (first_image_id, second_image_id and more) with registration_reason, registration_model, transform and all measurements."""
    cfg = cfg or LinkConfig()
    kept = [f.name for f in pairs.schema.fields]
    image = F.struct("height", "width", "scale", "gray", "points", "described")
    both = pairs.join(loaded.select(c("image_id").alias("first_image_id"), image.alias("_a")), "first_image_id").join(loaded.select(c("image_id").alias("second_image_id"), image.alias("_b")), "second_image_id")
    made = ["registration_reason", "registration_model", "transform", "registration_fallback_used", *COUNTS, *REALS]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            got = [score_one(a, b, cfg) for a, b in zip(rows["_a"], rows["_b"])]
            yield pd.concat([rows[kept].reset_index(drop=True), pd.DataFrame(got, columns=made)], axis=1)

    types = ["string", "string", "array<array<double>>", "boolean", *["int"] * len(COUNTS), *["double"] * len(REALS)]
    schema = ", ".join([f"`{n}` {t}" for n, t in pairs.dtypes] + [f"{n} {t}" for n, t in zip(made, types)])
    return both.select(*kept, "_a", "_b").mapInPandas(run, schema)


def measured_pairs(images: DataFrame, contents: DataFrame, cfg: LinkConfig | None = None) -> DataFrame:
    """Neighbouring pairs of images (image_id, path, sequence_id, sequence_index) with measurements, from contents (image_id, content)."""
    from .pairs import neighbour_pairs

    cfg = cfg or LinkConfig()
    near = neighbour_pairs(images, "sequence_id", ["sequence_index"], ["image_id"], cfg.max_gap)
    pairs = near.select("sequence_id", c("a.image_id").alias("first_image_id"), c("b.image_id").alias("second_image_id"), c("gap").cast("int").alias("index_gap"))
    return score_images(pairs, materialize(load_images(contents, cfg)), cfg)
