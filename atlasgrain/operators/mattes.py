"""Repair of cut-outs (survey rows 71, 82, 84): fringes, regions that a matte took away, and the subject above a floor line."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from ..plans.registry import query
from ..sources.frames import PX, frames
from . import kernels as K
from .frames import bounds
from .pixels import border_palette


Palette = list[tuple[int, int, int]]


def off_palette(p: np.ndarray, palette: Palette) -> np.ndarray:
    """Distance of each pixel's colour to the nearest one of a palette."""
    return np.sqrt(np.min([((p[..., :3] - np.array(c)) ** 2).sum(axis=2) for c in palette], axis=0).astype(float))


def refine_edges(p: np.ndarray, palette: Palette, threshold: float, feather: float, passes: int) -> np.ndarray:
    """Row 82: only pixels within ``passes`` of transparent ones change: cleared if near the background's colours, softened
    by a smooth step over the feather; what is left with alpha 16 or less goes. Pixel art has a feather of 0."""
    if not palette or passes <= 0:
        return p
    a, d = p[..., 3], off_palette(p, palette)
    open_to = K.dilate(a <= 16, passes) & (a > 16)
    far = max(threshold, threshold + feather)
    t = ((d - threshold) / (far - threshold)).clip(0, 1) if far > threshold else (d > threshold).astype(float)
    soft = np.rint(a * (t * t * (3.0 - 2.0 * t))).astype(np.int64)
    alpha = np.where(open_to & (d < far), np.where((d <= threshold) | (soft <= 16), 0, soft), np.where(open_to & (d <= threshold), 0, a))
    return np.where((alpha > 0)[..., None] | (a == alpha)[..., None], np.concatenate([p[..., :3], alpha[..., None]], axis=2), 0)


@query("mask_refine_edges", f"""WITH {PX}, n AS (SELECT DISTINCT o.image_id, o.i FROM px c JOIN px o ON c.image_id = o.image_id AND abs(c.x - o.x) <= 1 AND abs(c.y - o.y) <= 1 WHERE c.a <= 16),
d AS (SELECT px.image_id, a, n.i IS NOT NULL AND a > 16 AS near, sqrt((r * r + g * g + b * b)::DOUBLE) AS d FROM px LEFT JOIN n ON n.image_id = px.image_id AND n.i = px.i), t AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (d - 60.0::DOUBLE) / 140.0::DOUBLE)) AS t FROM d),
s AS (SELECT *, round_even(a * (t * t * (3.0::DOUBLE - 2.0::DOUBLE * t)), 0)::INT AS soft FROM t)
SELECT image_id, sum(CASE WHEN near AND d <= 60 THEN 0 WHEN near AND d < 200 THEN CASE WHEN soft <= 16 THEN 0 ELSE soft END ELSE a END)::BIGINT AS alpha, count(*) FILTER (near AND d <= 60)::BIGINT AS cleared FROM s GROUP BY image_id""")
def q_refine(spark, sf_dir: str) -> DataFrame:
    """Row 82 against a black background, one pass."""

    def run(p: np.ndarray) -> list[dict]:
        out = refine_edges(p, [(0, 0, 0)], 60.0, 140.0, 1)
        near = K.dilate(p[..., 3] <= 16, 1) & (p[..., 3] > 16) & (off_palette(p, [(0, 0, 0)]) <= 60)
        return [{"alpha": int(out[..., 3].sum()), "cleared": int(near.sum())}]

    return K.per_frame(frames(spark, sf_dir), run, "alpha long, cleared long")


def restore_regions(source: np.ndarray, cutout: np.ndarray, palette: Palette, off: float = 36.0, least: int | None = None, reach: int = 8, detached: bool = False) -> tuple[np.ndarray, int]:
    """Row 84: regions of the source that are clearly not background, and that the matte took away, come back opaque.

    A 4-connected region comes back if a twentieth of it (8 pixels at least) is still there; or if it lies within 8 pixels
    of the box of what is there and 3 % of it (16 pixels at least) are within ``reach`` of that; or always, if detached
    ones are accepted. Regions of under ``least`` pixels (0.05 % of the frame, 64 at least) stay away.
    """
    if not palette:
        return cutout, 0
    alpha, (h, w) = cutout[..., 3], cutout.shape[:2]
    least = max(64, int(np.rint(h * w * 0.0005))) if least is None else max(1, least)
    parts = K.label(off_palette(source, palette) > off)
    there, near, box = alpha > 16, K.dilate(alpha > 16, max(1, reach)), bounds(alpha > 0)
    back = np.zeros((h, w), dtype=bool)
    for k in np.flatnonzero(np.bincount(parts.ravel())[1:] >= least) + 1:
        region = parts == k
        n, (x0, y0, x1, y1) = int(region.sum()), bounds(region)
        overlaps = int((region & there).sum()) >= max(8, int(np.rint(n * 0.05)))
        inside = box[0] is not None and x0 >= box[0] - 8 and y0 >= box[1] - 8 and x1 <= box[2] + 8 and y1 <= box[3] + 8
        if detached or overlaps or (inside and int((region & near).sum()) >= max(16, int(np.rint(n * 0.03)))):
            back |= region & ~there
    opaque = np.concatenate([source[..., :3], np.full((h, w, 1), 255)], axis=2)
    return np.where(back[..., None], opaque, cutout), int(back.sum())


@query("mask_restore_regions")
def q_restore(spark, sf_dir: str) -> DataFrame:
    """Row 84: what a hard matte took from a frame, against its own border colours; tests hold it against a slow version."""

    def run(p: np.ndarray) -> list[dict]:
        cut = np.where((p[..., 3] >= 128)[..., None], p, 0)
        out, n = restore_regions(p, cut, border_palette(p, 28.0, 2), least=4)
        return [{"restored": n, "alpha": int(out[..., 3].sum())}]

    return K.per_frame(frames(spark, sf_dir), run, "restored long, alpha long")


def subject_box(mask: np.ndarray, baseline: int) -> tuple[int | None, ...]:
    """Row 71: bounds of the foreground, without the rows around a floor line where they are filled to over 65 %."""
    low, high = max(0, baseline - 3), min(mask.shape[0], baseline + 4)
    band = mask[low:high]
    out = mask.copy()
    if band.size and band.mean() > 0.65:
        out[low:high] = False
    return bounds(out)


@query("frame_subject_box", f"""WITH {PX}, f AS (SELECT image_id, avg((a > 16)::INT) FILTER (y >= 3) > 0.65 AS floor_ FROM px GROUP BY image_id)
SELECT px.image_id, min(x) FILTER (a > 16 AND NOT (floor_ AND y >= 3)) AS x0, min(y) FILTER (a > 16 AND NOT (floor_ AND y >= 3)) AS y0, max(x) FILTER (a > 16 AND NOT (floor_ AND y >= 3)) + 1 AS x1, max(y) FILTER (a > 16 AND NOT (floor_ AND y >= 3)) + 1 AS y1 FROM px JOIN f USING (image_id) GROUP BY px.image_id""")
def q_subject(spark, sf_dir: str) -> DataFrame:
    def run(p: np.ndarray) -> list[dict]:
        return [dict(zip(("x0", "y0", "x1", "y1"), subject_box(p[..., 3] > 16, 6), strict=True))]

    return K.per_frame(frames(spark, sf_dir), run, "x0 int, y0 int, x1 int, y1 int")
