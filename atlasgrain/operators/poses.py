"""Poses and limbs (survey rows 93, 149, 150): where a pose stands and how tall it is, and gates over sequences."""

from __future__ import annotations

import math
from dataclasses import dataclass
from statistics import median

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.frames import PX, frames
from . import kernels as K
from .frames import bounds
from .integrity import table
from .video import per_sequence

LIMBS = ("red_arm", "orange_leg", "green_leg", "blue_arm")


def height_ratio(kind: Column, k: Column, n: Column, most: float, start: float, target: float) -> Column:
    """Row 93: how tall a frame of a pose may be against the reference: crouches follow a smooth step, others keep the most."""
    t = F.when(n > 1, k / (n - 1)).otherwise(1.0)
    return F.when(kind == "crouch", F.least(F.lit(most), start + (target - start) * (t * t * (3 - 2 * t)))).otherwise(F.lit(most))


def bottom_row(kind: Column, k: Column, n: Column, cell: int, margin: int, peak: float = 0.22, fall: float = 0.18) -> Column:
    """Row 93: the ground line of a frame: jumps follow half a sine, falls stay up, the rest stand on the margin."""
    safe = cell - 2 * margin
    arc = F.rint(F.round(F.when(n > 1, F.sin(F.pi() * k / (n - 1))).otherwise(0.0) * safe * peak, 6))
    return (cell - margin - F.when(kind == "jump", arc).when(kind == "fall", F.lit(float(round(safe * fall)))).otherwise(0.0)).cast("int")


@query("pose_plan", """WITH p AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'crouch' WHEN 1 THEN 'jump' WHEN 2 THEN 'fall' ELSE 'land' END AS kind, p_size % 6 + 1 AS n FROM part), f AS (SELECT *, k::INT AS k, CASE WHEN n > 1 THEN k / (n - 1)::DOUBLE ELSE 1.0::DOUBLE END AS t FROM p, range(6) r(k) WHERE k < n)
SELECT p_partkey, k AS frame, round(CASE WHEN kind = 'crouch' THEN least(0.95::DOUBLE, 0.9::DOUBLE + (0.6::DOUBLE - 0.9::DOUBLE) * (t * t * (3 - 2 * t))) ELSE 0.95::DOUBLE END, 9) AS height,
  (90 - CASE kind WHEN 'jump' THEN round_even(round(CASE WHEN n > 1 THEN sin(pi() * k / (n - 1)) ELSE 0 END * 80 * 0.22::DOUBLE, 6), 0) WHEN 'fall' THEN 14 ELSE 0 END)::INT AS bottom FROM f""")
def q_plan(spark, sf_dir: str) -> DataFrame:
    """Row 93."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.expr("CASE p_size % 4 WHEN 0 THEN 'crouch' WHEN 1 THEN 'jump' WHEN 2 THEN 'fall' ELSE 'land' END AS kind"), F.expr("p_size % 6 + 1 AS n"))
    f = p.withColumn("frame", F.explode(F.expr("sequence(0, n - 1)")))
    return f.select("p_partkey", "frame", F.round(height_ratio(F.col("kind"), F.col("frame"), F.col("n"), 0.95, 0.9, 0.6), 9).alias("height"), bottom_row(F.col("kind"), F.col("frame"), F.col("n"), 100, 10).alias("bottom"))


@dataclass
class Pose:
    kind: str = "pose"
    most: float = 1.15
    start: float = 1.0
    target: float = 1.15
    least_width: float = 0.0
    grounded: bool | None = None

    def expected(self, k: int, n: int) -> float:
        t = k / (n - 1) if n > 1 else 1.0
        return min(self.most, self.start + (self.target - self.start) * t * t * (3 - 2 * t)) if self.kind == "crouch" else self.most


def inspect_pose(boxes: list[tuple[int, int, int, int]], pose: Pose, reference: tuple[int, int] | None, baseline: int, tolerance: float = 0.08, drift: int = 4) -> tuple[list[str], list[str]]:
    """Row 150: errors and warnings of a row of frames (bounds of those with content) against a reference width and height."""
    if not boxes:
        return [], []
    errors, warnings = [], []
    if reference:
        tall = [(b[3] - b[1]) / reference[1] for b in boxes]
        if max(tall) > pose.most + tolerance:
            errors.append("height")
        if any(r > pose.expected(k, len(boxes)) + tolerance for k, r in enumerate(tall)):
            errors.append("curve")
        if pose.kind in ("crouch", "land") and tall[-1] > pose.target + tolerance:
            warnings.append("tall")
        if pose.kind == "crouch" and len(tall) > 1 and tall[-1] > tall[0] + tolerance:
            warnings.append("rises")
        if pose.kind == "crouch" and (boxes[-1][2] - boxes[-1][0]) / reference[0] < pose.least_width:
            errors.append("width")
    else:
        warnings.append("no-reference")
    grounded = pose.kind in ("crouch", "land") if pose.grounded is None else pose.grounded
    if grounded and max(abs(b[3] - baseline) for b in boxes) > drift:
        errors.append("baseline")
    if pose.kind == "jump" and len(boxes) > 2 and max(b[3] for b in boxes) - min(b[3] for b in boxes) < 2 * drift:
        warnings.append("flat-jump")
    return errors, warnings


@query("seq_pose", f"""WITH {PX}, b AS (SELECT seq, fidx, min(x) AS x0, max(x) + 1 AS x1, min(y) AS y0, max(y) + 1 AS y1 FROM px WHERE a > 0 GROUP BY seq, fidx), k AS (SELECT *, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY seq) AS n, first_value(y1 - y0) OVER w AS rh, first_value(x1 - x0) OVER w AS rw FROM b WINDOW w AS (PARTITION BY seq ORDER BY fidx)),
r AS (SELECT *, (y1 - y0) / rh::DOUBLE AS tall, CASE WHEN n > 1 THEN k / (n - 1)::DOUBLE ELSE 1.0::DOUBLE END AS t FROM k), g AS (SELECT seq, max(tall) > 1.0::DOUBLE + 0.08::DOUBLE AS e1, bool_or(tall > least(1.0::DOUBLE, 0.9::DOUBLE + (0.6::DOUBLE - 0.9::DOUBLE) * t * t * (3 - 2 * t)) + 0.08::DOUBLE) AS e2,
  bool_or(k = n - 1 AND (x1 - x0) / rw::DOUBLE < 0.8) AS e3, max(abs(y1 - 8)) > 1 AS e4, bool_or(k = n - 1 AND tall > 0.6::DOUBLE + 0.08::DOUBLE) AS w1, any_value(n) > 1 AND max(tall) FILTER (k = n - 1) > max(tall) FILTER (k = 0) + 0.08::DOUBLE AS w2 FROM r GROUP BY seq)
SELECT seq, concat_ws(',', CASE WHEN e1 THEN 'height' END, CASE WHEN e2 THEN 'curve' END, CASE WHEN e3 THEN 'width' END, CASE WHEN e4 THEN 'baseline' END) AS errors, concat_ws(',', CASE WHEN w1 THEN 'tall' END, CASE WHEN w2 THEN 'rises' END) AS warnings FROM g""")
def q_pose(spark, sf_dir: str) -> DataFrame:
    """Row 150: each sequence as a crouch, against its first frame."""

    def run(video: list[np.ndarray]) -> list[dict]:
        boxes = [b for p in video if (b := bounds(p[..., 3] > 0))[0] is not None]
        if not boxes:
            return []
        x0, y0, x1, y1 = boxes[0]
        errors, warnings = inspect_pose(boxes, Pose("crouch", 1.0, 0.9, 0.6, 0.8), (x1 - x0, y1 - y0), 8, drift=1)
        return [{"errors": ",".join(errors), "warnings": ",".join(warnings)}]

    return per_sequence(frames(spark, sf_dir), run, "errors string, warnings string")


@dataclass
class Region:
    count: int
    box: tuple[int, int, int, int]
    x: float
    y: float
    angle: float


def region(mask: np.ndarray) -> Region | None:
    """Row 67 of a mask: size, bounds, centre and main direction; None if it is empty."""
    y, x = np.nonzero(mask)
    n = len(x)
    if not n:
        return None
    xx, yy, xy = (int(n * (u * v).sum() - u.sum() * v.sum()) for u, v in ((x, x), (y, y), (x, y)))
    return Region(n, bounds(mask), float(x.mean()), float(y.mean()), 0.5 * math.degrees(math.atan2(2 * xy, xx - yy)))


def hsv(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hue, saturation and value in 0 to 255, cut to whole numbers."""
    rgb = p[..., :3].astype(float)
    top, span = rgb.max(axis=2), rgb.max(axis=2) - rgb.min(axis=2)
    r, g, b = np.moveaxis(rgb, 2, 0)
    s = np.maximum(span, 1)
    h = np.where(r == top, (g - b) / s, np.where(g == top, 2 + (b - r) / s, 4 + (r - g) / s)) / 6
    return np.where(span == 0, 0, np.floor((h - np.floor(h)) * 255)), np.floor(span * 255 / np.maximum(top, 1)), top


def parts_of_figure(p: np.ndarray) -> dict:
    """Rows 68, 69: the limbs by colour, torso and head by grey level, the ground line and the silhouette of a frame."""
    height = p.shape[0]
    light = p[..., :3].mean(axis=1).sum(axis=1)
    low, high = int(height * 0.70), int(height * 0.96)
    base = low + int(np.argmin(light[low:high]))
    hue, sat, val = hsv(p)
    above = (np.arange(height) < base - 3)[:, None]
    vivid = above & (sat >= 70) & (val >= 65)
    wanted = {"red_arm": (hue <= 14) | (hue >= 244), "orange_leg": (hue >= 15) & (hue <= 43), "green_leg": (hue >= 44) & (hue <= 112), "blue_arm": (hue >= 113) & (hue <= 190)}
    spread = p[..., :3].max(axis=2) - p[..., :3].min(axis=2)
    torso = region(above & (sat < 55) & (val >= 45) & (val <= 140) & (spread < 35))
    pale, head = above & (sat < 42) & (val >= 170) & (val <= 238) & (spread < 28) & (np.arange(height) < int(height * 0.42))[:, None], None
    if torso:
        near = pale & (np.abs(np.arange(p.shape[1]) - torso.x) <= height * 0.18)[None, :] & (np.arange(height) <= torso.y - height * 0.045)[:, None]
        parts = K.label(near)
        for k in range(1, int(parts.max()) + 1):
            r = region(parts == k)
            w, h = r.box[2] - r.box[0], r.box[3] - r.box[1]
            if r.count >= 150 and 0.035 * height <= w <= 0.20 * height and 0.055 * height <= h <= 0.30 * height and (head is None or r.count > head.count):
                head = r
    grey = np.abs(p[..., :3] - p[0, 0, :3]) @ np.array([0.299, 0.587, 0.114])
    shape = np.rint(grey) >= 28
    shape[max(0, base - 3) : base + 4] = False
    return {"height": height, "base": base, "torso": torso, "head": head, "shape": shape, "limbs": {k: region(vivid & on) for k, on in wanted.items()}}


def angle_span(angles: list[float]) -> float:
    """Row 130: 180 less the widest gap between directions."""
    a = sorted((x + 180.0) % 180.0 for x in angles)
    return 180.0 - max([y - x for x, y in zip(a, a[1:], strict=False)] + [180.0 - a[-1] + a[0]]) if len(a) > 1 else 0.0


def limb_gate(video: list[np.ndarray], walk: bool = False) -> tuple[list[str], dict[str, dict]]:
    """Row 149: errors of a sequence whose limbs are coloured, and each limb's trajectory against the torso.

    Every limb, the torso and the head have to be there in all frames; each limb moves across by 0.055 of the height, in
    four steps of 0.012 at least, none over 4.5 times the middle one; silhouettes change; torso and head keep place and
    size. ``walk``: six frames with the contacts of a walk seen from the side, and legs and arms that lead in turn.
    """
    seen, errors, paths = [parts_of_figure(p) for p in video], [], {}
    if len({p.shape for p in video}) > 1:
        return ["sizes"], {}
    for k, f in enumerate(seen, 1):
        errors += [f"{k}: no {what}" for what in ("torso", "head") if f[what] is None] + [f"{k}: no {limb}" for limb in LIMBS if f["limbs"][limb] is None]
    whole, height = not errors, seen[0]["height"]
    for limb in LIMBS if whole else ():
        points = [((f["limbs"][limb].x - f["torso"].x) / height, (f["limbs"][limb].y - f["torso"].y) / height) for f in seen]
        steps = [math.dist(a, b) for a, b in zip(points, points[1:] + points[:1], strict=True)]
        moved, across = [s for s in steps if s > 1e-6], max(x for x, _ in points) - min(x for x, _ in points)
        ratio = max(moved) / median(moved) if moved else math.inf
        active = sum(s >= 0.012 for s in steps)
        paths[limb] = {"x_range": across, "active": active, "ratio": ratio, "travel": sum(steps), "angles": angle_span([f["limbs"][limb].angle for f in seen])}
        errors += [f"{limb}: {why}" for why, bad in (("frozen", across < 0.055), ("idle", active < 4), ("jump", ratio > 4.5)) if bad]
    if all(f["torso"] for f in seen):
        at = seen[0]["torso"]
        placed = []
        for f in seen:
            dx, dy = round(at.x - f["torso"].x), round(at.y - f["torso"].y)
            h, w = f["shape"].shape
            out = np.zeros((h, w), dtype=bool)
            out[max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)] = f["shape"][max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)]
            placed.append(out)
        deltas = [int((a ^ b).sum()) / max(1, int((a | b).sum())) for a, b in zip(placed, placed[1:] + placed[:1], strict=True)]
        if sum(d >= 0.035 for d in deltas) < max(2, len(seen) - 2):
            errors.append("static")
        xs = [f["torso"].x for f in seen]
        if (max(xs) - min(xs)) / height > 0.04:
            errors.append("torso drifts")
    if all(f["head"] for f in seen):
        for name, a, b in (("width", 0, 2), ("height", 1, 3)):
            size = [f["head"].box[b] - f["head"].box[a] for f in seen]
            if max(size) / min(size) - 1 > 0.15:
                errors.append(f"head {name} drifts")
    if walk and len(seen) != 6:
        errors.append("not six frames")
    elif walk and whole:
        both, touch, clear = {"orange_leg", "green_leg"}, max(4, round(height * 0.012)), max(12, round(height * 0.035))
        for k, (f, stands) in enumerate(zip(seen, (both, both, {"orange_leg"}, both, both, {"green_leg"}), strict=True), 1):
            off = {leg: f["base"] - (f["limbs"][leg].box[3] - 1) for leg in sorted(both)}
            errors += [f"{k}: {leg} off the ground" for leg in sorted(stands) if off[leg] > touch] + [f"{k}: {leg} too low" for leg in sorted(both - stands) if off[leg] < clear]
        for k, ahead, behind in ((0, "orange_leg", "green_leg"), (3, "green_leg", "orange_leg"), (0, "blue_arm", "red_arm"), (3, "red_arm", "blue_arm")):
            if seen[k]["limbs"][ahead].x <= seen[k]["limbs"][behind].x:
                errors.append(f"{k + 1}: {ahead} does not lead")
    return errors, paths


@query("seq_limbs")
def q_limbs(spark, sf_dir: str) -> DataFrame:
    """Row 149; frames as small as these lack parts, so tests hold the gate against drawn figures."""

    def run(video: list[np.ndarray]) -> list[dict]:
        errors, paths = limb_gate(video)
        return [{"n_errors": len(errors), "first": errors[0] if errors else None, "limbs": len(paths)}]

    return per_sequence(frames(spark, sf_dir), run, "n_errors int, first string, limbs int")
