"""Measures of one frame (survey rows 45 to 75) and masks that need a neighbourhood (76 to 87, 104, 105)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.frames import PX, frames
from . import kernels as K




SQL_BORDER = "(x = 0 OR y = 0 OR x = w - 1 OR y = h - 1)"
#: name, least and greatest share of opaque pixels, least and greatest share of the bounding box
PROFILES = [("tiny-8x8", 0.04, 0.90, 0.06, 0.95), ("tiny-8x16", 0.03, 0.90, 0.04, 0.95), ("small-32x32", 0.01, 0.90, 0.02, 0.95), ("normal", 0.005, 0.90, 0.01, 0.95)]




def bounds(on: np.ndarray) -> tuple[int | None, ...]:
    """Half-open x0, y0, x1, y1 of the places that are on; nulls if none is."""
    y, x = np.flatnonzero(on.any(axis=1)), np.flatnonzero(on.any(axis=0))
    return (int(x[0]), int(y[0]), int(x[-1]) + 1, int(y[-1]) + 1) if len(x) else (None,) * 4


def on_border(h: int, w: int) -> np.ndarray:
    out = np.zeros((h, w), dtype=bool)
    out[[0, -1]] = True
    out[:, [0, -1]] = True
    return out


def share(part: int, of: int, empty: float = 0.0) -> float:
    return int(part) / int(of) if of else empty


def measure_frame(frames: DataFrame, threshold: int = 0) -> DataFrame:
    """Rows 45, 48, 55, 105: occupancy, bounds, largest 8-connected component and border contact."""

    def run(p: np.ndarray) -> list[dict]:
        on = p[..., 3] > threshold
        h, w = on.shape
        edge = on_border(h, w)
        x0, y0, x1, y1 = bounds(on)
        opaque, contact = int(on.sum()), int((on & edge).sum())
        largest = int(np.bincount(K.label(on, K.EIGHT).ravel())[1:].max()) if opaque else 0
        return [{"w": w, "h": h, "opaque": opaque, "opaque_ratio": share(opaque, w * h), "x0": x0, "y0": y0, "x1": x1, "y1": y1, "bbox_ratio": share((x1 - x0) * (y1 - y0), w * h) if opaque else 0.0,
                 "largest": largest, "largest_ratio": share(largest, opaque), "contact": contact, "contact_ratio": share(contact, edge.sum())}]

    return K.per_frame(frames, run, "w int, h int, opaque long, opaque_ratio double, x0 int, y0 int, x1 int, y1 int, bbox_ratio double, largest long, largest_ratio double, contact long, contact_ratio double")


_COMPONENTS = """on_ AS (SELECT image_id, x, y, i FROM px WHERE a > {t}),
reach(image_id, i, x, y, root) AS (SELECT image_id, i, x, y, i FROM on_ UNION SELECT o.image_id, o.i, o.x, o.y, r.root FROM reach r JOIN on_ o ON o.image_id = r.image_id AND {near} AND o.i <> r.i),
lab AS (SELECT image_id, i, min(x) AS x, min(y) AS y, min(root) AS root FROM reach GROUP BY image_id, i)"""
NEAR8, NEAR4 = "abs(o.x - r.x) <= 1 AND abs(o.y - r.y) <= 1", "abs(o.x - r.x) + abs(o.y - r.y) = 1"
_MEASURE = f"""{_COMPONENTS.format(t=0, near=NEAR8)}, big AS (SELECT image_id, max(n) AS largest FROM (SELECT image_id, root, count(*) AS n FROM lab GROUP BY image_id, root) GROUP BY image_id),
m AS (SELECT image_id, w, h, count(*) FILTER (a > 0)::BIGINT AS opaque, min(x) FILTER (a > 0) AS x0, min(y) FILTER (a > 0) AS y0, max(x) FILTER (a > 0) + 1 AS x1, max(y) FILTER (a > 0) + 1 AS y1,
  count(*) FILTER (a > 0 AND {SQL_BORDER})::BIGINT AS contact, count(*) FILTER ({SQL_BORDER}) AS border FROM px GROUP BY image_id, w, h),
measured AS (SELECT image_id, w, h, opaque, opaque / (w * h)::DOUBLE AS opaque_ratio, x0, y0, x1, y1, coalesce((x1 - x0) * (y1 - y0) / (w * h)::DOUBLE, 0.0::DOUBLE) AS bbox_ratio, coalesce(largest, 0)::BIGINT AS largest,
  CASE WHEN opaque > 0 THEN largest / opaque::DOUBLE ELSE 0.0::DOUBLE END AS largest_ratio, contact, contact / border::DOUBLE AS contact_ratio FROM m LEFT JOIN big USING (image_id))"""


@query("frame_measure", f"WITH RECURSIVE {PX}, {_MEASURE} SELECT * FROM measured")
def q_measure(spark, sf_dir: str) -> DataFrame:
    return measure_frame(frames(spark, sf_dir))


def validate_frame(measured: DataFrame, full_cell: bool = False) -> DataFrame:
    """Rows 46, 47: failures of a frame by the profile of its size, and a warning for scattered parts."""
    size = F.array_sort(F.array("w", "h"))
    name = F.when((F.col("w") == 8) & (F.col("h") == 8), "tiny-8x8").when((size[0] == 8) & (size[1] == 16), "tiny-8x16").when((F.col("w") == 32) & (F.col("h") == 32), "small-32x32").otherwise("normal")
    limit = lambda k: F.create_map(*[F.lit(v) for p in PROFILES for v in (p[0], p[k])])[F.col("profile")]
    o, b = F.col("opaque_ratio"), F.col("bbox_ratio")
    high = F.lit(not full_cell)
    blank = F.col("opaque") == 0
    rules = F.array(
        F.when(blank, "blank"),
        F.when(~blank & (F.col("contact") > 0) & high, "edge"),
        F.when(~blank & ((o < limit(1)) | ((o > limit(2)) & high)), "opaque-share"),
        F.when(~blank & ((b < limit(3)) | ((b > limit(4)) & high)), "box-share"),
    )
    return measured.withColumn("profile", name).select(
        "image_id", "profile", F.array_join(F.array_compact(rules), ",").alias("failures"), (~blank & (F.col("largest_ratio") < 0.75)).alias("scattered"), (F.size(F.array_compact(rules)) == 0).alias("ok")
    )


@query("frame_validate", f"""WITH RECURSIVE {PX}, {_MEASURE}, f AS (SELECT image_id, opaque, largest_ratio, concat_ws(',', CASE WHEN opaque = 0 THEN 'blank' END, CASE WHEN opaque > 0 AND contact > 0 THEN 'edge' END,
  CASE WHEN opaque > 0 AND (opaque_ratio < 0.04 OR opaque_ratio > 0.90) THEN 'opaque-share' END, CASE WHEN opaque > 0 AND (bbox_ratio < 0.06 OR bbox_ratio > 0.95) THEN 'box-share' END) AS failures FROM measured)
SELECT image_id, 'tiny-8x8' AS profile, failures, opaque > 0 AND largest_ratio < 0.75 AS scattered, failures = '' AS ok FROM f""")
def q_validate(spark, sf_dir: str) -> DataFrame:
    return validate_frame(measure_frame(frames(spark, sf_dir)))


def edge_measures(frames: DataFrame, margin: int = 2, key=(0, 0, 0), near: float = 28.0) -> DataFrame:
    """Rows 49 to 54, 74: border counts and shares; the band count takes corners twice, as strips overlap."""

    def run(p: np.ndarray) -> list[dict]:
        a = p[..., 3]
        solid, seen, edge = a > 16, a > 0, on_border(*a.shape)
        strips = (np.s_[:margin], np.s_[-margin:], np.s_[:, :margin], np.s_[:, -margin:])
        inner = np.zeros_like(seen)
        inner[margin:-margin, margin:-margin] = True
        like = ((p[..., :3] - np.array(key)) ** 2).sum(axis=2) <= near * near
        return [{"nonzero": int(seen.sum()), "band": sum(int(seen[s].sum()) for s in strips), "clear_ratio": share((edge & ~solid).sum(), edge.sum()), "key_ratio": share((edge & solid & like).sum(), (edge & solid).sum()),
                 "outside": int((seen & ~inner).sum()), "coverage": min(share(solid[s].sum(), solid[s].size) for s in strips)}]

    return K.per_frame(frames, run, "nonzero long, band long, clear_ratio double, key_ratio double, outside long, coverage double")


@query("frame_edges", f"""WITH {PX} SELECT image_id, count(*) FILTER (a > 0)::BIGINT AS nonzero,
  (count(*) FILTER (a > 0 AND y < 2) + count(*) FILTER (a > 0 AND y >= h - 2) + count(*) FILTER (a > 0 AND x < 2) + count(*) FILTER (a > 0 AND x >= w - 2))::BIGINT AS band,
  count(*) FILTER ({SQL_BORDER} AND a <= 16) / count(*) FILTER ({SQL_BORDER})::DOUBLE AS clear_ratio,
  coalesce(count(*) FILTER ({SQL_BORDER} AND a > 16 AND r * r + g * g + b * b <= 784) / nullif(count(*) FILTER ({SQL_BORDER} AND a > 16), 0)::DOUBLE, 0.0::DOUBLE) AS key_ratio,
  count(*) FILTER (a > 0 AND (x < 2 OR y < 2 OR x >= w - 2 OR y >= h - 2))::BIGINT AS outside,
  least(avg((a > 16)::INT) FILTER (y < 2), avg((a > 16)::INT) FILTER (y >= h - 2), avg((a > 16)::INT) FILTER (x < 2), avg((a > 16)::INT) FILTER (x >= w - 2)) AS coverage FROM px GROUP BY image_id""")
def q_edges(spark, sf_dir: str) -> DataFrame:
    return edge_measures(frames(spark, sf_dir))


@query("frame_matte_ratio")
def q_matte(spark, sf_dir: str) -> DataFrame:
    """Row 53: share of solid border pixels near any colour of the frame's own border palette."""
    from .pixels import border_palette

    def run(p: np.ndarray) -> list[dict]:
        solid = p[on_border(*p.shape[:2]) & (p[..., 3] > 16)][:, :3]
        palette = np.array(border_palette(p, 28.0, 2)).reshape(-1, 3)
        if not len(solid):
            return []
        near = (((solid[:, None] - palette[None]) ** 2).sum(axis=2) <= 28.0**2).any(axis=1) if len(palette) else np.zeros(len(solid), dtype=bool)
        return [{"near": int(near.sum()), "solid": len(solid)}]

    return K.per_frame(frames(spark, sf_dir), run, "near long, solid long")


def bbox_metrics(frames: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows 56, 61: normalised bounds at alpha above 16; all 0 for an empty frame."""
    names = ["nx0", "ny0", "nx1", "ny1", "width", "height", "center_x", "center_y", "bottom", "alpha_area"]

    def run(p: np.ndarray) -> list[dict]:
        on = p[..., 3] > 16
        h, w = on.shape
        x0, y0, x1, y1 = bounds(on)
        if x0 is None:
            return [dict.fromkeys(names, 0.0)]
        values = (x0 / w, y0 / h, x1 / w, y1 / h, (x1 - x0) / w, (y1 - y0) / h, (x0 + x1) / (2 * w), (y0 + y1) / (2 * h), y1 / h, share(on.sum(), w * h))
        return [dict(zip(names, values, strict=True))]

    return K.per_frame(frames, run, ", ".join(f"{n} double" for n in names), carry)


_BOX16 = "SELECT image_id, any_value(seq) AS seq, any_value(fidx) AS fidx, w, h, count(*) FILTER (a > 16)::BIGINT AS n, min(x) FILTER (a > 16) AS x0, min(y) FILTER (a > 16) AS y0, max(x) FILTER (a > 16) + 1 AS x1, max(y) FILTER (a > 16) + 1 AS y1 FROM px GROUP BY image_id, w, h"
METRICS_SQL = f"""bx AS ({_BOX16}), metrics AS (SELECT image_id, coalesce(x0 / w::DOUBLE, 0) AS nx0, coalesce(y0 / h::DOUBLE, 0) AS ny0, coalesce(x1 / w::DOUBLE, 0) AS nx1, coalesce(y1 / h::DOUBLE, 0) AS ny1,
  coalesce((x1 - x0) / w::DOUBLE, 0) AS width, coalesce((y1 - y0) / h::DOUBLE, 0) AS height, coalesce((x0 + x1) / (2 * w)::DOUBLE, 0) AS center_x, coalesce((y0 + y1) / (2 * h)::DOUBLE, 0) AS center_y,
  coalesce(y1 / h::DOUBLE, 0) AS bottom, n / (w * h)::DOUBLE AS alpha_area FROM bx)"""


@query("frame_bbox_metrics", f"WITH {PX}, {METRICS_SQL} SELECT * FROM metrics")
def q_bbox(spark, sf_dir: str) -> DataFrame:
    return bbox_metrics(frames(spark, sf_dir))


def centres(frames: DataFrame) -> DataFrame:
    """Rows 57 to 60, 62: weighted centre, anchors in bands of the box, balance of the support, lower centre."""

    def run(p: np.ndarray) -> list[dict]:
        solid = p[..., 3] > 16
        x0, y0, x1, y1 = bounds(solid)
        if x0 is None:
            return []
        h, w = solid.shape
        y, x = np.nonzero(solid)
        a, tall = p[..., 3][solid], y1 - y0
        place = lambda q: int(np.rint(y0 + tall * q))

        def anchor(low: float, high: float) -> float | None:
            start = max(y0, min(y1 - 1, place(low)))
            on = (y >= start) & (y < max(start + 1, min(y1, place(high))))
            return share((x * a)[on].sum(), a[on].sum(), None)

        low, feet = y >= y0 + int(np.rint(tall * 0.68)), x[y >= int(np.rint(h * 0.45))]
        balance = float(np.mean((x[low] - (x0 + x1) / 2) / (x1 - x0))) if low.any() else None
        return [{"cx": share((x * a).sum(), a.sum()), "cy": share((y * a).sum(), a.sum()), "footprint": anchor(0.72, 1.0), "body": anchor(0.22, 0.68), "balance": None if balance is None else round(balance, 9) + 0.0,
                 "lower_center": (int(feet.min()) + int(feet.max()) + 1) / (2 * w) if len(feet) else None}]

    return K.per_frame(frames, run, "cx double, cy double, footprint double, body double, balance double, lower_center double")


@query("frame_centres", f"""WITH {PX}, bx AS ({_BOX16}), p AS (SELECT px.image_id, x, y, a, w, h, bx.x0, bx.y0, bx.x1, bx.y1 FROM (SELECT * FROM px WHERE a > 16) px JOIN (SELECT image_id, x0, y0, x1, y1 FROM bx) bx USING (image_id)),
s AS (SELECT *, greatest(y0, least(y1 - 1, round_even(y0 + (y1 - y0) * 0.72::DOUBLE, 0)::INT)) AS fs, greatest(y0, least(y1 - 1, round_even(y0 + (y1 - y0) * 0.22::DOUBLE, 0)::INT)) AS bs FROM p),
e AS (SELECT *, greatest(fs + 1, least(y1, y1)) AS fe, greatest(bs + 1, least(y1, round_even(y0 + (y1 - y0) * 0.68::DOUBLE, 0)::INT)) AS be FROM s)
SELECT image_id, sum(x * a) / sum(a)::DOUBLE AS cx, sum(y * a) / sum(a)::DOUBLE AS cy, sum(x * a) FILTER (y >= fs AND y < fe) / sum(a) FILTER (y >= fs AND y < fe)::DOUBLE AS footprint,
  sum(x * a) FILTER (y >= bs AND y < be) / sum(a) FILTER (y >= bs AND y < be)::DOUBLE AS body, round(avg((x - (x0 + x1) / 2.0::DOUBLE) / (x1 - x0)) FILTER (y >= y0 + round_even((y1 - y0) * 0.68::DOUBLE, 0)::INT), 9) + 0.0 AS balance,
  (min(x) FILTER (y >= 4) + max(x) FILTER (y >= 4) + 1) / (2 * max(w))::DOUBLE AS lower_center FROM e GROUP BY image_id""")
def q_centres(spark, sf_dir: str) -> DataFrame:
    return centres(frames(spark, sf_dir))


def central_run(line: np.ndarray, middle: int, reach: int) -> int | None:
    """Length of the run that holds the middle column, else of the nearest one within ``reach``, the left one first."""
    on = np.flatnonzero(line)
    if not len(on):
        return None
    near = on[np.argmin(np.abs(on - middle))]  # the first of two at one distance is the left one
    if abs(near - middle) > reach:
        return None
    off = np.flatnonzero(~line)
    before, after = off[off < near], off[off > near]
    return int((after[0] if len(after) else len(line)) - (before[-1] + 1 if len(before) else 0))


def feature_widths(frames: DataFrame) -> DataFrame:
    """Rows 63, 64: runs through the middle of the box, as upper medians over bands of the height."""

    def run(p: np.ndarray) -> list[dict]:
        a = p[..., 3]
        left, top, right, end = bounds(a > 0)
        if left is None:
            return []
        middle, reach = (left + right) // 2, max(2, a.shape[1] // 5)
        runs = [((y - top) / max(1, end - top), n) for y in range(top, end) if (n := central_run(a[y] > 16, middle, reach)) is not None]

        def upper(low: float, high: float) -> int:
            found = sorted(n for at, n in runs if low <= at <= high)
            return found[len(found) // 2] if found else 0

        return [{"head_width": upper(0.03, 0.35), "upper_width": upper(0.15, 0.55), "torso_width": upper(0.45, 0.82)}] if runs else []

    return K.per_frame(frames, run, "head_width long, upper_width long, torso_width long")


@query("frame_feature_widths", f"""WITH {PX}, bx AS (SELECT image_id, min(x) FILTER (a > 0) AS l, max(x) FILTER (a > 0) + 1 AS r_, min(y) FILTER (a > 0) AS t, max(y) FILTER (a > 0) + 1 AS e FROM px GROUP BY image_id),
p AS (SELECT px.image_id, y, x, t, e, (l + r_) // 2 AS mid, x - row_number() OVER (PARTITION BY px.image_id, y ORDER BY x) AS island FROM px JOIN bx USING (image_id) WHERE a > 16 AND y >= t AND y < e),
n AS (SELECT *, count(*) OVER (PARTITION BY image_id, y, island) AS run FROM p),
k AS (SELECT * FROM n WHERE abs(x - mid) <= 2 QUALIFY row_number() OVER (PARTITION BY image_id, y ORDER BY abs(x - mid), x) = 1),
r AS (SELECT *, (y - t) / greatest(1, e - t)::DOUBLE AS rel FROM k),
g AS (SELECT image_id, list_sort(list(run) FILTER (rel >= 0.03 AND rel <= 0.35)) AS hd, list_sort(list(run) FILTER (rel >= 0.15 AND rel <= 0.55)) AS up, list_sort(list(run) FILTER (rel >= 0.45 AND rel <= 0.82)) AS tor FROM r GROUP BY image_id)
SELECT image_id, coalesce(hd[len(hd) // 2 + 1], 0)::BIGINT AS head_width, coalesce(up[len(up) // 2 + 1], 0)::BIGINT AS upper_width, coalesce(tor[len(tor) // 2 + 1], 0)::BIGINT AS torso_width FROM g""")
def q_features(spark, sf_dir: str) -> DataFrame:
    return feature_widths(frames(spark, sf_dir))


def narrowest(mass: np.ndarray, part: float) -> int | None:
    """The length of the narrowest window that holds a share of the mass: two pointers over running sums."""
    sums = np.concatenate(([0], np.cumsum(mass)))
    if not sums[-1]:
        return None
    ends = np.searchsorted(sums, sums[:-1] + part * sums[-1], side="left")
    fits = ends < len(sums)
    return int((ends[fits] - np.flatnonzero(fits)).min())


def mass_extent(frames: DataFrame, axis: str = "x", part: float = 0.8) -> DataFrame:
    """Row 65: the narrowest window that holds a share of the alpha mass."""

    def run(p: np.ndarray) -> list[dict]:
        n = narrowest(p[..., 3].sum(axis=0 if axis == "x" else 1), part)
        return [] if n is None else [{"extent": n}]

    return K.per_frame(frames, run, "extent long")


@query("frame_mass_extent", f"""WITH {PX}, m AS (SELECT image_id, x AS p, sum(a) AS m FROM px GROUP BY image_id, x), s AS (SELECT *, sum(m) OVER (PARTITION BY image_id ORDER BY p) AS upto, sum(m) OVER (PARTITION BY image_id) AS total FROM m)
SELECT a.image_id, min(b.p - a.p + 1)::BIGINT AS extent FROM s a JOIN s b ON a.image_id = b.image_id AND b.p >= a.p AND (b.upto - a.upto + a.m)::DOUBLE >= 0.8::DOUBLE * a.total::DOUBLE WHERE a.total > 0 GROUP BY a.image_id""")
def q_mass(spark, sf_dir: str) -> DataFrame:
    return mass_extent(frames(spark, sf_dir))


@query("frame_projection", f"WITH {PX} SELECT image_id, x, sum(CASE WHEN a > 16 THEN a ELSE 0 END)::BIGINT AS mass FROM px GROUP BY image_id, x")
def q_projection(spark, sf_dir: str) -> DataFrame:
    """Row 66."""

    def run(p: np.ndarray) -> list[dict]:
        return [{"x": x, "mass": int(m)} for x, m in enumerate(np.where(p[..., 3] > 16, p[..., 3], 0).sum(axis=0))]

    return K.per_frame(frames(spark, sf_dir), run, "x int, mass long")


@query("frame_region_stats", f"""WITH {PX}, m AS (SELECT image_id, count(*)::BIGINT AS n, avg(x) AS cx, avg(y) AS cy, (count(*) * sum(x * x) - sum(x) * sum(x))::BIGINT AS xx, (count(*) * sum(y * y) - sum(y) * sum(y))::BIGINT AS yy, (count(*) * sum(x * y) - sum(x) * sum(y))::BIGINT AS xy FROM px WHERE a > 16 GROUP BY image_id)
SELECT image_id, n, cx, cy, xx / (n * n)::DOUBLE AS sxx, yy / (n * n)::DOUBLE AS syy, xy / (n * n)::DOUBLE AS sxy, round(0.5 * degrees(atan2((2 * xy)::DOUBLE, (xx - yy)::DOUBLE)), 6) + 0.0 AS angle FROM m""")
def q_region(spark, sf_dir: str) -> DataFrame:
    """Row 67; moments come from integer sums, so that equal ones stay equal."""

    def run(p: np.ndarray) -> list[dict]:
        y, x = np.nonzero(p[..., 3] > 16)
        n = len(x)
        if not n:
            return []
        xx, yy, xy = (int(n * (u * v).sum() - u.sum() * v.sum()) for u, v in ((x, x), (y, y), (x, y)))
        angle = round(0.5 * math.degrees(math.atan2(2 * xy, xx - yy)), 6) + 0.0
        return [{"n": n, "cx": float(x.mean()), "cy": float(y.mean()), "sxx": xx / (n * n), "syy": yy / (n * n), "sxy": xy / (n * n), "angle": angle}]

    return K.per_frame(frames(spark, sf_dir), run, "n long, cx double, cy double, sxx double, syy double, sxy double, angle double")


@query("frame_baseline", f"""WITH {PX}, l AS (SELECT image_id, y, sum(r + g + b)::BIGINT AS light FROM px WHERE y >= 4 GROUP BY image_id, y), c AS (SELECT image_id, sum(r + g + b) / 12.0::DOUBLE AS corner FROM px WHERE x IN (0, 7) AND y IN (0, 7) GROUP BY image_id),
f AS (SELECT image_id, max(y) AS lowest FROM px JOIN c USING (image_id) WHERE a >= 20 OR abs((r + g + b) / 3.0::DOUBLE - corner) >= 24 GROUP BY image_id)
SELECT image_id, y AS darkest, lowest FROM l LEFT JOIN f USING (image_id) QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY light, y) = 1""")
def q_baseline(spark, sf_dir: str) -> DataFrame:
    """Rows 69, 70: the darkest row of the lower half, and the lowest row that differs from the corners."""

    def run(p: np.ndarray) -> list[dict]:
        light, half = p[..., :3].sum(axis=2), p.shape[0] // 2
        corner = light[[0, 0, -1, -1], [0, -1, 0, -1]].sum() / 12
        rows = np.flatnonzero(((p[..., 3] >= 20) | (np.abs(light / 3 - corner) >= 24)).any(axis=1))
        return [{"darkest": half + int(np.argmin(light[half:].sum(axis=1))), "lowest": int(rows[-1]) if len(rows) else None}]

    return K.per_frame(frames(spark, sf_dir), run, "darkest int, lowest int")


@query("frame_static_checks", f"""WITH {PX}, q AS (SELECT image_id, avg((a > 0)::INT) AS share, bool_or(a > 0 AND {SQL_BORDER}) AS clipped FROM px GROUP BY image_id),
s AS (SELECT l.image_id, avg(abs(l.r - e.r) + abs(l.g - e.g) + abs(l.b - e.b) + abs(l.a - e.a)) / 4 / 255 AS seam FROM px l JOIN px e ON l.image_id = e.image_id AND l.y = e.y AND l.x = 0 AND e.x = 7 GROUP BY l.image_id)
SELECT image_id, share, clipped, round(seam, 9) AS seam, share = 0 AS blank, share > 0 AND (share < 0.01 OR share > 0.95) AS extreme, seam > 0.03 AS broken FROM q JOIN s USING (image_id)""")
def q_static(spark, sf_dir: str) -> DataFrame:
    """Rows 72, 73, 75: occupancy and clipping of a static asset, and the difference of its opposite edges."""

    def run(p: np.ndarray) -> list[dict]:
        on = p[..., 3] > 0
        part = share(on.sum(), on.size)
        seam = int(np.abs(p[:, 0] - p[:, -1]).sum()) / p.shape[0] / 4 / 255
        return [{"share": part, "clipped": bool((on & on_border(*on.shape)).any()), "seam": round(seam, 9), "blank": part == 0, "extreme": part > 0 and not 0.01 <= part <= 0.95, "broken": seam > 0.03}]

    return K.per_frame(frames(spark, sf_dir), run, "share double, clipped boolean, seam double, blank boolean, extreme boolean, broken boolean")


def parts_of(p: np.ndarray, threshold: int = 16, steps=K.FOUR) -> list[dict]:
    """Components in raster order, with area and half-open bounds; one pass over the solid pixels."""
    parts = K.label(p[..., 3] > threshold, steps)
    y, x = np.nonzero(parts)
    if not len(x):
        return []
    k = parts[y, x] - 1
    n = int(k.max()) + 1
    ends = {}
    for name, v in (("x", x), ("y", y)):
        low, high = np.full(n, v.max() + 1), np.zeros(n, dtype=np.int64)
        np.minimum.at(low, k, v), np.maximum.at(high, k, v + 1)
        ends[name] = low.tolist(), high.tolist()
    area = np.bincount(k).tolist()
    return [{"ord": j + 1, "area": area[j], "x0": ends["x"][0][j], "y0": ends["y"][0][j], "x1": ends["x"][1][j], "y1": ends["y"][1][j]} for j in range(n)]


def components(frames: DataFrame, threshold: int = 16, steps=K.FOUR) -> DataFrame:
    """Row 104."""
    return K.per_frame(frames, lambda p: parts_of(p, threshold, steps), "ord int, area long, x0 int, y0 int, x1 int, y1 int")


PARTS_SQL = f"""{_COMPONENTS.format(t=16, near=NEAR4)}, parts AS (SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY root)::INT AS ord, count(*)::BIGINT AS area, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1 FROM lab GROUP BY image_id, root)"""


@query("components_4", f"WITH RECURSIVE {PX}, {PARTS_SQL} SELECT * FROM parts")
def q_components(spark, sf_dir: str) -> DataFrame:
    return components(frames(spark, sf_dir))


def kept_parts(parts: list[dict], least: int = 2, part: float = 0.25) -> list[dict]:
    """Components that matter beside the largest."""
    floor = max(least, float(np.rint(part * max((q["area"] for q in parts), default=0))))
    return [q for q in parts if q["area"] >= floor]


@query("components_kept", f"""WITH RECURSIVE {PX}, {PARTS_SQL}, k AS (SELECT *, area >= greatest(2, round_even(0.25 * max(area) OVER (PARTITION BY image_id), 0)) AS keep FROM parts)
SELECT image_id, count(*) FILTER (keep)::BIGINT AS kept, count(*) FILTER (NOT keep)::BIGINT AS discarded, min(x0) FILTER (keep) AS x0, min(y0) FILTER (keep) AS y0, max(x1) FILTER (keep) AS x1, max(y1) FILTER (keep) AS y1,
  concat_ws(',', CASE WHEN min(x0) FILTER (keep) = 0 THEN 'left' END, CASE WHEN min(y0) FILTER (keep) = 0 THEN 'top' END, CASE WHEN max(x1) FILTER (keep) = 8 THEN 'right' END, CASE WHEN max(y1) FILTER (keep) = 8 THEN 'bottom' END) AS contacts FROM k GROUP BY image_id""")
def q_kept(spark, sf_dir: str) -> DataFrame:
    """Rows 86 to 88, 116: parts that matter beside the largest, their common box and the borders that it touches."""

    def run(p: np.ndarray) -> list[dict]:
        parts = parts_of(p)
        kept = kept_parts(parts)
        if not parts:
            return []
        # all parts may be under the least area: then there is no box and nothing is touched
        x0, y0, x1, y1 = (f((q[c] for q in kept), default=None) for f, c in ((min, "x0"), (min, "y0"), (max, "x1"), (max, "y1")))
        touch = [side for side, hit in (("left", x0 == 0), ("top", y0 == 0), ("right", x1 == p.shape[1]), ("bottom", y1 == p.shape[0])) if hit]
        return [{"kept": len(kept), "discarded": len(parts) - len(kept), "x0": x0, "y0": y0, "x1": x1, "y1": y1, "contacts": ",".join(touch)}]

    return K.per_frame(frames(spark, sf_dir), run, "kept long, discarded long, x0 int, y0 int, x1 int, y1 int, contacts string")


_FLOOD = f"""cand AS (SELECT image_id, x, y, i FROM px WHERE a <= 16), reach(image_id, i, x, y) AS (SELECT image_id, i, x, y FROM cand WHERE x IN (0, 7) OR y IN (0, 7) UNION SELECT o.image_id, o.i, o.x, o.y FROM reach r JOIN cand o ON o.image_id = r.image_id AND {NEAR4})"""


@query("mask_exterior", f"""WITH RECURSIVE {PX}, {_FLOOD}, c AS (SELECT image_id, count(*) AS n FROM cand GROUP BY image_id), e AS (SELECT image_id, count(*) AS n FROM reach GROUP BY image_id),
ids AS (SELECT DISTINCT image_id FROM px) SELECT image_id, coalesce(e.n, 0)::BIGINT AS exterior, (coalesce(c.n, 0) - coalesce(e.n, 0))::BIGINT AS enclosed FROM ids LEFT JOIN c USING (image_id) LEFT JOIN e USING (image_id)""")
def q_exterior(spark, sf_dir: str) -> DataFrame:
    """Rows 76 to 78, 85: background that the border reaches, and holes that it does not."""

    def run(p: np.ndarray) -> list[dict]:
        candidate = p[..., 3] <= 16
        outside = int(K.exterior(candidate).sum())
        return [{"exterior": outside, "enclosed": int(candidate.sum()) - outside}]

    return K.per_frame(frames(spark, sf_dir), run, "exterior long, enclosed long")


@query("mask_dilate", f"""WITH {PX}, d AS (SELECT DISTINCT image_id, x + dx AS x, y + dy AS y FROM px, (VALUES (-1), (0), (1)) p(dx), (VALUES (-1), (0), (1)) q(dy) WHERE a > 16)
SELECT image_id, count(*)::BIGINT AS n FROM d WHERE x BETWEEN 0 AND 7 AND y BETWEEN 0 AND 7 GROUP BY image_id""")
def q_dilate(spark, sf_dir: str) -> DataFrame:
    """Row 79."""
    return K.per_frame(frames(spark, sf_dir), lambda p: [{"n": int(K.dilate(p[..., 3] > 16).sum())}], "n long").where("n > 0")


@query("mask_strategy", f"""WITH {PX}, e AS (SELECT image_id, avg((a <= 16)::INT) FILTER ({SQL_BORDER}) AS clear, coalesce(count(*) FILTER ({SQL_BORDER} AND a > 16 AND r * r + g * g + b * b <= 9216) / nullif(count(*) FILTER ({SQL_BORDER} AND a > 16), 0)::DOUBLE, 0) AS keyed FROM px GROUP BY image_id)
SELECT image_id, CASE WHEN clear >= 0.7 THEN 'keep' WHEN keyed >= 0.45 THEN 'chroma' ELSE 'blocked' END AS strategy FROM e""")
def q_strategy(spark, sf_dir: str) -> DataFrame:
    """Row 83: keep alpha, remove the key, or leave it to a model that is not here."""
    e = edge_measures(frames(spark, sf_dir), near=96.0)
    return e.select("image_id", F.when(F.col("clear_ratio") >= 0.7, "keep").when(F.col("key_ratio") >= 0.45, "chroma").otherwise("blocked").alias("strategy"))


@query("mask_remove_matte", f"""WITH RECURSIVE {PX}, {_FLOOD} SELECT px.image_id, sum(CASE WHEN reach.i IS NULL THEN a ELSE 0 END)::BIGINT AS alpha_left, count(*) FILTER (reach.i IS NULL AND a > 0)::BIGINT AS visible FROM px LEFT JOIN reach ON px.image_id = reach.image_id AND px.i = reach.i GROUP BY px.image_id""")
def q_remove(spark, sf_dir: str) -> DataFrame:
    """Rows 80, 81: what is left after background that the border reaches is cleared."""

    def run(p: np.ndarray) -> list[dict]:
        left = np.where(K.exterior(p[..., 3] <= 16), 0, p[..., 3])
        return [{"alpha_left": int(left.sum()), "visible": int((left > 0).sum())}]

    return K.per_frame(frames(spark, sf_dir), run, "alpha_left long, visible long")
