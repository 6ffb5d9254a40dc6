"""Image transforms of packed frames (survey rows 89 to 102) and layout (114, 115, 210 to 216, 245)."""

from __future__ import annotations

import math

import numpy as np

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.frames import PX, frames
from . import kernels as K
from .frames import bounds
from .segmentation import sheets

_SUMS = "sum(a * (ty * {w} + tx + 1))::BIGINT AS digest, count(*)::BIGINT AS n"


def digest(p: np.ndarray) -> dict:
    """One number that depends on what lies where, and the number of pixels."""
    a = p[..., 3].ravel()
    return {"digest": int((a * np.arange(1, len(a) + 1)).sum()), "n": len(a)}


def digests(packed: DataFrame, f) -> DataFrame:
    """image_id, digest and n of each frame after ``f``."""
    return K.per_frame(packed, lambda p: [digest(f(p))], "digest long, n long")


#: reach and weight by distance
FILTERS = {
    "bilinear": (1.0, lambda x: np.maximum(0.0, 1.0 - np.abs(x))),
    "bicubic": (2.0, lambda x: np.where(np.abs(x) < 1, (1.5 * np.abs(x) - 2.5) * x * x + 1, np.where(np.abs(x) < 2, ((-0.5 * np.abs(x) + 2.5) * np.abs(x) - 4) * np.abs(x) + 2, 0.0))),
    "lanczos": (3.0, lambda x: np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)),
}


def resampling(old: int, new: int, name: str) -> np.ndarray:
    """new x old weights of a separable filter, widened when shrinking."""
    reach, weight = FILTERS[name]
    ratio = old / new
    wide = max(1.0, ratio)
    middle = (np.arange(new) + 0.5) * ratio
    low, high = np.floor(middle - reach * wide + 0.5).clip(0), np.floor(middle + reach * wide + 0.5).clip(max=old)
    at = np.arange(old)[None, :]
    w = np.where((at >= low[:, None]) & (at < high[:, None]), weight((at - middle[:, None] + 0.5) / wide), 0.0)
    return w / w.sum(axis=1, keepdims=True)


def resize_smooth(p: np.ndarray, width: int, height: int, name: str) -> np.ndarray:
    """Columns first, then rows, each rounded to whole levels; colours weigh by their alpha."""
    level = lambda x: np.floor(x + 0.5).clip(0, 255)
    a = p[..., 3:].astype(float)
    x = np.concatenate([level(p[..., :3] * a / 255), a], axis=2)
    x = level(np.einsum("nw,hwc->hnc", resampling(p.shape[1], width, name), x))
    x = level(np.einsum("mh,hnc->mnc", resampling(p.shape[0], height, name), x))
    colour = np.where(x[..., 3:] > 0, np.minimum(255, np.floor(255 * x[..., :3] / np.maximum(x[..., 3:], 1))), 0)
    return np.concatenate([colour, x[..., 3:]], axis=2).astype(np.int64)


def resize_nearest(p: np.ndarray, width: int, height: int) -> np.ndarray:
    """Target pixels take the source pixel under their centre."""
    y, x = (np.floor((np.arange(n) + 0.5) * old / n).astype(int) for n, old in ((height, p.shape[0]), (width, p.shape[1])))
    return p[y[:, None], x[None, :]]


def resize(p: np.ndarray, width: int, height: int, pixel_art: bool = False, whole_scale: bool = False) -> np.ndarray:
    """Row 89: nearest for pixel art, where asked only by one whole ratio either way; else Lanczos when a side shrinks, bicubic
    when none does."""
    h, w = p.shape[:2]
    if min(width, height) < 1:
        raise ValueError("a target side is under one pixel")
    if pixel_art:
        up, down = width % w == 0 and height % h == 0 and width // w == height // h, w % width == 0 and h % height == 0 and w // width == h // height
        if whole_scale and not (up or down):
            raise ValueError("not one whole ratio on both sides")
        return resize_nearest(p, width, height)
    return resize_smooth(p, width, height, "lanczos" if width < w or height < h else "bicubic")


def fit_cover(p: np.ndarray, width: int, height: int, pixel_art: bool = False) -> np.ndarray:
    """Row 91: the middle of the target's shape, resized to fill it."""
    h, w = p.shape[:2]
    if w * height > h * width:
        n = max(1, int(np.rint(h * (width / height))))
        p = p[:, (w - n) // 2 : (w - n) // 2 + n]
    elif w * height < h * width:
        n = max(1, int(np.rint(w / (width / height))))
        p = p[(h - n) // 2 : (h - n) // 2 + n]
    return p if p.shape[:2] == (height, width) else resize(p, width, height, pixel_art)


def fit_locked(p: np.ndarray, width: int, height: int, pixel_art: bool = False) -> np.ndarray | None:
    """Row 92: the whole canvas resized; nothing if its shape is over a hundredth off."""
    ratio = width / height
    if abs(p.shape[1] / p.shape[0] - ratio) / ratio > 0.01:
        return None
    return p if p.shape[:2] == (height, width) else resize(p, width, height, pixel_art)


@query("xf_resize_nearest", f"""WITH {PX}, t AS (SELECT u::INT AS tx, v::INT AS ty FROM range(5) a(u), range(13) b(v)) SELECT image_id, {_SUMS.format(w=5)} FROM t JOIN px ON px.x = floor((tx + 0.5) * 8 / 5) AND px.y = floor((ty + 0.5) * 8 / 13) GROUP BY image_id""")
def q_resize(spark, sf_dir: str) -> DataFrame:
    return digests(frames(spark, sf_dir), lambda p: resize(p, 5, 13, pixel_art=True))


@query("xf_resize_smooth")
def q_resize_smooth(spark, sf_dir: str) -> DataFrame:
    """Row 89, illustrated: down to 5 x 6 and up to 12 x 11; tests hold it against sums by hand."""

    def run(p: np.ndarray) -> list[dict]:
        return [{"kind": k} | digest(resize(p, *size)) for k, size in (("down", (5, 6)), ("up", (12, 11)))]

    return K.per_frame(frames(spark, sf_dir), run, "kind string, digest long, n long")


_COVER = "t AS (SELECT u::INT AS tx, v::INT AS ty FROM range(6) a(u), range(4) b(v))"


@query("xf_cover_pixels", f"""WITH {PX}, {_COVER} SELECT image_id, sum(a * (ty * 6 + tx + 1))::BIGINT AS digest, count(*)::BIGINT AS n FROM t JOIN px ON px.x = floor((tx + 0.5) * 8 / 6) AND px.y = 1 + floor((ty + 0.5) * 5 / 4) GROUP BY image_id""")
def q_cover_pixels(spark, sf_dir: str) -> DataFrame:
    """Row 91: 8 x 8 frames into 6 x 4 cells; the middle five rows are left of eight."""
    return digests(frames(spark, sf_dir), lambda p: fit_cover(p, 6, 4, pixel_art=True))


def fit_contain(packed: DataFrame, cell_w: int, cell_h: int, margin: int = 1, bottom: bool = True) -> DataFrame:
    """Rows 90, 94: scale (at most 1) and place of the content in a cell, centred and on the ground or in the middle."""

    def run(p: np.ndarray) -> list[dict]:
        x0, y0, x1, y1 = bounds(p[..., 3] > 0)
        if x0 is None:
            return []
        scale = min(1.0, (cell_w - 2 * margin) / (x1 - x0), (cell_h - 2 * margin) / (y1 - y0))
        tw, th = (max(1, int(np.rint(n * scale))) for n in (x1 - x0, y1 - y0))
        return [{"scale": scale, "tw": tw, "th": th, "left": (cell_w - tw) // 2, "top": cell_h - margin - th if bottom else (cell_h - th) // 2}]

    return K.per_frame(packed, run, "scale double, tw int, th int, left int, top int")


@query("xf_fit_contain", f"""WITH {PX}, b AS (SELECT image_id, max(x) + 1 - min(x) AS bw, max(y) + 1 - min(y) AS bh FROM px WHERE a > 0 GROUP BY image_id), s AS (SELECT *, least(1.0::DOUBLE, 4 / bw::DOUBLE, 5 / bh::DOUBLE) AS scale FROM b),
t AS (SELECT *, greatest(1, round_even(bw * scale, 0)::INT) AS tw, greatest(1, round_even(bh * scale, 0)::INT) AS th FROM s) SELECT image_id, scale, tw, th, floor((6 - tw) / 2)::INT AS "left", 6 - th AS top FROM t""")
def q_contain(spark, sf_dir: str) -> DataFrame:
    return fit_contain(frames(spark, sf_dir), 6, 7)


@query("xf_fit_cover", """WITH p AS (SELECT p_partkey, p_size + 3 AS w, p_size % 7 + 4 AS h FROM part), c AS (SELECT *, CASE WHEN w * 4 > h * 6 THEN round_even(h * 1.5::DOUBLE, 0)::INT ELSE w END AS cw, CASE WHEN w * 4 > h * 6 THEN h ELSE round_even(w / 1.5::DOUBLE, 0)::INT END AS ch FROM p)
SELECT p_partkey, cw, ch, ((w - cw) // 2)::INT AS "left", ((h - ch) // 2)::INT AS top, abs(w / h::DOUBLE / 1.5::DOUBLE - 1) > 0.01 AS locked_refuses FROM c""")
def q_cover(spark, sf_dir: str) -> DataFrame:
    """Rows 91, 92: centre crop to a 6:4 cell; a position-locked fit refuses shapes over a hundredth off."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", (F.col("p_size") + 3).alias("w"), (F.col("p_size") % 7 + 4).alias("h"))
    wide = F.col("w") * 4 > F.col("h") * 6
    c = p.withColumns({"cw": F.when(wide, F.rint(F.col("h") * 1.5).cast("int")).otherwise(F.col("w")), "ch": F.when(wide, F.col("h")).otherwise(F.rint(F.col("w") / 1.5).cast("int"))})
    return c.select("p_partkey", "cw", "ch", F.expr("cast((w - cw) div 2 as int)").alias("left"), F.expr("cast((h - ch) div 2 as int)").alias("top"), (F.abs(F.col("w") / F.col("h") / 1.5 - 1) > 0.01).alias("locked_refuses"))


@query("xf_pose_arc", """WITH n AS (SELECT label AS seq, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k, count(*) OVER (PARTITION BY label) AS n FROM embeddings) SELECT vec_id, round(sin(pi() * k / (n - 1)), 9) + 0.0 AS lift, round_even(round(10 * sin(pi() * k / (n - 1)), 6), 0)::INT AS px FROM n WHERE n > 1""")
def q_arc(spark, sf_dir: str) -> DataFrame:
    """Row 93: a jump's arc over a sequence."""
    w = Window.partitionBy("label")
    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", (F.row_number().over(w.orderBy("vec_id")) - 1).alias("k"), F.count(F.lit(1)).over(w).alias("n")).where("n > 1")
    lift = F.sin(F.pi() * F.col("k") / (F.col("n") - 1))
    return n.select("vec_id", (F.round(lift, 9) + 0.0).alias("lift"), F.rint(F.round(10 * lift, 6)).cast("int").alias("px"))


def affine_inverse(t: dict, source: tuple[int, int], cell: tuple[int, int]) -> tuple[float, ...]:
    """Row 95: the six numbers that take a target place to its source place.

    Forward is a turn (degrees, counter-clockwise on the screen) of a shear of a scale of a flip, about the middles of
    source and cell, then a shift. A determinant near zero is held at 1e-6.
    """
    turn, size = math.radians(t.get("rotate", 0.0)), t.get("scale", 1.0)
    rotate = np.array([[math.cos(turn), math.sin(turn)], [-math.sin(turn), math.cos(turn)]])
    shear = np.array([[1.0, t.get("shx", 0.0)], [t.get("shy", 0.0), 1.0]])
    m = size * rotate @ shear @ np.diag([-1.0 if t.get("flipX") else 1.0, 1.0])
    det = m[0, 0] * m[1, 1] - m[0, 1] * m[1, 0]
    if abs(det) < 1e-6:
        det = math.copysign(1e-6, det) if det else 1e-6
    inverse = np.array([[m[1, 1], -m[0, 1]], [-m[1, 0], m[0, 0]]]) / det
    shift = np.array(source) / 2 - inverse @ (np.array(cell) / 2 + [t.get("dx", 0), t.get("dy", 0)])
    return tuple(float(v) for row, c in zip(inverse, shift, strict=True) for v in (*row, c))


def affine(p: np.ndarray, t: dict, cell: tuple[int, int]) -> np.ndarray:
    """Every target pixel takes the source pixel under its centre; nothing where that lies outside."""
    h, w = p.shape[:2]
    a, b, c, d, e, f = affine_inverse(t, (w, h), cell)
    tx, ty = np.arange(cell[0])[None, :] + 0.5, np.arange(cell[1])[:, None] + 0.5
    x, y = np.floor(a * tx + b * ty + c).astype(int), np.floor(d * tx + e * ty + f).astype(int)
    inside = (x >= 0) & (x < w) & (y >= 0) & (y < h)
    return np.where(inside[..., None], p[y.clip(0, h - 1), x.clip(0, w - 1)], 0)


TRANSFORM = {"rotate": 20.0, "scale": 1.25, "dx": 1, "dy": -1, "shx": 0.25, "shy": 0.1, "flipX": 1}
_A, _B, _C, _D, _E, _F = (f"({v!r}::DOUBLE)" for v in affine_inverse(TRANSFORM, (8, 8), (8, 8)))


@query("xf_affine", f"""WITH {PX}, t AS (SELECT u::INT AS tx, v::INT AS ty FROM range(8) a(u), range(8) b(v)), s AS (SELECT tx, ty, floor({_A} * (tx + 0.5::DOUBLE) + {_B} * (ty + 0.5::DOUBLE) + {_C})::INT AS sx, floor({_D} * (tx + 0.5::DOUBLE) + {_E} * (ty + 0.5::DOUBLE) + {_F})::INT AS sy FROM t),
i AS (SELECT DISTINCT image_id FROM px), c AS (SELECT px.image_id, sum(a * (ty * 8 + tx + 1))::BIGINT AS digest FROM s JOIN px ON px.x = sx AND px.y = sy GROUP BY px.image_id) SELECT i.image_id, coalesce(digest, 0)::BIGINT AS digest, 64::BIGINT AS n FROM i LEFT JOIN c USING (image_id)""")
def q_affine(spark, sf_dir: str) -> DataFrame:
    """Row 95: target pixels are mapped back, so scaling up leaves no holes."""
    return digests(frames(spark, sf_dir), lambda p: affine(p, TRANSFORM, (8, 8)))


def nine_slice(p: np.ndarray, guides: tuple[int, int, int, int], width: int, height: int) -> np.ndarray:
    """Row 96: left, top, right and bottom guides; corners stay, what lies between stretches by the nearest pixel."""
    left, top, right, bottom = guides

    def source(old: int, new: int, first: int, last: int) -> np.ndarray:
        t = np.arange(new)
        inner = first + np.floor((t - first + 0.5) * (old - first - last) / max(1, new - first - last)).astype(int)
        return np.where(t < first, t, np.where(t >= new - last, t - new + old, inner))

    return p[source(p.shape[0], height, top, bottom)[:, None], source(p.shape[1], width, left, right)[None, :]]


@query("xf_nine_slice", f"""WITH {PX}, t AS (SELECT u::INT AS tx, v::INT AS ty FROM range(12) a(u), range(12) b(v)), m AS (SELECT tx, ty, CASE WHEN tx < 2 THEN tx WHEN tx >= 10 THEN tx - 4 ELSE 2 + floor((tx - 2 + 0.5) * 4 / 8)::INT END AS sx, CASE WHEN ty < 2 THEN ty WHEN ty >= 10 THEN ty - 4 ELSE 2 + floor((ty - 2 + 0.5) * 4 / 8)::INT END AS sy FROM t)
SELECT image_id, {_SUMS.format(w=12)} FROM m JOIN px ON x = sx AND y = sy GROUP BY image_id""")
def q_nine(spark, sf_dir: str) -> DataFrame:
    """Row 96: 8 to 12 with guides at 2."""
    return digests(frames(spark, sf_dir), lambda p: nine_slice(p, (2, 2, 2, 2), 12, 12))


@query("xf_scroll", f"""WITH {PX}, s AS (SELECT image_id, a, step, ((x + round_even(step * 8 * 0.3125::DOUBLE, 0)::INT) % 8)::INT AS tx, y AS ty FROM px, range(4) t(step)) SELECT image_id, step::INT AS step, sum(a * (ty * 8 + tx + 1))::BIGINT AS digest FROM s GROUP BY image_id, step""")
def q_scroll(spark, sf_dir: str) -> DataFrame:
    """Rows 97, 98: four steps of a wrapped layer that moves by its parallax."""

    def run(p: np.ndarray) -> list[dict]:
        shift = lambda k: int(np.rint(k * p.shape[1] * 0.3125))
        return [{"step": k, "digest": digest(np.roll(p, shift(k), axis=1))["digest"]} for k in range(4)]

    return K.per_frame(frames(spark, sf_dir), run, "step int, digest long")


@query("xf_compose_grid", f"""WITH {PX}, g AS (SELECT seq, a, (fidx % 4) * 8 + x AS tx, (fidx // 4) * 8 + y AS ty FROM px) SELECT seq, sum(a * (ty * 32 + tx + 1))::BIGINT AS digest, (max(ty) + 1)::INT AS height FROM g GROUP BY seq""")
def q_grid(spark, sf_dir: str) -> DataFrame:
    """Row 99: all frames of a sequence on a sheet of four columns."""
    laid = K.per_frame(sheets(frames(spark, sf_dir), 4), lambda p: [{"digest": digest(p)["digest"], "height": p.shape[0]}], "digest long, height int")
    return laid.select(F.col("image_id").cast("int").alias("seq"), "digest", "height")


@query("xf_extrude", f"""WITH {PX}, t AS (SELECT u::INT AS tx, v::INT AS ty, greatest(0, least(7, u - 2))::INT AS sx, greatest(0, least(7, v - 2))::INT AS sy FROM range(12) a(u), range(12) b(v)) SELECT image_id, {_SUMS.format(w=12)} FROM t JOIN px ON x = sx AND y = sy GROUP BY image_id""")
def q_extrude(spark, sf_dir: str) -> DataFrame:
    """Row 100: border pixels and corners repeated outward by two."""
    return digests(frames(spark, sf_dir), lambda p: np.pad(p, ((2, 2), (2, 2), (0, 0)), mode="edge"))


def to_baseline(p: np.ndarray, baseline: int) -> np.ndarray:
    """Row 101: content moved so that its lowest row is ``baseline``; what leaves the canvas is lost."""
    low = bounds(p[..., 3] > 16)[3]
    out = np.zeros_like(p)
    if low is None:
        return out
    by = baseline + 1 - low
    h = p.shape[0]
    out[max(0, by) : h + min(0, by)] = p[max(0, -by) : h - max(0, by)]
    return out


@query("xf_baseline_shift", f"""WITH {PX}, b AS (SELECT image_id, max(y) FILTER (a > 16) AS low FROM px GROUP BY image_id), s AS (SELECT px.image_id, a, x AS tx, y + 7 - low AS ty FROM px JOIN b USING (image_id))
SELECT image_id, coalesce(sum(a * (ty * 8 + tx + 1)) FILTER (ty BETWEEN 0 AND 7), 0)::BIGINT AS digest, 64::BIGINT AS n FROM s GROUP BY image_id""")
def q_shift(spark, sf_dir: str) -> DataFrame:
    """Row 101."""
    return digests(frames(spark, sf_dir), lambda p: to_baseline(p, p.shape[0] - 1))


def harmonise(p: np.ndarray, band: int) -> np.ndarray:
    """Row 102: both edges blended towards their mean, with a linear ramp."""
    w, x = p.shape[1], np.arange(p.shape[1])
    mean = (p[:, :1] + p[:, -1:]) / 2.0
    far = np.where(x < band, x, np.where(x > w - 1 - band, w - 1 - x, band))[None, :, None]
    return np.rint(p + (mean - p) * (1 - far / band)).astype(np.int64)


@query("xf_harmonise_edges", f"""WITH {PX}, e AS (SELECT l.image_id, l.y, l.a AS la, r.a AS ra FROM px l JOIN px r ON l.image_id = r.image_id AND l.y = r.y AND l.x = 0 AND r.x = 7),
b AS (SELECT px.image_id, CASE WHEN x < 2 THEN round_even(px.a + ((la + ra) / 2.0::DOUBLE - px.a) * (1 - x / 2.0::DOUBLE), 0) WHEN x > 5 THEN round_even(px.a + ((la + ra) / 2.0::DOUBLE - px.a) * (1 - (7 - x) / 2.0::DOUBLE), 0) ELSE px.a END::INT AS a, x AS tx, px.y AS ty FROM px JOIN e USING (image_id, y)) SELECT image_id, {_SUMS.format(w=8)} FROM b GROUP BY image_id""")
def q_harmonise(spark, sf_dir: str) -> DataFrame:
    """Row 102 with bands of two pixels."""
    return digests(frames(spark, sf_dir), lambda p: harmonise(p, 2))


@query("layout_raw_cells", """WITH s AS (SELECT p_partkey, p_size + 17 AS w, p_size * 2 + 9 AS h, (p_partkey % 5 + 1)::INT AS cols, (p_partkey % 3 + 1)::INT AS rws FROM part), c AS (SELECT s.*, k::INT AS k, (k % cols)::INT AS c, (k // cols)::INT AS r FROM s, range(15) t(k) WHERE k < cols * rws)
SELECT p_partkey, k, round_even(c * w / cols::DOUBLE, 0)::INT AS x0, round_even(r * h / rws::DOUBLE, 0)::INT AS y0, round_even((c + 1) * w / cols::DOUBLE, 0)::INT AS x1, round_even((r + 1) * h / rws::DOUBLE, 0)::INT AS y1 FROM c""")
def q_raw_cells(spark, sf_dir: str) -> DataFrame:
    """Rows 114, 115: cell bounds of a grid, halves to even."""
    s = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", (F.col("p_size") + 17).alias("w"), (F.col("p_size") * 2 + 9).alias("h"), (F.col("p_partkey") % 5 + 1).cast("int").alias("cols"), (F.col("p_partkey") % 3 + 1).cast("int").alias("rws"))
    c = s.withColumn("k", F.explode(F.expr("sequence(0, cols * rws - 1)"))).withColumns({"c": F.expr("k % cols"), "r": F.expr("cast(k div cols as int)")})
    edge = lambda i, size, n: F.rint(i * F.col(size) / F.col(n)).cast("int")
    return c.select("p_partkey", "k", edge(F.col("c"), "w", "cols").alias("x0"), edge(F.col("r"), "h", "rws").alias("y0"), edge(F.col("c") + 1, "w", "cols").alias("x1"), edge(F.col("r") + 1, "h", "rws").alias("y1"))


@query("layout_atlas", """WITH n AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS c FROM embeddings) SELECT vec_id, (c * 14 + 3)::INT AS x, (label * 14 + 3)::INT AS y FROM n""")
def q_atlas(spark, sf_dir: str, cell: int = 8, gutter: int = 2, extrusion: int = 1) -> DataFrame:
    """Row 215: slots of cell + 2 x (gutter + extrusion), a row for each state."""
    slot, pad = cell + 2 * (gutter + extrusion), gutter + extrusion
    c = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", (c * slot + pad).alias("x"), (F.col("label") * slot + pad).alias("y"))


@query("layout_iso", """WITH p AS (SELECT p_partkey, (p_partkey % 11)::INT AS gx, (p_partkey // 11 % 7)::INT AS gy, p_size % 3 AS z FROM part) SELECT p_partkey, (100 + (gx - gy) * 32)::INT AS sx, (50 + (gx + gy) * 16 - z)::INT AS sy, gx + gy + z * 0.1::DOUBLE AS depth FROM p""")
def q_iso(spark, sf_dir: str, tw: int = 64, th: int = 32) -> DataFrame:
    """Row 212: screen place and painter's depth of grid cells."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", (F.col("p_partkey") % 11).cast("int").alias("gx"), F.expr("cast(p_partkey div 11 % 7 as int)").alias("gy"), F.expr("p_size % 3").alias("z"))
    return p.select("p_partkey", F.expr(f"100 + (gx - gy) * {tw // 2}").alias("sx"), F.expr(f"50 + (gx + gy) * {th // 2} - z").alias("sy"), (F.col("gx") + F.col("gy") + F.col("z") * 0.1).alias("depth"))


@query("layout_iso_calibration", """SELECT p_brand, round_even(median(p_size), 0)::INT AS footprint, round_even(median(p_retailprice), 0)::INT AS pivot, abs(median(p_size) / 12.5 - 2) <= 0.12 AS ratio_ok FROM part GROUP BY p_brand""")
def q_calibration(spark, sf_dir: str) -> DataFrame:
    """Rows 213, 214, 245: medians rounded to even, and the 2:1 check."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.groupBy("p_brand").agg(F.rint(F.median("p_size")).cast("int").alias("footprint"), F.rint(F.median("p_retailprice")).cast("int").alias("pivot"), (F.abs(F.median("p_size") / 12.5 - 2) <= 0.12).alias("ratio_ok"))


@query("layout_zoom", """SELECT p_partkey, CASE WHEN p_size * 8 <= 64 THEN 8 WHEN p_size * 8 <= 128 THEN 4 WHEN p_size * 8 <= 256 THEN 2 ELSE 1 END AS zoom FROM part""")
def q_zoom(spark, sf_dir: str) -> DataFrame:
    """Row 211."""
    side = F.col("p_size") * 8
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.when(side <= 64, 8).when(side <= 128, 4).when(side <= 256, 2).otherwise(1).alias("zoom"))


@query("layout_grid_completion", """SELECT p_partkey, p_size AS frames, ceil(sqrt(p_size))::INT AS columns_, ceil(p_size / ceil(sqrt(p_size)))::INT AS rows_, (p_size % 4)::INT AS spare FROM part""")
def q_completion(spark, sf_dir: str) -> DataFrame:
    """Rows 188, 216: columns and rows for a number of frames."""
    c = F.ceil(F.sqrt("p_size"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.col("p_size").alias("frames"), c.cast("int").alias("columns_"), F.ceil(F.col("p_size") / c).cast("int").alias("rows_"), (F.col("p_size") % 4).alias("spare"))


@query("layout_durations", """WITH n AS (SELECT user_id, event_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events) SELECT user_id, event_id, coalesce(least(5000, (epoch_us(nx) - epoch_us(ts)) // 1000), 125)::BIGINT AS duration_ms FROM n""")
def q_durations(spark, sf_dir: str, fps: int = 8) -> DataFrame:
    """Row 210: explicit frame durations, else one over the frame rate."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    micros = lambda c: F.unix_micros(F.to_timestamp(c))
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts")).withColumn("nx", F.lead("ts").over(w))
    gap = F.floor((micros(F.col("nx")) - micros(F.col("ts"))) / 1000)
    return e.select("user_id", "event_id", F.coalesce(F.least(F.lit(5000), gap), F.lit(round(1000 / fps))).cast("long").alias("duration_ms"))
