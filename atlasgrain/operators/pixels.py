"""Queries on pixel functions (survey rows 26 to 44)."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import colour as C
from ..plans.registry import query
from ..sources.frames import PX, frames, pixels
from . import kernels as K

MAGENTA = (255, 0, 255)
D2 = "((r - 255) * (r - 255) + g * g + (b - 255) * (b - 255))"
TINT = "((r + b)::DOUBLE / 2 - g)"


@query("px_chroma_counts", f"""WITH {PX} SELECT image_id, sum({D2})::BIGINT AS sum_distance_sq, count(*) FILTER (a > 16 AND {D2} <= 22500)::BIGINT AS adjacent,
  count(*) FILTER (a <= 16 OR {D2} <= 9216 OR ({D2} <= 32400 AND {TINT} >= 18))::BIGINT AS candidates FROM px GROUP BY image_id""")
def chroma_counts(spark, sf_dir: str, key=MAGENTA) -> DataFrame:
    """Rows 26, 31, 32."""
    return pixels(spark, sf_dir).groupBy("image_id").agg(
        F.sum(C.distance_sq(key)).cast("long").alias("sum_distance_sq"), F.count_if((F.col("a") > 16) & (C.distance_sq(key) <= 22500)).alias("adjacent"), F.count_if(C.chroma_candidate(key)).alias("candidates")
    )


@query("px_key_tint", f"""WITH {PX} SELECT image_id, sum({TINT}) AS tint, sum(least(r, g))::BIGINT AS red, sum(least(b, g))::BIGINT AS blue FROM px GROUP BY image_id""")
def key_tint(spark, sf_dir: str, key=MAGENTA) -> DataFrame:
    """Rows 27, 28."""
    n = C.neutralise(key)
    return pixels(spark, sf_dir).groupBy("image_id").agg(F.sum(C.key_tint(key)).alias("tint"), F.sum(n["r"]).alias("red"), F.sum(n["b"]).alias("blue"))


@query("px_soft_edges", f"""WITH {PX}, d AS (SELECT *, sqrt({D2}::DOUBLE) AS d FROM px), t AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (d - 220.0::DOUBLE) / 80.0::DOUBLE)) AS t FROM d)
SELECT image_id, sum(CASE WHEN a <= 16 OR d <= 220 THEN 0 WHEN d >= 300 THEN a ELSE round_even(a * (t * t * (3.0::DOUBLE - 2.0::DOUBLE * t)), 0) END)::BIGINT AS alpha FROM t GROUP BY image_id""")
def soft_edges(spark, sf_dir: str, key=MAGENTA) -> DataFrame:
    """Rows 29, 30."""
    return pixels(spark, sf_dir).groupBy("image_id").agg(F.sum(C.soft_alpha(C.distance(key), 220.0, 300.0)).alias("alpha"))


@query("px_visible_magenta", f"""WITH {PX}, m AS (SELECT *, a >= 24 AND r >= 60 AND b >= 60 AND g <= 96 AND r - g >= 30 AND b - g >= 30 AS hit FROM px)
SELECT image_id, count(*) FILTER (hit)::BIGINT AS n, count(*) FILTER (hit)::DOUBLE / count(*) AS ratio, coalesce(min(x) FILTER (hit), -1) AS x0, coalesce(max(x) FILTER (hit) + 1, -1) AS x1, coalesce(min(y) FILTER (hit), -1) AS y0, coalesce(max(y) FILTER (hit) + 1, -1) AS y1,
  (count(*) FILTER (hit) > 64 OR count(*) FILTER (hit)::DOUBLE / count(*) > 0.00005) AS failed FROM m GROUP BY image_id""")
def visible_magenta(spark, sf_dir: str) -> DataFrame:
    """Row 33, with thresholds that suit the small rasters; bounds are -1 where nothing is seen."""
    hit = C.visible_magenta(red=60, blue=60, red_delta=30, blue_delta=30)
    n = F.count_if(hit)
    edge = lambda f, c: F.coalesce(f(F.when(hit, F.col(c) + int(f is F.max))), F.lit(-1))
    return pixels(spark, sf_dir).groupBy("image_id").agg(
        n.alias("n"), (n / F.count(F.lit(1))).alias("ratio"), edge(F.min, "x").alias("x0"), edge(F.max, "x").alias("x1"), edge(F.min, "y").alias("y0"), edge(F.max, "y").alias("y1"),
        ((n > 64) | (n / F.count(F.lit(1)) > 0.00005)).alias("failed"),
    )


@query("px_vfx_signal", f"""WITH {PX} SELECT image_id, count(*) FILTER (a > 16 AND ((b >= 140 AND g >= 96 AND b >= r + 18) OR (r >= 150 AND g >= 80 AND r >= b + 18) OR (greatest(r, g, b) >= 128 AND greatest(r, g, b) - least(r, g, b) >= 48)))::BIGINT AS signal FROM px GROUP BY image_id""")
def vfx_signal(spark, sf_dir: str) -> DataFrame:
    """Row 34."""
    return pixels(spark, sf_dir).groupBy("image_id").agg(F.count_if(C.vfx_signal()).alias("signal"))


@query("px_limbs", f"""WITH {PX}, c AS (SELECT *, greatest(r, g, b) AS top, greatest(r, g, b) - least(r, g, b) AS span FROM px),
h AS (SELECT *, CASE WHEN r = top THEN (g - b) / greatest(span, 1)::DOUBLE WHEN g = top THEN 2.0::DOUBLE + (b - r) / greatest(span, 1)::DOUBLE ELSE 4.0::DOUBLE + (r - g) / greatest(span, 1)::DOUBLE END / 6.0::DOUBLE AS hh FROM c),
k AS (SELECT *, CASE WHEN span = 0 THEN 0 ELSE floor((hh - floor(hh)) * 255.0::DOUBLE) END AS hue, floor(span * 255.0::DOUBLE / greatest(top, 1)) AS sat FROM h),
l AS (SELECT *, CASE WHEN sat < 70 OR top < 65 THEN NULL WHEN hue <= 14 OR hue >= 244 THEN 'red_arm' WHEN hue <= 43 THEN 'orange_leg' WHEN hue <= 112 THEN 'green_leg' WHEN hue <= 190 THEN 'blue_arm' END AS limb FROM k)
SELECT image_id, limb, count(*)::BIGINT AS n, avg(x)::DOUBLE AS cx, avg(y)::DOUBLE AS cy FROM l WHERE limb IS NOT NULL GROUP BY image_id, limb""")
def limbs(spark, sf_dir: str) -> DataFrame:
    """Rows 35, 68."""
    return pixels(spark, sf_dir).withColumn("limb", C.limb()).where("limb IS NOT NULL").groupBy("image_id", "limb").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))


@query("px_alpha_policy", f"""WITH {PX} SELECT image_id, count(*) FILTER (a >= 64)::BIGINT AS hard, count(DISTINCT a) FILTER (a > 0 AND a < 255)::BIGINT AS fractional,
  coalesce(array_to_string(list_sort(list(DISTINCT a) FILTER (a > 0 AND a < 255)), ','), '') AS levels FROM px GROUP BY image_id""")
def alpha_policy(spark, sf_dir: str) -> DataFrame:
    """Rows 36, 41."""
    part = F.when((F.col("a") > 0) & (F.col("a") < 255), F.col("a"))
    levels = F.array_sort(F.collect_set(part))
    return pixels(spark, sf_dir).groupBy("image_id").agg(F.count_if(F.col("a") >= 64).alias("hard"), F.count_distinct(part).alias("fractional"), F.array_join(levels.cast("array<string>"), ",").alias("levels"))


@query("px_contrast", """WITH c AS (SELECT p_partkey, '#' || printf('%06x', (p_partkey * 7919 % 16777216)::INT) AS code FROM part),
k AS (SELECT *, ('0x' || substr(code, 2, 2))::INT AS r, ('0x' || substr(code, 4, 2))::INT AS g, ('0x' || substr(code, 6, 2))::INT AS b FROM c),
f AS (SELECT *, list_transform([r, g, b], lambda v: CASE WHEN v / 255.0::DOUBLE <= 0.04045 THEN v / 255.0::DOUBLE / 12.92::DOUBLE ELSE pow((v / 255.0::DOUBLE + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END) AS q FROM k)
SELECT p_partkey, code, round(1.05::DOUBLE / (0.2126::DOUBLE * q[1] + 0.7152::DOUBLE * q[2] + 0.0722::DOUBLE * q[3] + 0.05::DOUBLE), 6) AS on_white FROM f""")
def contrast(spark, sf_dir: str) -> DataFrame:
    """Rows 37, 38."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.concat(F.lit("#"), F.lower(F.lpad(F.hex(F.col("p_partkey") * 7919 % 16777216), 6, "0"))).alias("code"))
    return part.select("p_partkey", "code", F.round(C.contrast(F.lit(1.0), C.luminance(*C.hex_rgb(F.col("code")))), 6).alias("on_white"))


@query("px_blend_modes", f"""WITH {PX}, n AS (SELECT *, lead(r) OVER (PARTITION BY seq, i ORDER BY fidx) AS o FROM px)
SELECT image_id, sum(255 - floor((255 - r) * (255 - o) / 255.0::DOUBLE))::BIGINT AS screen, sum(floor(r * o / 255.0::DOUBLE))::BIGINT AS multiply, sum(least(255, r + o))::BIGINT AS added, sum(o)::BIGINT AS normal FROM n WHERE o IS NOT NULL GROUP BY image_id""")
def blend_modes(spark, sf_dir: str) -> DataFrame:
    """Row 39: each frame under the next of its sequence; packed frames meet, not pixels."""
    laid = frames(spark, sf_dir).withColumn("o", F.lead("r").over(Window.partitionBy("seq").orderBy("fidx"))).where("o IS NOT NULL")
    total = lambda m: F.aggregate(F.zip_with("r", "o", lambda low, top: C.blend(m, low, top).cast("long")), F.lit(0).cast("long"), lambda s, v: s + v)
    return laid.select("image_id", *[total(m).alias(n) for m, n in (("screen", "screen"), ("multiply", "multiply"), ("add", "added"), ("normal", "normal"))])


@query("px_palette_invariant", f"""WITH {PX}, p AS (SELECT DISTINCT seq, fidx, r // 32 AS r, g // 32 AS g, b // 32 AS b FROM px WHERE a > 16)
SELECT p.seq, p.fidx, count(*)::BIGINT AS new_colours FROM p WHERE p.fidx > 0 AND NOT EXISTS (SELECT 1 FROM p q WHERE q.seq = p.seq AND q.fidx = p.fidx - 1 AND q.r = p.r AND q.g = p.g AND q.b = p.b) GROUP BY p.seq, p.fidx""")
def palette_invariant(spark, sf_dir: str) -> DataFrame:
    """Row 40: colours of a frame that the frame before has not."""
    step = lambda c: F.floor(F.col(c) / 32).cast("int").alias(c)
    p = pixels(spark, sf_dir).where("a > 16").select("seq", "fidx", step("r"), step("g"), step("b")).distinct()
    before = p.withColumn("fidx", F.col("fidx") + 1)
    return p.where("fidx > 0").join(before, ["seq", "fidx", "r", "g", "b"], "left_anti").groupBy("seq", "fidx").agg(F.count(F.lit(1)).alias("new_colours"))


def border_palette(p: np.ndarray, threshold: float = 28.0, most: int = 8) -> list[tuple[int, int, int]]:
    """Solid border colours by frequency (ties: first met, going over top and bottom, then left and right), none within
    ``threshold`` of an earlier one."""
    h, w = p.shape[:2]
    walk = [(y, x) for x in range(w) for y in (0, h - 1)] + [(y, x) for y in range(h) for x in (0, w - 1)]
    count, first, seen = Counter(), {}, set()
    for k, (y, x) in enumerate(walk):
        if (y, x) not in seen and p[y, x, 3] > 16:
            c = tuple(p[y, x, :3].tolist())
            count[c] += 1
            first.setdefault(c, k)
        seen.add((y, x))
    out: list[tuple[int, int, int]] = []
    for c in sorted(count, key=lambda c: (-count[c], first[c])):
        if len(out) < most and all(math.dist(c, q) > threshold for q in out):
            out.append(c)
    return out


@query("px_edge_palette")
def edge_palette(spark, sf_dir: str) -> DataFrame:
    """Row 42; sequential by nature, so tests hold it against a version by hand."""

    def run(p: np.ndarray) -> list[dict]:
        found = border_palette(p)
        return [{"n": len(found), "palette": ",".join("#%02x%02x%02x" % c for c in found)}] if found else []

    return K.per_frame(frames(spark, sf_dir), run, "n int, palette string")


KEYS = [("gray", 128, 128, 128), ("black", 0, 0, 0), ("white", 255, 255, 255)]


@query("px_background_choice", f"""WITH {PX}, k(pref, name, kr, kg, kb) AS (VALUES (0, 'gray', 128, 128, 128), (1, 'black', 0, 0, 0), (2, 'white', 255, 255, 255)),
d AS (SELECT image_id, pref, name, list_sort(list((r - kr) * (r - kr) + (g - kg) * (g - kg) + (b - kb) * (b - kb))) AS d FROM px, k WHERE a > 16 GROUP BY image_id, pref, name),
p AS (SELECT *, d[floor(len(d) * 0.01)::INT + 1] AS low FROM d)
SELECT image_id, name, low::BIGINT AS low FROM p QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY low DESC, pref) = 1""")
def background_choice(spark, sf_dir: str) -> DataFrame:
    """Row 43: the background whose lower percentile of distance to the subject is greatest; ties by list order."""

    def run(p: np.ndarray) -> list[dict]:
        subject = p[p[..., 3] > 16][:, :3]
        if not len(subject):
            return []
        low = [int(np.sort(((subject - key) ** 2).sum(axis=1))[int(len(subject) * 0.01)]) for _, *key in KEYS]
        best = low.index(max(low))
        return [{"name": KEYS[best][0], "low": low[best]}]

    return K.per_frame(frames(spark, sf_dir), run, "name string, low long")


@query("px_key_safety", f"""WITH {PX}, k(pref, name, kr, kg, kb) AS (VALUES (0, 'magenta', 255, 0, 255), (1, 'green', 0, 255, 0), (2, 'blue', 0, 0, 255)),
d AS (SELECT image_id, pref, name, list_sort(list((r - kr) * (r - kr) + (g - kg) * (g - kg) + (b - kb) * (b - kb))) AS d FROM px, k WHERE a > 16 GROUP BY image_id, pref, name),
p AS (SELECT *, len(list_filter(d, lambda v: v <= 144))::BIGINT AS exact, len(list_filter(d, lambda v: v <= 40000))::BIGINT AS near, d[round_even((len(d) - 1) * 0.01, 0)::INT + 1]::BIGINT AS low FROM d)
SELECT image_id, name, exact, near, low FROM p QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY exact, low DESC, near, pref) = 1""")
def key_safety(spark, sf_dir: str) -> DataFrame:
    """Row 44: the key with fewest exact, farthest first-percentile and fewest near subject pixels."""
    keys = [("magenta", 255, 0, 255), ("green", 0, 255, 0), ("blue", 0, 0, 255)]

    def run(p: np.ndarray) -> list[dict]:
        subject = p[p[..., 3] > 16][:, :3]
        if not len(subject):
            return []
        found = []
        for k, (name, *key) in enumerate(keys):
            d = np.sort(((subject - key) ** 2).sum(axis=1))
            exact, near, low = int((d <= 144).sum()), int((d <= 40000).sum()), int(d[int(np.rint((len(d) - 1) * 0.01))])
            found.append(((exact, -low, near, k), {"name": name, "exact": exact, "near": near, "low": low}))
        return [min(found, key=lambda f: f[0])[1]]

    return K.per_frame(frames(spark, sf_dir), run, "name string, exact long, near long, low long")
