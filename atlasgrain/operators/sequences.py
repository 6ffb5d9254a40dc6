"""Frame sequences (survey rows 124 to 154): differences of neighbours, ranges, contacts, loops and gates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.frames import PX, frames, with_pixels
from . import kernels as K
from .frames import METRICS_SQL, bbox_metrics, bounds


def packed(frames: DataFrame) -> DataFrame:
    """Packed frames with an array of pixel structs; pairs of frames then need no pixel join and no regrouping."""
    return with_pixels(frames)


def _count(zipped: Column, test) -> Column:
    return F.size(F.filter(zipped, test))


def mask_diff(p: Column, q: Column, start: Column) -> Column:
    """Pixels in one mask only over pixels in either, from row ``start`` on; 0 if both are empty."""
    z = F.filter(F.arrays_zip(p.alias("p"), q.alias("q")), lambda s: s["p"]["y"] >= start)
    on = lambda s: (s["p"]["a"] > 16) | (s["q"]["a"] > 16)
    union, xor = _count(z, on), _count(z, lambda s: (s["p"]["a"] > 16) != (s["q"]["a"] > 16))
    return F.when(union > 0, xor / union).otherwise(0.0)


def visual_diff(p: Column, q: Column, least: int = 24) -> Column:
    z = F.filter(F.arrays_zip(p.alias("p"), q.alias("q")), lambda s: (s["p"]["a"] > 0) | (s["q"]["a"] > 0))
    changed = _count(z, lambda s: F.greatest(*[F.abs(s["p"][c] - s["q"][c]) for c in "rgb"]) >= least)
    return F.when(F.size(z) > 0, changed / F.size(z)).otherwise(0.0)


def pair_diffs(frames: DataFrame, cyclic: bool = True) -> DataFrame:
    """Rows 124 to 126: each frame against the next; the last against the first where ``cyclic`` and over two frames."""
    w = Window.partitionBy("seq").orderBy("fidx")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    f = packed(frames).withColumn("next", F.lead("p").over(w)).withColumn("first", F.first("p").over(w)).withColumn("frames", F.count(F.lit(1)).over(whole))
    f = f.withColumn("q", F.coalesce("next", F.when(F.lit(cyclic) & (F.col("frames") > 2), F.col("first")))).where("q IS NOT NULL")
    low = F.greatest(F.lit(0), F.least(F.col("h") - 1, F.rint(F.col("h") * 0.45).cast("int")))
    return f.select("seq", "fidx", "image_id", "frames", mask_diff(F.col("p"), F.col("q"), F.lit(0)).alias("diff"), mask_diff(F.col("p"), F.col("q"), low).alias("lower_diff"), visual_diff(F.col("p"), F.col("q")).alias("visual_diff"))


DIFFS = f"""nx AS (SELECT seq, fidx, image_id, count(*) OVER (PARTITION BY seq) AS frames, coalesce(lead(image_id) OVER (PARTITION BY seq ORDER BY fidx), CASE WHEN count(*) OVER (PARTITION BY seq) > 2 THEN first_value(image_id) OVER (PARTITION BY seq ORDER BY fidx) END) AS nxt
  FROM (SELECT DISTINCT seq, fidx, image_id FROM px)),
pr AS (SELECT nx.seq, nx.fidx, nx.image_id, nx.frames, p.y, p.a > 16 AS pa, q.a > 16 AS qa, p.a > 0 OR q.a > 0 AS seen, greatest(abs(p.r - q.r), abs(p.g - q.g), abs(p.b - q.b)) AS d FROM nx JOIN px p ON p.image_id = nx.image_id JOIN px q ON q.image_id = nx.nxt AND q.i = p.i),
diffs AS (SELECT seq, fidx, image_id, frames, coalesce(count(*) FILTER (pa <> qa) / nullif(count(*) FILTER (pa OR qa), 0)::DOUBLE, 0.0::DOUBLE) AS diff,
  coalesce(count(*) FILTER (pa <> qa AND y >= 4) / nullif(count(*) FILTER ((pa OR qa) AND y >= 4), 0)::DOUBLE, 0.0::DOUBLE) AS lower_diff,
  coalesce(count(*) FILTER (seen AND d >= 24) / nullif(count(*) FILTER (seen), 0)::DOUBLE, 0.0::DOUBLE) AS visual_diff FROM pr GROUP BY ALL)"""


@query("seq_pair_diffs", f"WITH {PX}, {DIFFS} SELECT seq, fidx, image_id, frames::BIGINT AS frames, diff, lower_diff, visual_diff FROM diffs")
def q_pairs(spark, sf_dir: str) -> DataFrame:
    return pair_diffs(frames(spark, sf_dir))


def metric_ranges(frames: DataFrame) -> DataFrame:
    """Rows 127, 128, 137: ranges of the bounds over a sequence, and the relative range of the area."""
    m = bbox_metrics(frames, ("seq", "fidx")).withColumns({c: F.col(c).cast("int") for c in ("seq", "fidx")})
    span = lambda c: F.max(c) - F.min(c)
    g = m.groupBy("seq").agg(*[span(c).alias(f"{c}_range") for c in ("width", "height", "center_x", "center_y", "bottom")], F.coalesce(span("alpha_area") / F.nullif(F.max("alpha_area"), F.lit(0.0)), F.lit(0.0)).alias("area_range"), F.max_by("fidx", F.struct("alpha_area", -F.col("fidx"))).alias("peak"), F.count(F.lit(1)).alias("frames"))
    return g.withColumn("jump_ok", F.greatest("center_y_range", "bottom_range") >= 0.035)


RANGES = f"""{METRICS_SQL}, mm AS (SELECT metrics.*, bx.seq, bx.fidx FROM metrics JOIN bx USING (image_id)),
ranges AS (SELECT seq, max(width) - min(width) AS width_range, max(height) - min(height) AS height_range, max(center_x) - min(center_x) AS center_x_range, max(center_y) - min(center_y) AS center_y_range, max(bottom) - min(bottom) AS bottom_range,
  coalesce((max(alpha_area) - min(alpha_area)) / nullif(max(alpha_area), 0), 0.0::DOUBLE) AS area_range, max_by(fidx, alpha_area * 1000000 - fidx) AS peak, count(*)::BIGINT AS frames, greatest(max(center_y) - min(center_y), max(bottom) - min(bottom)) >= 0.035 AS jump_ok FROM mm GROUP BY seq)"""


@query("seq_metric_ranges", f"WITH {PX}, {RANGES} SELECT * FROM ranges")
def q_ranges(spark, sf_dir: str) -> DataFrame:
    return metric_ranges(frames(spark, sf_dir))


@query("seq_locomotion", f"""WITH {PX}, {DIFFS}, s AS (SELECT seq, round(avg(lower_diff), 9) AS average_lower, min(lower_diff) AS least_lower, any_value(frames)::BIGINT AS frames FROM diffs GROUP BY seq)
SELECT seq, frames, average_lower, least_lower, CASE WHEN frames < 4 THEN NULL WHEN frames >= 6 THEN frames // 2 ELSE 2 END AS opposite, concat_ws(',', CASE WHEN average_lower < 0.10 THEN 'average' END, CASE WHEN least_lower < 0.04 THEN 'pair' END) AS errors FROM s""")
def q_locomotion(spark, sf_dir: str) -> DataFrame:
    """Rows 133, 134: the lower body has to move between all frames; which frame is the opposite contact."""
    s = pair_diffs(frames(spark, sf_dir)).groupBy("seq").agg(F.round(F.avg("lower_diff"), 9).alias("average_lower"), F.min("lower_diff").alias("least_lower"), F.first("frames").alias("frames"))
    errors = F.array_compact(F.array(F.when(F.col("average_lower") < 0.10, "average"), F.when(F.col("least_lower") < 0.04, "pair")))
    opposite = F.when(F.col("frames") < 4, None).when(F.col("frames") >= 6, F.floor(F.col("frames") / 2)).otherwise(2)
    return s.select("seq", "frames", "average_lower", "least_lower", opposite.cast("long").alias("opposite"), F.array_join(errors, ",").alias("errors"))


@query("seq_motion_variation", f"""WITH {PX}, {DIFFS}, s AS (SELECT seq, round(avg(lower_diff), 9) AS m, min(lower_diff) AS l FROM diffs GROUP BY seq) SELECT seq, CASE WHEN m < 0.10 THEN 'average' WHEN l < 0.04 THEN 'pair' ELSE 'ok' END AS verdict FROM s""")
def q_variation(spark, sf_dir: str) -> DataFrame:
    """Row 135: only the first failure counts."""
    s = pair_diffs(frames(spark, sf_dir)).groupBy("seq").agg(F.round(F.avg("lower_diff"), 9).alias("m"), F.min("lower_diff").alias("l"))
    return s.select("seq", F.when(F.col("m") < 0.10, "average").when(F.col("l") < 0.04, "pair").otherwise("ok").alias("verdict"))


@query("seq_action", f"""WITH {PX}, {DIFFS}, {RANGES}, s AS (SELECT seq, round(avg(diff), 9) AS d, round(avg(visual_diff), 9) AS v FROM diffs GROUP BY seq)
SELECT seq, d AS average_diff, v AS average_visual, greatest(width_range, height_range, center_x_range, center_y_range, area_range) AS motion, greatest(width_range, height_range, center_x_range, center_y_range, area_range) < 0.045 AND d < 0.055 AND v < 0.003 AS static, peak IN (0, frames - 1) AS peak_at_end FROM ranges JOIN s USING (seq)""")
def q_action(spark, sf_dir: str) -> DataFrame:
    """Rows 136, 138, 139: static only if ranges, silhouettes and colours all stay; a peak at either end is a warning."""
    px = frames(spark, sf_dir)
    d = pair_diffs(px).groupBy("seq").agg(F.round(F.avg("diff"), 9).alias("average_diff"), F.round(F.avg("visual_diff"), 9).alias("average_visual"))
    motion = F.greatest("width_range", "height_range", "center_x_range", "center_y_range", "area_range")
    return metric_ranges(px).join(d, "seq").select("seq", "average_diff", "average_visual", motion.alias("motion"), ((motion < 0.045) & (F.col("average_diff") < 0.055) & (F.col("average_visual") < 0.003)).alias("static"), ((F.col("peak") == 0) | (F.col("peak") == F.col("frames") - 1)).alias("peak_at_end"))


@query("seq_loop", f"""WITH {PX}, {DIFFS}, s AS (SELECT seq, max(diff) FILTER (fidx = frames - 1) AS closure, round(avg(diff) FILTER (fidx < frames - 1), 9) AS inner_ FROM diffs GROUP BY seq)
SELECT seq, closure, inner_ AS in_loop, closure > greatest(0.18, inner_ * 1.35) AS broken FROM s""")
def q_loop(spark, sf_dir: str) -> DataFrame:
    """Rows 131, 140: the step from the last frame to the first against the steps inside the loop."""
    last = F.col("fidx") == F.col("frames") - 1
    s = pair_diffs(frames(spark, sf_dir)).groupBy("seq").agg(F.max(F.when(last, F.col("diff"))).alias("closure"), F.round(F.avg(F.when(~last, F.col("diff"))), 9).alias("in_loop"))
    return s.withColumn("broken", F.col("closure") > F.greatest(F.lit(0.18), F.col("in_loop") * 1.35))


@query("seq_gesture", f"""WITH {PX}, z AS (SELECT seq, image_id AS first_id FROM px WHERE fidx = 0 AND i = 0), p AS (SELECT px.seq, px.fidx, px.x, px.a > 16 AS pa, q.a > 16 AS qa FROM px JOIN z USING (seq) JOIN px q ON q.image_id = z.first_id AND q.i = px.i WHERE px.y >= 4),
f AS (SELECT seq, fidx, coalesce(count(*) FILTER (pa <> qa) / nullif(count(*) FILTER (pa OR qa), 0)::DOUBLE, 0.0::DOUBLE) AS diff, (min(x) FILTER (pa) + max(x) FILTER (pa) + 1) / 16.0::DOUBLE AS center FROM p GROUP BY seq, fidx),
g AS (SELECT seq, max(diff) AS most, coalesce(max(center) - min(center), 0.0::DOUBLE) AS wander, count(*) FILTER (center IS NULL)::BIGINT AS missing FROM f GROUP BY seq)
SELECT *, concat_ws(',', CASE WHEN missing > 0 THEN 'missing' END, CASE WHEN most > 0.25 THEN 'moves' END, CASE WHEN wander > 0.025 THEN 'slides' END) AS errors FROM g""")
def q_gesture(spark, sf_dir: str) -> DataFrame:
    """Row 141: in a gesture the lower body of every frame stays as in the first: there, at its place, in its shape."""
    f = packed(frames(spark, sf_dir)).withColumn("q", F.first("p").over(Window.partitionBy("seq").orderBy("fidx")))
    low = F.rint(F.col("h") * 0.45).cast("int")
    feet = F.transform(F.filter("p", lambda s: (s["a"] > 16) & (s["y"] >= low)), lambda s: s["x"])
    f = f.select("seq", mask_diff(F.col("p"), F.col("q"), low).alias("diff"), ((F.array_min(feet) + F.array_max(feet) + 1) / (2 * F.col("w"))).alias("center"))
    g = f.groupBy("seq").agg(F.max("diff").alias("most"), F.coalesce(F.max("center") - F.min("center"), F.lit(0.0)).alias("wander"), F.count_if(F.col("center").isNull()).alias("missing"))
    errors = F.array_compact(F.array(F.when(F.col("missing") > 0, "missing"), F.when(F.col("most") > 0.25, "moves"), F.when(F.col("wander") > 0.025, "slides")))
    return g.withColumn("errors", F.array_join(errors, ","))


@query("seq_tiny", f"""WITH {PX}, {DIFFS}, s AS (SELECT seq, any_value(frames)::BIGINT AS frames, round(avg(diff), 9) AS average FROM diffs GROUP BY seq) SELECT seq, average, frames > 4 AS warned, frames >= 2 AND average < 0.015 AS failed FROM s""")
def q_tiny(spark, sf_dir: str) -> DataFrame:
    """Row 142: changes of tiny frames have to be seen; over four frames are a warning."""
    s = pair_diffs(frames(spark, sf_dir)).groupBy("seq").agg(F.first("frames").alias("frames"), F.round(F.avg("diff"), 9).alias("average"))
    return s.select("seq", "average", (F.col("frames") > 4).alias("warned"), ((F.col("frames") >= 2) & (F.col("average") < 0.015)).alias("failed"))


@query("seq_support", f"""WITH {PX}, c AS (SELECT image_id, seq, fidx, round(sum(x * a) / sum(a)::DOUBLE, 6) AS cx, round(sum(y * a) / sum(a)::DOUBLE, 6) AS cy FROM px WHERE a > 16 GROUP BY image_id, seq, fidx),
n AS (SELECT *, coalesce(lead(cx) OVER w, first_value(cx) OVER w) AS nx, coalesce(lead(cy) OVER w, first_value(cy) OVER w) AS ny FROM c WINDOW w AS (PARTITION BY seq ORDER BY fidx))
SELECT image_id, seq, fidx, round(sqrt((nx - cx) * (nx - cx) + (ny - cy) * (ny - cy)), 6) AS step, CASE WHEN cx < 3.2 THEN 'left' WHEN cx > 3.8 THEN 'right' ELSE 'center' END AS side FROM n""")
def q_support(spark, sf_dir: str) -> DataFrame:
    """Rows 129, 132: closed-loop steps of the weighted centre, and the side it is on."""

    def run(p: np.ndarray) -> list[dict]:
        y, x = np.nonzero(p[..., 3] > 16)
        a = p[y, x, 3]
        return [{"cx": round(int((x * a).sum()) / int(a.sum()), 6), "cy": round(int((y * a).sum()) / int(a.sum()), 6)}] if len(x) else []

    w = Window.partitionBy("seq").orderBy("fidx")
    c = K.per_frame(frames(spark, sf_dir), run, "cx double, cy double", ("seq", "fidx")).withColumns({k: F.col(k).cast("int") for k in ("seq", "fidx")})
    n = c.withColumns({f"n{k}": F.coalesce(F.lead(f"c{k}").over(w), F.first(f"c{k}").over(w)) for k in "xy"})
    step = F.sqrt((F.col("nx") - F.col("cx")) * (F.col("nx") - F.col("cx")) + (F.col("ny") - F.col("cy")) * (F.col("ny") - F.col("cy")))
    return n.select("image_id", "seq", "fidx", F.round(step, 6).alias("step"), F.when(F.col("cx") < 3.2, "left").when(F.col("cx") > 3.8, "right").otherwise("center").alias("side"))


@query("seq_angle_span", """WITH v AS (SELECT user_id, (event_id * 37 % 180)::DOUBLE AS v FROM events), n AS (SELECT user_id, v, lead(v) OVER (PARTITION BY user_id ORDER BY v) AS nx, min(v) OVER (PARTITION BY user_id) AS lo, count(*) OVER (PARTITION BY user_id) AS n FROM v)
SELECT user_id, CASE WHEN max(n) < 2 THEN 0.0::DOUBLE ELSE 180.0::DOUBLE - max(coalesce(nx - v, 180.0::DOUBLE - v + lo)) END AS span FROM n GROUP BY user_id""")
def q_angles(spark, sf_dir: str) -> DataFrame:
    """Row 130: 180 less the widest gap between directions, around the half circle."""
    v = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", (F.col("event_id") * 37 % 180).cast("double").alias("v"))
    n = v.withColumn("next", F.lead("v").over(Window.partitionBy("user_id").orderBy("v")))
    g = n.groupBy("user_id").agg(F.max(F.col("next") - F.col("v")).alias("gap"), F.min("v").alias("low"), F.max("v").alias("high"), F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.when(F.col("n") < 2, 0.0).otherwise(180.0 - F.greatest(F.coalesce("gap", F.lit(0.0)), 180.0 - F.col("high") + F.col("low"))).alias("span"))


@query("seq_alignment", f"""WITH {PX}, b AS (SELECT seq, fidx, max(y) FILTER (a > 16) AS bottom, min(x) FILTER (a > 16) AS lft FROM px GROUP BY seq, fidx), f AS (SELECT *, first_value(bottom) OVER (PARTITION BY seq ORDER BY fidx) AS base FROM b)
SELECT seq, max(abs(bottom - base))::INT AS drift, (max(lft) - min(lft))::INT AS root_range, max(abs(bottom - base)) <= 4 AS grounded FROM f GROUP BY seq""")
def q_alignment(spark, sf_dir: str) -> DataFrame:
    """Rows 145, 153: how far frames leave the first one's baseline, and how far the left edge wanders."""

    def run(p: np.ndarray) -> list[dict]:
        x0, _, _, y1 = bounds(p[..., 3] > 16)
        return [{"bottom": None if y1 is None else y1 - 1, "left": x0}]

    b = K.per_frame(frames(spark, sf_dir), run, "bottom int, left int", ("seq", "fidx")).withColumn("seq", F.col("seq").cast("int"))
    f = b.withColumn("base", F.first("bottom").over(Window.partitionBy("seq").orderBy("fidx")))
    drift = F.max(F.abs(F.col("bottom") - F.col("base")))
    return f.groupBy("seq").agg(drift.alias("drift"), (F.max("left") - F.min("left")).alias("root_range"), (drift <= 4).alias("grounded"))


#: metric, least, greatest, widest spread
IDENTITY = [("opaque", 0.58, 1.55, 0.42), ("height", 0.62, 1.55, 0.42), ("width", 0.68, 1.65, 0.60)]


@query("seq_identity", f"""WITH {PX}, {METRICS_SQL}, mm AS (SELECT bx.seq, alpha_area, height, width FROM metrics JOIN bx USING (image_id)), md AS (SELECT seq, median(alpha_area) AS a, median(height) AS h, median(width) AS w FROM mm GROUP BY seq),
u AS (SELECT seq, 'opaque' AS metric, alpha_area / a AS v FROM mm JOIN md USING (seq) WHERE a > 0 UNION ALL SELECT seq, 'height', height / h FROM mm JOIN md USING (seq) WHERE h > 0 UNION ALL SELECT seq, 'width', width / w FROM mm JOIN md USING (seq) WHERE w > 0),
t(metric, low, high, spread) AS (VALUES ('opaque', 0.58, 1.55, 0.42), ('height', 0.62, 1.55, 0.42), ('width', 0.68, 1.65, 0.60))
SELECT seq, metric, min(v) AS least, median(v) AS middle, max(v) AS most, min(v) < any_value(low) AS too_low, max(v) > any_value(high) AS too_high, max(v) - min(v) > any_value(spread) AS too_wide FROM u JOIN t USING (metric) GROUP BY seq, metric""")
def q_identity(spark, sf_dir: str) -> DataFrame:
    """Rows 146, 151, 152: proxies of identity against the sequence's median, under a table of limits."""
    px = frames(spark, sf_dir)
    m = bbox_metrics(frames(spark, sf_dir), ("seq",)).withColumn("seq", F.col("seq").cast("int")).selectExpr("seq", "stack(3, 'opaque', alpha_area, 'height', height, 'width', width) as (metric, v)")
    middle = m.groupBy("seq", "metric").agg(F.median("v").alias("reference")).where("reference > 0")
    limits = F.create_map(*[x for n, *v in IDENTITY for x in (F.lit(n), F.array(*map(F.lit, v)))])[F.col("metric")]
    g = m.join(middle, ["seq", "metric"]).withColumn("v", F.col("v") / F.col("reference")).groupBy("seq", "metric").agg(F.min("v").alias("least"), F.median("v").alias("middle"), F.max("v").alias("most"))
    return g.select("seq", "metric", "least", "middle", "most", (F.col("least") < limits[0]).alias("too_low"), (F.col("most") > limits[1]).alias("too_high"), (F.col("most") - F.col("least") > limits[2]).alias("too_wide"))


@query("seq_outliers", f"""WITH {PX}, o AS (SELECT image_id, seq, count(*) FILTER (a > 0)::BIGINT AS area FROM px GROUP BY image_id, seq), m AS (SELECT *, median(area) OVER (PARTITION BY seq) AS mid FROM o) SELECT image_id, seq, area, area < 0.35 * mid OR area > 2.75 * mid AS outlier FROM m""")
def q_outliers(spark, sf_dir: str) -> DataFrame:
    """Row 151."""
    o = frames(spark, sf_dir).select("image_id", "seq", F.size(F.filter("a", lambda v: v > 0)).cast("long").alias("area"))
    mid = F.median("area").over(Window.partitionBy("seq"))
    return o.withColumn("m", mid).select("image_id", "seq", "area", ((F.col("area") < 0.35 * F.col("m")) | (F.col("area") > 2.75 * F.col("m"))).alias("outlier"))


@query("seq_contract_gate", f"""WITH {PX}, {DIFFS}, s AS (SELECT seq, round(avg(lower_diff), 9) AS m, min(lower_diff) AS l FROM diffs GROUP BY seq), e AS (SELECT unnest(range(0, 12))::INT AS seq),
r AS (SELECT e.seq, s.seq IS NULL AS missing, coalesce(m < 0.10 OR l < 0.04, false) AS bad FROM e LEFT JOIN s ON s.seq = e.seq)
SELECT count(*) FILTER (NOT missing)::BIGINT AS checked, count(*) FILTER (missing)::BIGINT AS missing, count(*) FILTER (bad)::BIGINT AS failed, CASE WHEN count(*) FILTER (NOT missing) = 0 OR count(*) FILTER (missing OR bad) > 0 THEN 'fail' ELSE 'pass' END AS status FROM r""")
def q_gate(spark, sf_dir: str) -> DataFrame:
    """Rows 143, 144: all expected sequences have to be there and pass; nothing checked is a failure too."""
    s = q_variation(spark, sf_dir)
    expected = spark.range(12).select(F.col("id").cast("int").alias("seq"))
    r = expected.join(s, "seq", "left")
    missing, bad = F.col("verdict").isNull(), F.coalesce(F.col("verdict") != "ok", F.lit(False))
    return r.agg(F.count_if(~missing).alias("checked"), F.count_if(missing).alias("missing"), F.count_if(bad).alias("failed"), F.when((F.count_if(~missing) == 0) | (F.count_if(missing | bad) > 0), "fail").otherwise("pass").alias("status"))


@query("video_uniform_sample", f"""WITH n AS (SELECT label AS seq, count(*)::INT AS total FROM embeddings GROUP BY label), k AS (SELECT unnest(range(8))::INT AS k)
SELECT seq, k, (k * total // 8)::INT AS cyclic, round_even(k * (total - 1) / 7.0::DOUBLE, 0)::INT AS bookended FROM n, k WHERE total >= 8""")
def q_uniform(spark, sf_dir: str, n: int = 8) -> DataFrame:
    """Row 156."""
    total = spark.read.parquet(f"{sf_dir}/embeddings.parquet").groupBy(F.col("label").alias("seq")).agg(F.count(F.lit(1)).cast("int").alias("total")).where(f"total >= {n}")
    return total.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select("seq", "k", F.expr(f"cast(k * total div {n} as int)").alias("cyclic"), F.rint(F.col("k") * (F.col("total") - 1) / (n - 1)).cast("int").alias("bookended"))


@query("video_fallback_candidates", """WITH b AS (SELECT label AS seq, count(*)::INT AS n FROM embeddings GROUP BY label), s AS (SELECT seq, n, [round_even(k * (n - 1) / 3.0::DOUBLE, 0)::INT FOR k IN range(4)] AS base FROM b),
v AS (SELECT seq, n, base, 0 AS ord, base AS c FROM s UNION ALL SELECT seq, n, base, slot * 2 + (CASE WHEN d > 0 THEN 1 ELSE 0 END) + 1 AS ord, [CASE WHEN i = slot + 1 THEN base[i] + d ELSE base[i] END FOR i IN range(1, 5)] AS c FROM s, (VALUES (1), (2)) p(slot), (VALUES (-1), (1)) q(d))
SELECT seq, ord, array_to_string(c, ',') AS frames FROM v WHERE list_unique(c) = 4""")
def q_fallback(spark, sf_dir: str) -> DataFrame:
    """Row 158: the uniform choice, and each inner slot moved by one either way, if places stay unique."""
    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").groupBy(F.col("label").alias("seq")).agg(F.count(F.lit(1)).cast("int").alias("n"))
    base = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.rint(k * (F.col("n") - 1) / 3).cast("int"))
    moves = F.array(F.struct(F.lit(0).alias("ord"), F.lit(-1).alias("slot"), F.lit(0).alias("d")), *[F.struct(F.lit(s * 2 + (d > 0) + 1).alias("ord"), F.lit(s).alias("slot"), F.lit(d).alias("d")) for s in (1, 2) for d in (-1, 1)])
    v = n.withColumn("base", base).withColumn("m", F.explode(moves)).withColumn("c", F.expr("transform(base, (x, i) -> if(i = m.slot, x + m.d, x))"))
    return v.where(F.size(F.array_distinct("c")) == 4).select("seq", F.col("m.ord").alias("ord"), F.array_join(F.col("c").cast("array<string>"), ",").alias("frames"))


def signature_distances(frames: DataFrame) -> DataFrame:
    """Row 160: 0.72 of the silhouette difference and 0.28 of the mean colour difference to the next frame."""
    w = Window.partitionBy("seq").orderBy("fidx")
    f = packed(frames).withColumn("q", F.lead("p").over(w)).where("q IS NOT NULL")
    colour = F.aggregate(F.arrays_zip(F.col("p"), F.col("q")), F.lit(0), lambda s, z: s + sum(F.abs(z["p"][c] - z["q"][c]) for c in "rgb"))
    return f.select("seq", "fidx", (0.72 * mask_diff(F.col("p"), F.col("q"), F.lit(0)) + 0.28 * (colour / (3 * F.col("w") * F.col("h")) / 255)).alias("distance"))


@query("video_signature_distance", f"""WITH {PX}, n AS (SELECT image_id, lead(image_id) OVER (PARTITION BY seq ORDER BY fidx) AS nxt, seq, fidx FROM px WHERE i = 0),
d AS (SELECT n.seq, n.fidx, count(*) FILTER ((p.a > 16) <> (q.a > 16)) AS xo, count(*) FILTER (p.a > 16 OR q.a > 16) AS un, sum(abs(p.r - q.r) + abs(p.g - q.g) + abs(p.b - q.b)) AS c FROM n JOIN px p USING (image_id) JOIN px q ON q.image_id = n.nxt AND q.i = p.i GROUP BY n.seq, n.fidx)
SELECT seq, fidx, round(0.72::DOUBLE * coalesce(xo / nullif(un, 0)::DOUBLE, 0) + 0.28::DOUBLE * (c / 192::DOUBLE / 255), 9) AS distance FROM d""")
def q_signature(spark, sf_dir: str) -> DataFrame:
    return signature_distances(frames(spark, sf_dir)).withColumn("distance", F.round("distance", 9))


@query("video_timeline_pages", """WITH n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events) SELECT user_id, (k // 25)::BIGINT AS page, min(k)::BIGINT AS first_index, max(k)::BIGINT AS last_index, count(*)::BIGINT AS n FROM n GROUP BY user_id, k // 25""")
def q_pages(spark, sf_dir: str, page: int = 25) -> DataFrame:
    """Row 169."""
    n = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long"))
    return n.groupBy("user_id", F.expr(f"k div {page}").alias("page")).agg(F.min("k").alias("first_index"), F.max("k").alias("last_index"), F.count(F.lit(1)).alias("n"))


@query("video_locomotion_scale", f"""WITH {PX}, {METRICS_SQL}, m AS (SELECT bx.seq, bx.fidx, height FROM metrics JOIN bx USING (image_id)), f AS (SELECT *, first_value(height) OVER (PARTITION BY seq ORDER BY fidx) AS h0 FROM m)
SELECT seq, min(height / h0) AS least, max(height / h0) AS most, min(height / h0) >= 0.78 AND max(height / h0) <= 1.22 AS ok FROM f WHERE h0 > 0 AND fidx > 0 GROUP BY seq""")
def q_scale(spark, sf_dir: str) -> DataFrame:
    """Rows 163, 164: heights against the first frame."""
    m = bbox_metrics(frames(spark, sf_dir), ("seq", "fidx")).withColumn("seq", F.col("seq").cast("int")).withColumn("h0", F.first("height").over(Window.partitionBy("seq").orderBy("fidx")))
    ratio = F.col("height") / F.col("h0")
    return m.where("h0 > 0 AND fidx > 0").groupBy("seq").agg(F.min(ratio).alias("least"), F.max(ratio).alias("most"), ((F.min(ratio) >= 0.78) & (F.max(ratio) <= 1.22)).alias("ok"))
