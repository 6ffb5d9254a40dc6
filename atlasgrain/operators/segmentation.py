"""Segmentation of projections and sheets (survey rows 106 to 123)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.frames import PX, frames
from . import kernels as K
from .frames import PARTS_SQL, components, parts_of

PROFILE = "pf AS (SELECT image_id, x AS p, sum(CASE WHEN a > 16 THEN a ELSE 0 END)::BIGINT AS v FROM px GROUP BY image_id, x)"


def profile(p: np.ndarray, axis: str = "x", threshold: int = 16) -> np.ndarray:
    a = p[..., 3]
    return np.where(a > threshold, a, 0).sum(axis=0 if axis == "x" else 1)


def smooth(values: np.ndarray, window: int) -> np.ndarray:
    """Row 106: centred mean, shorter at the ends; an even window w spans w + 1 places."""
    if window <= 1:
        return values.astype(float)
    half, n = window // 2, len(values)
    low, high = np.maximum(np.arange(n) - half, 0), np.minimum(np.arange(n) + half + 1, n)
    sums = np.concatenate(([0], np.cumsum(values)))
    return (sums[high] - sums[low]) / (high - low)


@query("seg_smooth", f"WITH {PX}, {PROFILE} SELECT image_id, p, avg(v) OVER (PARTITION BY image_id ORDER BY p ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s FROM pf")
def q_smooth(spark, sf_dir: str) -> DataFrame:
    return K.per_frame(frames(spark, sf_dir), lambda p: [{"p": k, "s": float(v)} for k, v in enumerate(smooth(profile(p), 4))], "p int, s double")


def content_runs(values: np.ndarray, eps: float, peak: float, least: int) -> list[tuple[int, int]]:
    """Row 107: maximal half-open runs above eps, of ``least`` places and with a peak."""
    change = np.diff(np.concatenate(([0], (values > eps).astype(np.int8), [0])))
    ends = zip(np.flatnonzero(change == 1).tolist(), np.flatnonzero(change == -1).tolist(), strict=True)
    return [(a, b) for a, b in ends if b - a >= least and values[a:b].max() >= peak]


def without_minor(values: np.ndarray, runs: list[tuple[int, int]], part: float = 0.2) -> list[tuple[int, int]]:
    """Row 108."""
    mass = [values[a:b].sum() for a, b in runs]
    return [r for r, m in zip(runs, mass, strict=True) if len(runs) < 2 or m >= part * max(mass)]


def middle_width(runs: list[tuple[int, int]]) -> int:
    """Row 109: upper median."""
    return sorted(b - a for a, b in runs)[len(runs) // 2] if runs else 0


RUNS = f"""{PROFILE}, isl AS (SELECT *, p - row_number() OVER (PARTITION BY image_id ORDER BY p) AS island FROM pf WHERE v > 60), rn AS (SELECT image_id, min(p) AS start, max(p) + 1 AS stop, max(v) AS peak, sum(v)::BIGINT AS mass FROM isl GROUP BY image_id, island),
runs AS (SELECT image_id, start, stop, mass FROM (SELECT * FROM rn WHERE peak >= 120) QUALIFY mass >= 0.2::DOUBLE * max(mass) OVER (PARTITION BY image_id))"""


def _runs(p: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    values = profile(p)
    return values, without_minor(values, content_runs(values, 60, 120, 1))


@query("seg_runs", f"WITH {PX}, {RUNS} SELECT * FROM runs")
def q_runs(spark, sf_dir: str) -> DataFrame:
    def run(p: np.ndarray) -> list[dict]:
        values, found = _runs(p)
        return [{"start": a, "stop": b, "mass": int(values[a:b].sum())} for a, b in found]

    return K.per_frame(frames(spark, sf_dir), run, "start int, stop int, mass long")


@query("seg_median_width", f"WITH {PX}, {RUNS}, l AS (SELECT image_id, list_sort(list(stop - start)) AS w FROM runs GROUP BY image_id) SELECT image_id, w[len(w) // 2 + 1]::INT AS width, len(w)::BIGINT AS n FROM l")
def q_median(spark, sf_dir: str) -> DataFrame:
    def run(p: np.ndarray) -> list[dict]:
        found = _runs(p)[1]
        return [{"width": middle_width(found), "n": len(found)}] if found else []

    return K.per_frame(frames(spark, sf_dir), run, "width int, n long")


def pose_peaks(values: np.ndarray, first: int, last: int) -> list[int]:
    """Row 110: local maxima inside a run of 45 % or more of its greatest value, kept if no valley between one and any other
    as high exceeds 62 % of it; the run's middle if none is left."""
    v, out = values[first:last], []
    if len(v) > 2 and v.max() > 0:
        high = [k for k in range(1, len(v) - 1) if v[k - 1] <= v[k] > v[k + 1] and v[k] >= 0.45 * v.max()]
        out = [first + k for k in high if all(v[min(j, k) : max(j, k) + 1].min() <= 0.62 * v[k] for j in high if j != k and v[j] >= v[k])]
    return out or [(first + last) // 2]


@query("seg_peaks", f"""WITH {PX}, {RUNS}, t AS (SELECT r.image_id, r.start, r.stop, max(v) AS top FROM runs r JOIN pf ON pf.image_id = r.image_id AND p >= r.start AND p < r.stop GROUP BY ALL),
c AS (SELECT t.image_id, t.start, t.stop, m.p, m.v FROM t JOIN pf m ON m.image_id = t.image_id AND m.p > t.start AND m.p < t.stop - 1 JOIN pf l ON l.image_id = m.image_id AND l.p = m.p - 1 JOIN pf n ON n.image_id = m.image_id AND n.p = m.p + 1
  WHERE m.v >= l.v AND m.v > n.v AND m.v >= 0.45::DOUBLE * top),
k AS (SELECT image_id, start, p FROM c WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.image_id = c.image_id AND o.start = c.start AND o.p <> c.p AND o.v >= c.v AND (SELECT min(v) FROM pf WHERE pf.image_id = c.image_id AND pf.p BETWEEN least(c.p, o.p) AND greatest(c.p, o.p)) > 0.62::DOUBLE * c.v))
SELECT * FROM k UNION ALL SELECT image_id, start, ((start + stop) // 2)::INT AS p FROM runs WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.image_id = runs.image_id AND k.start = runs.start)""")
def q_peaks(spark, sf_dir: str) -> DataFrame:
    def run(p: np.ndarray) -> list[dict]:
        values, found = _runs(p)
        return [{"start": a, "p": k} for a, b in found for k in pose_peaks(values, a, b)]

    return K.per_frame(frames(spark, sf_dir), run, "start int, p int")


@query("seg_cuts", f"""WITH {PX}, {PROFILE}, o AS (SELECT a.image_id, a.p AS x1, b.p AS x2, (a.v + 0.0015::DOUBLE * (a.p - 8 / 3.0::DOUBLE) * (a.p - 8 / 3.0::DOUBLE)) + b.v + 0.0015::DOUBLE * (b.p - a.p - 8 / 3.0::DOUBLE) * (b.p - a.p - 8 / 3.0::DOUBLE) AS inner_ FROM pf a JOIN pf b ON a.image_id = b.image_id AND a.p >= 2 AND b.p >= a.p + 2 AND b.p <= 6)
SELECT image_id, x1 || ',' || x2 AS cuts FROM o QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY inner_ + 0.0015::DOUBLE * (8 - x2 - 8 / 3.0::DOUBLE) * (8 - x2 - 8 / 3.0::DOUBLE), x2, inner_, x1) = 1""")
def q_cuts(spark, sf_dir: str, parts: int = 3) -> DataFrame:
    """Row 111: the best cuts of a projection into parts, by dynamic programming over one frame's profile."""

    def run(p: np.ndarray) -> list[dict]:
        values = profile(p)
        return [{"cuts": ",".join(map(str, K.cheapest_cuts(values, 0, len(values), parts)))}]

    return K.per_frame(frames(spark, sf_dir), run, "cuts string")


def split(values: np.ndarray, first: int, last: int, parts: int) -> list[tuple[int, int]]:
    """A range in parts: at the cheapest cuts, else evenly (halves to even)."""
    cuts = K.cheapest_cuts(values, first, last, parts) or [int(np.rint(first + (last - first) * k / parts)) for k in range(1, parts)]
    return [(a, b) for a, b in zip([first, *cuts], [*cuts, last], strict=True) if b > a]


def projection_spans(p: np.ndarray, expected: int, axis: str = "x") -> tuple[list[tuple[int, int]], dict]:
    """Row 112: the spans of a strip, with their natural number, whether cuts had to be forced, and what went wrong."""
    size = p.shape[1 if axis == "x" else 0]
    nothing = lambda why: ([], {"ok": False, "natural": 0, "forced": False, "warning": why})
    if expected < 1 or not size:
        return nothing("expected" if expected < 1 else "empty")
    values = smooth(profile(p, axis), max(3, size // 220))
    top = values.max()
    if top <= 0:
        return nothing("no content")
    runs = without_minor(values, content_runs(values, 0.045 * top, 0.18 * top, max(4, size // 100)))
    if not runs:
        return nothing("no usable run")
    usual, spans = middle_width(runs), []
    for a, b in runs:
        n = len(pose_peaks(values, a, b))
        if len(runs) > 1 and usual:
            n = min(n, max(1, int((b - a) / usual + 0.5)))
            n = 2 if n == 1 and b - a > 1.45 * usual else n
        spans += split(values, a, b, n) if n > 1 else [(a, b)]
    natural = len(spans)
    forced = natural != expected and sum(b - a for a, b in runs) >= 16 * expected and size >= 16 * expected
    if forced:
        spans = split(values, runs[0][0], runs[-1][1], expected)
    return spans, {"ok": len(spans) == expected, "natural": natural, "forced": forced, "warning": "count" if natural != expected else ""}


def sheets(packed: DataFrame, columns: int = 4) -> DataFrame:
    """Row 99: the frames of a sequence on one sheet, row by row; image_id is the sequence.

    A sequence is gathered by its own row count; the sheet is what bounds a task. Frames of another size than the first
    are refused.
    """

    def lay(table: pa.Table) -> pa.Table:
        order = np.argsort(table["fidx"].to_numpy(), kind="stable")
        w, h = table["w"][0].as_py(), table["h"][0].as_py()
        if set(table["w"].to_pylist()) != {w} or set(table["h"].to_pylist()) != {h}:
            raise ValueError("frames of one sheet differ in size")
        rows = -(-len(order) // columns)
        out = {"image_id": table["seq"][:1].cast(pa.int64()), "seq": table["seq"][:1].cast(pa.int64()), "fidx": pa.array([0], pa.int32()), "w": pa.array([columns * w], pa.int32()), "h": pa.array([rows * h], pa.int32())}
        for c in "rgba":
            sheet = np.zeros((rows * h, columns * w), dtype=np.int32)
            cells = table[c].to_pylist()
            for k, j in enumerate(order.tolist()):
                y, x = divmod(k, columns)
                sheet[y * h : (y + 1) * h, x * w : (x + 1) * w] = np.array(cells[j]).reshape(h, w)
            out[c] = pa.array([sheet.ravel().tolist()], pa.list_(pa.int32()))
        return pa.table(out)

    return packed.groupBy("seq").applyInArrow(lay, "image_id long, seq long, fidx int, w int, h int, r array<int>, g array<int>, b array<int>, a array<int>")


_SPANS = "natural int, forced boolean, ok boolean, warning string, spans string"


@query("seg_spans")
def q_spans(spark, sf_dir: str, expected: int = 4) -> DataFrame:
    """Row 112 on the sheet of each sequence; tests hold it against fixtures by hand."""

    def run(p: np.ndarray) -> list[dict]:
        spans, report = projection_spans(p, expected)
        return [report | {"spans": ",".join(f"{a}-{b}" for a, b in spans)}]

    return K.per_frame(sheets(frames(spark, sf_dir)), run, _SPANS)


def grid_projection(p: np.ndarray, columns: int, rows: int) -> list[dict]:
    """Row 113: each band of a sheet is cut by its own projection; a band with another number of spans has none."""
    edges = [int(np.rint(k * p.shape[0] / rows)) for k in range(rows + 1)]
    out = []
    for k in range(rows):
        spans, report = projection_spans(p[edges[k] : edges[k + 1]], columns)
        wrong = len(spans) != columns
        out.append({"band": k, "top": edges[k], "bottom": edges[k + 1], "natural": report["natural"], "warning": "spans" if wrong else report["warning"], "spans": "" if wrong else ",".join(f"{a}-{b}" for a, b in spans)})
    return out


@query("seg_grid_projection")
def q_grid_projection(spark, sf_dir: str, columns: int = 4, rows: int = 3) -> DataFrame:
    return K.per_frame(sheets(frames(spark, sf_dir)), lambda p: grid_projection(p, columns, rows), "band int, top int, bottom int, natural int, warning string, spans string")


def rows_of_boxes(boxes: list[tuple[int, int, int, int]]) -> list[list[tuple[int, int, int, int]]]:
    """Row 120: boxes in rows by their vertical centre against the row's running mean, and in each row those merged whose
    horizontal gap is at most 0.3 of the usual width."""
    if not boxes:
        return []
    tall, wide = (sorted(b[k + 2] - b[k] for b in boxes)[len(boxes) // 2] for k in (1, 0))
    rows: list[list[tuple[int, int, int, int]]] = []
    for box in sorted(boxes, key=lambda b: (b[1] + b[3]) / 2):
        if rows and abs((box[1] + box[3]) / 2 - sum(b[1] + b[3] for b in rows[-1]) / 2 / len(rows[-1])) <= 0.6 * tall:
            rows[-1].append(box)
        else:
            rows.append([box])
    out = []
    for row in rows:
        merged: list[tuple[int, int, int, int]] = []
        for box in sorted(row, key=lambda b: b[0]):
            if merged and box[0] - merged[-1][2] <= 0.3 * wide:
                last = merged.pop()
                box = (min(last[0], box[0]), min(last[1], box[1]), max(last[2], box[2]), max(last[3], box[3]))
            merged.append(box)
        out.append(merged)
    return out


def auto_layout(p: np.ndarray) -> list[list[tuple[int, int, int, int]]]:
    """Row 120 for sheets of up to 600 pixels a side; larger ones are read at every ``longest side // 600`` pixel."""
    step = max(1, max(p.shape[:2]) // 600)
    small = p[step // 2 :: step, step // 2 :: step]
    least = max(6, small.shape[0] * small.shape[1] // 4000)
    return rows_of_boxes([tuple(step * q[k] for k in ("x0", "y0", "x1", "y1")) for q in parts_of(small) if q["area"] >= least])


@query("seg_auto_layout")
def q_auto(spark, sf_dir: str) -> DataFrame:
    """Row 120 on the sheet of each sequence; sequential, so tests hold it against fixtures by hand."""

    def run(p: np.ndarray) -> list[dict]:
        return [{"row": k, "ord": j, "x0": b[0], "y0": b[1], "x1": b[2], "y1": b[3]} for k, row in enumerate(auto_layout(p)) for j, b in enumerate(row)]

    return K.per_frame(sheets(frames(spark, sf_dir)), run, "row int, ord int, x0 int, y0 int, x1 int, y1 int")


@query("seg_nearest_seed", f"""WITH RECURSIVE {PX}, {PARTS_SQL}, s AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY area DESC, ord) AS k FROM parts), d AS (SELECT p.image_id, p.ord, p.area, q.ord AS seed, (p.x0 + p.x1 - q.x0 - q.x1) ** 2 + (p.y0 + p.y1 - q.y0 - q.y1) ** 2 AS d FROM s p JOIN s q ON p.image_id = q.image_id AND q.k <= 2)
SELECT image_id, seed, sum(area)::BIGINT AS area, count(*)::BIGINT AS parts FROM (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY image_id, ord ORDER BY d, seed) = 1) GROUP BY image_id, seed""")
def q_seeds(spark, sf_dir: str) -> DataFrame:
    """Rows 117, 118: the two largest parts are seeds; each part joins the seed with the nearest centre."""
    parts = components(frames(spark, sf_dir))
    w = Window.partitionBy("image_id").orderBy(F.desc("area"), "ord")
    ranked = parts.withColumn("k", F.row_number().over(w)).withColumns({"cx": F.expr("x0 + x1"), "cy": F.expr("y0 + y1")})
    seeds = ranked.where("k <= 2").groupBy("image_id").agg(F.collect_list(F.struct(F.col("ord").alias("seed"), "cx", "cy")).alias("seeds"))
    near = F.array_min(F.transform("seeds", lambda s: F.struct(((F.col("cx") - s["cx"]) * (F.col("cx") - s["cx"]) + (F.col("cy") - s["cy"]) * (F.col("cy") - s["cy"])).alias("d"), s["seed"].alias("seed"))))["seed"]
    return ranked.join(seeds, "image_id").groupBy("image_id", near.alias("seed")).agg(F.sum("area").alias("area"), F.count(F.lit(1)).alias("parts"))


@query("seg_warnings", """WITH n AS (SELECT label AS state, count(*)::BIGINT AS frames FROM embeddings GROUP BY label), e AS (SELECT unnest(range(0, 12))::INT AS state) SELECT e.state, coalesce(frames, 0)::BIGINT AS frames, frames IS NULL AS missing, coalesce(frames > 1.2::DOUBLE * (SELECT min(frames) FROM n), false) AS uneven FROM e LEFT JOIN n ON n.state = e.state""")
def q_warnings(spark, sf_dir: str) -> DataFrame:
    """Row 121: states expected and not found, and rows that are uneven."""
    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").groupBy(F.col("label").alias("state")).agg(F.count(F.lit(1)).alias("frames"))
    least = n.agg(F.min("frames").alias("least"))
    expected = spark.range(12).select(F.col("id").cast("int").alias("state"))
    r = expected.join(n, "state", "left").crossJoin(least)  # one row
    return r.select("state", F.coalesce("frames", F.lit(0)).cast("long").alias("frames"), F.col("frames").isNull().alias("missing"), F.coalesce(F.col("frames") > 1.2 * F.col("least"), F.lit(False)).alias("uneven"))


@query("seg_exact_copies", f"""WITH {PX}, k AS (SELECT image_id, sha256(string_agg((a // 64)::VARCHAR, ',' ORDER BY i)) AS sha FROM px GROUP BY image_id) SELECT sha, count(*)::BIGINT AS n, min(image_id) AS first_id FROM k GROUP BY sha HAVING count(*) > 1""")
def q_copies(spark, sf_dir: str) -> DataFrame:
    """Rows 119, 122: frames that are equal after quantising alpha, by digest."""
    quantised = F.expr("transform(a, v -> cast(v div 64 as string))")
    k = frames(spark, sf_dir).select("image_id", F.sha2(F.array_join(quantised, ","), 256).alias("sha"))
    return k.groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.min("image_id").alias("first_id")).where("n > 1")
