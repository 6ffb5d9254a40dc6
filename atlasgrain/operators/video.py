"""Video frames and sampling (survey rows 157, 159, 161, 162, 165, 166, 171): signatures, pose choices and loop bounds."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.frames import frames
from . import kernels as K
from .transforms import resampling


@dataclass(slots=True)
class Signature:
    """Row 159: what sampling needs to know of a frame. Its measures can stand without the picture."""

    rgb: np.ndarray | None
    mask: np.ndarray | None
    area: float
    center_x: float
    center_y: float
    sharpness: float
    border: float
    width: float
    height: float
    core_height: float


MEASURES = ("area", "center_x", "center_y", "sharpness", "border", "width", "height", "core_height")


def picture(p: np.ndarray, side: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """A frame at ``side`` x ``side`` (linear) in whole levels, and its foreground: what differs from the mean of the corners
    by 36 levels or more over the channels. A picture's own picture is the same."""
    level = lambda x: np.floor(x + 0.5).clip(0, 255)
    x = level(np.einsum("nw,hwc->hnc", resampling(p.shape[1], side, "bilinear"), p[..., :3].astype(float)))
    x = level(np.einsum("mh,hnc->mnc", resampling(p.shape[0], side, "bilinear"), x))
    corners = x[[0, 0, -1, -1], [0, -1, 0, -1]].sum(axis=0) / 4
    return x, np.abs(x - corners).sum(axis=2) >= 36


def signature(p: np.ndarray, side: int = 64) -> Signature:
    """A frame's picture; its foreground's centre, bounds, height in the middle columns, sharpness and share of the border."""
    x, mask = picture(p, side)
    v, u = np.nonzero(mask)
    core = v[(u >= round(side * 0.31)) & (u <= round(side * 0.69))]
    luma = np.rint(x @ np.array([0.299, 0.587, 0.114]))
    inner = mask[:-1, :-1]
    edges = (np.abs(luma[:-1, :-1] - luma[:-1, 1:]) + np.abs(luma[:-1, :-1] - luma[1:, :-1]))[inner].sum()
    rim = np.concatenate([mask[0], mask[-1], mask[1:-1, 0], mask[1:-1, -1]])
    extent = lambda q: (int(q.max()) - int(q.min()) + 1) / side if len(q) else 0.0
    middle = lambda q: float(q.mean()) / max(1, side - 1) if len(q) else 0.5
    return Signature(x, mask, len(u) / side**2, middle(u), middle(v), float(edges) / (2 * int(inner.sum())) / 255 if inner.any() else 0.0, float(rim.mean()), extent(u), extent(v), extent(core))


def difference(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Row 160 on pictures."""
    (x, on), (y, off) = a, b
    either = int((on | off).sum())
    return 0.72 * (int((on ^ off).sum()) / either if either else 0.0) + 0.28 * float(np.abs(x - y).sum()) / (x.size * 255)


def distance(a: Signature, b: Signature) -> float:
    """Row 160 on signatures."""
    return difference((a.rgb, a.mask), (b.rgb, b.mask))


class Poses:
    """Scores of the frames of one video against its first frame. With ``anchor``, the distances to that frame, and ``look``,
    which shows the picture of a frame, signatures may be without pictures."""

    def __init__(self, signatures: list[Signature], steady_scale: bool = False, anchor: list[float] | None = None, look: Callable[[int], tuple[np.ndarray, np.ndarray]] | None = None) -> None:
        self.n, first = len(signatures), signatures[0]
        self.look = look or (lambda k: (signatures[k].rgb, signatures[k].mask))
        self.anchor = [distance(first, x) for x in signatures] if anchor is None else anchor
        sharpest = max(x.sharpness for x in signatures) or 1.0
        ratio = [x.height / first.height if first.height > 0 else 1.0 for x in signatures]
        self.off_scale = [k for k, r in enumerate(ratio) if steady_scale and not 0.78 <= r <= 1.22]
        # frames that the video clips, or that change size, stay choosable but rank last
        self.malus = [2.0 * (x.border > 0) + ((2.0 * (r < 0.78 or r > 1.22) + 1.2 * abs(r - 1)) if steady_scale else 0.0) for x, r in zip(signatures, ratio, strict=True)]
        self.calm = [max(0.0, 1 - 1.4 * abs(x.area - first.area) - 0.8 * (abs(x.center_x - first.center_x) + abs(x.center_y - first.center_y)) - 0.35 * max(0.0, 0.65 - x.sharpness / sharpest) - (0.9 * abs(r - 1) if steady_scale else 0.0)) for x, r in zip(signatures, ratio, strict=True)]

    def apart(self, asked: list[tuple[int, range]]) -> list[list[float]]:
        """The distances of a frame to a range of frames, for each of those asked; a frame of the ranges is looked at once."""
        out: list[list[float]] = [[] for _ in asked]
        known = {a: self.look(a) for a, _ in asked if a}
        for k in range(min((r.start for _, r in asked), default=0), max((r.stop for _, r in asked), default=0)):
            here, seen = {0: self.anchor[k]}, None
            for (a, r), far in zip(asked, out, strict=True):
                if k in r:
                    if a not in here:
                        seen = seen or self.look(k)
                        here[a] = difference(known[a], seen)
                    far.append(here[a])
        return out


#: shift of the slots (in windows), weight of novelty, weight of the distance to the first frame
VARIANTS = [(-0.3, 0.52, 0.3), (-0.2, 0.46, 0.36), (-0.1, 0.4, 0.42), (0.0, 0.34, 0.48), (0.1, 0.3, 0.52), (0.2, 0.42, 0.4), (0.3, 0.5, 0.32), (0.0, 0.6, 0.24)]


def slot_choices(v: Poses, wanted: int, cyclic: bool = True) -> list[tuple[float, list[int]]]:
    """Row 161: for each variant the best frame near each slot after the one before it; the first of equals."""
    window, paths = max(2, v.n // max(4, 2 * wanted)), {variant: (0.0, [0]) for variant in VARIANTS}
    for slot in range(1, wanted):
        near = {}
        for (shift, novelty, anchor), (_, chosen) in paths.items():
            target = slot * (v.n if cyclic else v.n - 1) / (wanted if cyclic else wanted - 1) + shift * window
            low, high = max(chosen[-1] + 1, round(target - window)), min(v.n - 1, round(target + window), v.n - (wanted - slot))
            if low <= high:
                near[shift, novelty, anchor] = target, range(low, high + 1)
        far = v.apart([(paths[x][1][-1], places) for x, (_, places) in near.items()])
        for (x, (target, places)), apart in zip(near.items(), far, strict=True):
            marks = [x[1] * d + x[2] * v.anchor[k] + 0.12 * v.calm[k] + 0.08 * (1 - min(1.0, abs(k - target) / window)) - v.malus[k] for k, d in zip(places, apart, strict=True)]
            near[x] = paths[x][0] + max(marks), [*paths[x][1], places[marks.index(max(marks))]]
        paths = near
    return list(paths.values())


def distant_best(places: range, mark, gap: int, most: int = 4) -> list[int]:
    """The best places that keep a gap from better ones; the first of equals."""
    out: list[int] = []
    for k in sorted(places, key=mark, reverse=True):
        if len(out) < most and all(abs(k - j) >= gap for j in out):
            out.append(k)
    return out


def phase_choices(v: Poses) -> list[tuple[float, list[int]]]:
    """Row 162: four frames as start, one extreme, a recovery near the start pose, and the other extreme."""
    rim, half, gap, between, out = max(2, v.n // 24), v.n // 2, max(2, v.n // 12), max(2, v.n // 18), []
    firm = lambda k: 0.75 + 0.25 * v.calm[k]
    last = min(v.n - rim - gap, 3 * v.n // 4)
    starts = [a for a in distant_best(range(rim, max(rim + 1, half - rim)), lambda k: v.anchor[k] * firm(k) - v.malus[k], between) if last > a + gap]
    ends = [range(a + 2 * gap, v.n - rim) for a in starts]
    for a, places, apart in zip(starts, ends, v.apart(list(zip(starts, ends, strict=True))), strict=True):
        far = lambda k: apart[k - places.start]  # noqa: B023, E731
        for r in distant_best(range(a + gap, last + 1), lambda k: -v.malus[k] - v.anchor[k] - 0.08 * abs(k - half) / v.n + 0.1 * v.calm[k], between):
            for b in distant_best(range(r + gap, v.n - rim), lambda k: (0.48 * v.anchor[k] + 0.52 * far(k)) * firm(k) - v.malus[k], between):  # noqa: B023
                mark = v.anchor[a] + v.anchor[b] + 1.4 * far(b) + 0.25 * (v.calm[a] + v.calm[b]) - 0.4 * v.anchor[r] - v.malus[a] - v.malus[r] - v.malus[b]
                out.append((mark, [0, a, r, b]))
    return out


def ranked(v: Poses, wanted: int, cyclic: bool = True, most: int = 8) -> list[tuple[float, list[int]]]:
    """The choices, best first, each once."""
    out: list[tuple[float, list[int]]] = []
    for mark, chosen in sorted(phase_choices(v) if wanted == 4 else slot_choices(v, wanted, cyclic), reverse=True):
        if len(out) < most and all(chosen != c for _, c in out):
            out.append((mark, chosen))
    return out


def adaptive_sample(signatures: list[Signature], wanted: int, cyclic: bool = True, steady_scale: bool = False, most: int = 8) -> list[tuple[float, list[int]]]:
    """Rows 161, 162: the ranked choices, best first, each once. Videos of under max(8, 3 x wanted) frames are refused."""
    if len(signatures) < max(8, 3 * wanted):
        raise ValueError("too few frames")
    return ranked(Poses(signatures, steady_scale), wanted, cyclic, most)


class Video(Sequence):
    """The frames of one sequence as h x w x channels arrays, each made when it is asked for: flat channel arrays (values and
    offsets) and sizes stay packed."""

    def __init__(self, w: np.ndarray, h: np.ndarray, channels: list[tuple[np.ndarray, np.ndarray]], order: np.ndarray) -> None:
        self.w, self.h, self.channels, self.order = w, h, channels, order

    def __len__(self) -> int:
        return len(self.order)

    def __getitem__(self, at):
        if isinstance(at, slice):
            return Video(self.w, self.h, self.channels, self.order[at])
        k = self.order[at]
        return np.stack([v[o[k] : o[k + 1]] for v, o in self.channels], axis=1).reshape(self.h[k], self.w[k], -1).astype(np.int64)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()


def per_sequence(packed: DataFrame, f, schema: str) -> DataFrame:
    """Rows of ``f(sequence of h x w x 4 arrays)`` for each sequence, in order of fidx; seq is added in front. A sequence bounds
    the group, as a video does (some hundred frames); it stays packed, two bytes a value, and ``f`` should keep no frames."""
    own = [c.rsplit(" ", 1) for c in schema.split(", ")]

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table["fidx"].to_numpy(), kind="stable")
        rows = f(Video(table["w"].to_numpy(), table["h"].to_numpy(), [flat(table[c].combine_chunks()) for c in "rgba"], order))
        seq = table["seq"][0].as_py()
        return pa.table({"seq": pa.array([seq] * len(rows), pa.int32())} | {n: pa.array([r[n] for r in rows], K.ARROW[k]) for n, k in own})

    return packed.select(F.col("seq").cast("int"), "fidx", "w", "h", *[F.col(c).cast("array<smallint>") for c in "rgba"]).groupBy("seq").applyInArrow(run, "seq int, " + schema)


def signatures(packed: DataFrame, pictures: bool = False) -> DataFrame:
    """Row 159 of each frame, its place in its sequence (fidx) and its distance to the first frame (anchor). Frames carry the
    first one, so they are dealt over all tasks however long a sequence is, and Python holds one at a time. ``pictures`` adds
    cw, ch and cells: RGB bytes that have the same picture, which are the frame's own or, of a large one, the picture."""
    order = Window.partitionBy("seq").orderBy("fidx")
    own = ["w", "h", "r", "g", "b"]
    narrow = packed.select(F.col("seq").cast("int"), "fidx", *own[:2], *[F.col(c).cast("array<smallint>") for c in own[2:]])
    placed = narrow.select("seq", (F.row_number().over(order) - 1).alias("fidx"), *own, *[F.first(c).over(order).alias(f"first_{c}") for c in own])
    schema = "seq int, fidx int, " + ", ".join(f"{n} double" for n in (*MEASURES, "anchor")) + (", cw int, ch int, cells binary" if pictures else "")
    kinds = [pa.int32()] * 2 + [pa.float64()] * (len(MEASURES) + 1) + ([pa.int32(), pa.int32(), pa.binary()] if pictures else [])
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def video(b: pa.RecordBatch, mark: str = "") -> Video:
        return Video(b[f"{mark}w"].to_numpy(), b[f"{mark}h"].to_numpy(), [flat(b[f"{mark}{c}"]) for c in "rgb"], np.arange(b.num_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            seqs, each, first, columns = b["seq"].to_pylist(), video(b), video(b, "first_"), [[] for _ in kinds[2:]]
            for k, seq in enumerate(seqs):
                if seq not in firsts:
                    if len(firsts) == 64:
                        firsts.clear()
                    firsts[seq] = picture(first[k])
                p = each[k]
                s = signature(p)
                row = [*(getattr(s, n) for n in MEASURES), difference(firsts[seq], (s.rgb, s.mask))]
                if pictures:
                    least = p if p.size <= s.rgb.size else s.rgb
                    row += [least.shape[1], least.shape[0], least.astype(np.uint8).tobytes()]
                for column, v in zip(columns, row, strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([b["seq"], b["fidx"], *(pa.array(c, t) for c, t in zip(columns, kinds[2:], strict=True))], names=names)

    return placed.repartition("seq", "fidx").mapInArrow(run, schema)


@query("video_adaptive_sample")
def q_adaptive(spark, sf_dir: str) -> DataFrame:
    """Rows 161, 162: the ranked choices of six frames and of four; sequential, so tests hold it against a slow version."""
    return adaptive_samples(frames(spark, sf_dir))


def chosen_of(table: pa.Table, choices: tuple[int, ...]) -> pa.Table:
    """The ranked choices of one sequence of ``signatures`` with pictures. Of a frame it holds the measures and the least
    bytes that show its picture, which is made anew where two frames are compared."""
    n, order, rows = table.num_rows, np.argsort(table["fidx"].to_numpy()).tolist(), []
    if n >= max(8, 3 * min(choices)):
        w, h, cells = table["cw"].to_numpy(), table["ch"].to_numpy(), table["cells"]
        look = lambda k: picture(np.frombuffer(cells[(j := order[k])].as_buffer(), np.uint8).reshape(h[j], w[j], 3))
        told = [table[m].to_numpy()[order].tolist() for m in (*MEASURES, "anchor")]
        v = Poses([Signature(None, None, *x) for x in zip(*told[:-1], strict=True)], anchor=told[-1], look=look)
        rows = [(wanted, k + 1, ",".join(map(str, c)), round(m, 6)) for wanted in choices if n >= max(8, 3 * wanted) for k, (m, c) in enumerate(ranked(v, wanted))]
    columns = list(zip(*rows, strict=True)) or [()] * 4
    out = {"seq": pa.array([table["seq"][0].as_py()] * len(rows), pa.int32())}
    return pa.table(out | {c: pa.array(x, K.ARROW[t]) for (c, t), x in zip((("wanted", "int"), ("rank", "int"), ("frames", "string"), ("score", "double")), columns, strict=True)})


def adaptive_samples(packed: DataFrame, choices: tuple[int, ...] = (6, 4)) -> DataFrame:
    """Rows 161, 162 of each sequence. A choice follows from the one before it, so a sequence is one task."""
    return signatures(packed, pictures=True).groupBy("seq").applyInArrow(lambda table: chosen_of(table, choices), "seq int, wanted int, rank int, frames string, score double")


@query("video_signature")
def q_signature(spark, sf_dir: str) -> DataFrame:
    """Row 159, with the distance to the first frame."""
    return signatures(frames(spark, sf_dir))


def boundary(p: np.ndarray, at: int, band: int, length: int) -> np.ndarray:
    """Mean colours of a strip around a place, over ``length`` equal shares of the rows; what lies outside is black."""
    strip = np.zeros((p.shape[0], 2 * band, 3))
    low, high = max(0, at - band), min(p.shape[1], at + band)
    strip[:, low - at + band : high - at + band] = p[:, low:high, :3]
    ends = np.arange(length + 1) * p.shape[0] / length
    sums = np.concatenate([np.zeros((1, 2 * band, 3)), np.cumsum(strip, axis=0)])
    whole = ends.astype(int)
    upto = sums[whole] + (ends - whole)[:, None, None] * strip[np.minimum(whole, p.shape[0] - 1)]
    return np.floor(np.diff(upto, axis=0) * length / p.shape[0] + 0.5)


def repeat_bounds(p: np.ndarray, most_trim: float = 0.16, band: int = 3, length: int = 96, dark: bool = False) -> dict | None:
    """Row 171 across: where to begin and end a texture that repeats. The error of the two boundaries, 0.035 of what is
    trimmed and, where dark ones are liked, 0.04 of their brightness; ties to the smaller start, then end."""
    n = p.shape[1]
    trim, step = max(2, min(round(n * most_trim), n // 3)), max(1, n // 640)
    begins, ends = {k: boundary(p, k, band, length) for k in range(band, trim + 1, step)}, {k: boundary(p, k, band, length) for k in range(n - trim, n - band + 1, step)}
    best = None
    for s, a in begins.items():
        for e, b in ends.items():
            if e - s >= round(n * (1 - 2 * most_trim)):
                error, light = float(np.abs(a - b).sum()) / (a.size * 255), float(a.sum() + b.sum()) / (2 * a.size * 255)
                found = (error + 0.035 * (s + n - e) / n + (0.04 * light if dark else 0.0), s, e, error, light)
                best = min(best or found, found)
    return None if best is None else {"start_frame": best[1], "end_frame": best[2], "score": round(best[0], 6), "error": round(best[3], 6), "light": round(best[4], 6)}


@query("video_repeat_bounds")
def q_repeat(spark, sf_dir: str) -> DataFrame:
    """Row 171 on the sheet of each sequence, along both axes, dark boundaries liked."""
    from .segmentation import sheets

    def run(p: np.ndarray) -> list[dict]:
        return [{"axis": axis} | r for axis, q in (("x", p), ("y", p.swapaxes(0, 1))) if (r := repeat_bounds(q, 0.25, 1, 8, dark=True))]

    return K.per_frame(sheets(frames(spark, sf_dir)), run, "axis string, start_frame int, end_frame int, score double, error double, light double")


_CYCLES = "fighting-stance-idle idle-breath water-loop wind-ambient-loop".split()
_GAITS = "(^|[^a-z])(" + "|".join("crawl fly flying run running sprint swim walk walking".split()) + ")([^a-z]|$)"


def sampling_mode(state: Column, action: Column, workflows: Column, loop: Column) -> Column:
    """Row 165: a loop whose workflow or wording is cyclic is sampled half-open, anything else with both ends."""
    names = F.transform(F.coalesce(workflows, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x)))
    known = F.exists(names, lambda x: x.contains("locomotion") | x.isin(_CYCLES))
    told = F.lower(F.concat_ws(" ", state, F.coalesce(action, F.lit("")), F.array_join(F.array_sort(F.array_distinct(names)), " ")))
    return F.when(F.coalesce(loop, F.lit(True)) & (known | told.rlike(_GAITS)), "cyclic-half-open").otherwise("bookended-inclusive")


def idle_slots(state: Column, workflows: Column, requested: Column, shared_idle: Column) -> Column:
    """Row 166: slots that show the idle frame itself: the first, and of four shared ones the last (attack) or the third."""
    attack = F.lower(state).contains("attack") | F.exists(F.coalesce(workflows, F.array().cast("array<string>")), lambda x: F.lower(x).contains("attack"))
    second = F.when((requested == 4) & F.coalesce(shared_idle, F.lit(False)), F.when(attack, requested - 1).otherwise(2))
    return F.array_compact(F.array(F.lit(0), second.cast("int")))


def sample_error(indices: Column, requested: Column, total: Column) -> Column:
    """Row 157: the first rule that a reviewed choice of frames breaks; null if none."""
    rules = [(F.size(indices) != requested, "length"), ((F.size(indices) == 0) | (F.get(indices, F.lit(0)) != 0), "first"), (F.size(F.array_distinct(indices)) != F.size(indices), "duplicate"), (indices != F.array_sort(indices), "order"), (F.exists(indices, lambda k: (k < 0) | (k >= total)), "range")]
    out = F.lit(None).cast("string")
    for bad, name in reversed(rules):
        out = F.when(bad, name).otherwise(out)
    return out


@query("video_sampling_mode", f"""WITH e AS (SELECT event_id, event_type AS state, ['walk left', 'Running!', 'crosswalk wave', 'idle', 'swim'][(event_id % 5 + 1)::INT] AS action, CASE WHEN event_id % 3 = 0 THEN ['Idle-Breath '] WHEN event_id % 3 = 1 THEN ['hit', 'big locomotion'] ELSE [] END AS w, CASE WHEN event_id % 4 = 0 THEN false WHEN event_id % 4 = 1 THEN NULL ELSE true END AS loop FROM events)
SELECT event_id, CASE WHEN coalesce(loop, true) AND (event_id % 3 IN (0, 1) OR regexp_matches(lower(state || ' ' || action), '{_GAITS}')) THEN 'cyclic-half-open' ELSE 'bookended-inclusive' END AS mode FROM e""")
def q_mode(spark, sf_dir: str) -> DataFrame:
    """Row 165 on contract rows made of the events."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type")
    action = F.expr("array('walk left', 'Running!', 'crosswalk wave', 'idle', 'swim')[cast(event_id % 5 as int)]")
    workflows = F.expr("case event_id % 3 when 0 then array('Idle-Breath ') when 1 then array('hit', 'big locomotion') else cast(array() as array<string>) end")
    loop = F.expr("case event_id % 4 when 0 then false when 1 then cast(null as boolean) else true end")
    return e.select("event_id", sampling_mode(F.col("event_type"), action, workflows, loop).alias("mode"))


@query("video_idle_slots", """SELECT event_id, CASE WHEN event_id % 3 + 3 = 4 AND event_id % 5 < 3 THEN CASE WHEN contains(lower(event_type), 'attack') OR event_id % 7 = 0 THEN '0,3' ELSE '0,2' END ELSE '0' END AS slots FROM events""")
def q_idle(spark, sf_dir: str) -> DataFrame:
    """Row 166."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type")
    workflows = F.expr("if(event_id % 7 = 0, array('Heavy Attack'), cast(null as array<string>))")
    slots = idle_slots(F.col("event_type"), workflows, F.expr("cast(event_id % 3 + 3 as int)"), F.expr("event_id % 5 < 3"))
    return e.select("event_id", F.array_join(slots.cast("array<string>"), ",").alias("slots"))


@query("video_reviewed_sample", """WITH i AS (SELECT l_orderkey, list((l_linenumber - 1) * (1 + l_orderkey % 3) ORDER BY l_linenumber, l_partkey) AS k FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN len(k) <> 4 THEN 'length' WHEN k[1] <> 0 THEN 'first' WHEN len(list_distinct(k)) <> len(k) THEN 'duplicate' WHEN k <> list_sort(k) THEN 'order' WHEN list_max(k) >= 8 OR list_min(k) < 0 THEN 'range' END AS error FROM i""")
def q_reviewed(spark, sf_dir: str) -> DataFrame:
    """Row 157: each order's lines as a reviewed choice of four frames out of eight."""
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey")
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    k = l.groupBy("l_orderkey").agg(rows.alias("rows")).withColumn("k", F.expr("transform(rows, x -> (x.l_linenumber - 1) * (1 + l_orderkey % 3))"))
    return k.select("l_orderkey", sample_error(F.col("k"), F.lit(4), F.lit(8)).alias("error"))
