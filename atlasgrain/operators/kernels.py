"""Kernels over one packed frame at a time, in Arrow batches of frames: no exchange, and a frame bounds the memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOUR = ((0, 1), (1, 0), (0, -1), (-1, 0))
EIGHT = FOUR + ((1, 1), (1, -1), (-1, 1), (-1, -1))


def label(mask: np.ndarray, steps=FOUR) -> np.ndarray:
    """Component numbers from 1 in raster order of their first pixels; 0 outside the mask. Union-find over runs of a row."""
    h, w = mask.shape
    reach = len(steps) // 8
    padded = np.zeros((h, w + 2), dtype=np.int8)
    padded[:, 1:-1] = mask
    change = np.diff(padded, axis=1)
    rows, begins = np.nonzero(change == 1)
    ends = np.nonzero(change == -1)[1]
    first = np.searchsorted(rows, np.arange(h + 1)).tolist()
    b, e = begins.tolist(), ends.tolist()
    root = list(range(len(b)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for y in range(1, h):
        i, j = first[y - 1], first[y]
        while i < first[y] and j < first[y + 1]:
            if b[i] < e[j] + reach and b[j] < e[i] + reach:
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
            if e[i] < e[j]:
                i += 1
            else:
                j += 1
    number = np.unique([find(k) for k in range(len(b))], return_inverse=True)[1].astype(np.int32) + 1
    out = np.zeros((h, w + 1), dtype=np.int32)
    out[rows, begins] = number
    out[rows, ends] -= number
    return np.cumsum(out, axis=1, dtype=np.int32)[:, :w]


def exterior(candidate: np.ndarray) -> np.ndarray:
    """Candidates that reach the border by 4-neighbour steps over candidates."""
    parts = label(candidate)
    edge = np.unique(np.concatenate([parts[0], parts[-1], parts[:, 0], parts[:, -1]]))
    return np.isin(parts, edge[edge > 0])


def dilate(mask: np.ndarray, passes: int = 1) -> np.ndarray:
    for _ in range(passes):
        p = np.pad(mask, 1)
        mask = np.logical_or.reduce([p[1 + dy : p.shape[0] - 1 + dy, 1 + dx : p.shape[1] - 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    return mask


def cheapest_cuts(values, first: int, last: int, parts: int) -> list[int]:
    """Row 111: where to cut [first, last) into ``parts``: least profile at the cuts plus 0.0015 a squared pixel of uneven
    width; no part under 45 % of the even width or two pixels. Empty if that does not fit; ties go to the left."""
    if parts < 2 or last - first < parts:
        return []
    even = (last - first) / parts
    least = max(2, int(0.45 * even))
    places = np.arange(first, last + 1)
    cost = np.where(places == first, 0.0, np.inf)  # of cutting at each place, with k parts to its left
    trail: list[np.ndarray] = []
    for k in range(1, parts):
        lines, after = np.full(len(places), np.inf), np.full(len(places), -1)
        for at in range(k * least, last - first - (parts - k) * least + 1):
            d = at - np.arange(0, at - least + 1) - even
            options = (cost[: at - least + 1] + float(values[min(first + at, len(values) - 1)])) + 0.0015 * d * d
            best = int(np.argmin(options))
            if np.isfinite(options[best]):
                lines[at], after[at] = options[best], best
        cost = lines
        trail.append(after)
    d = (last - first) - np.arange(len(places)) - even
    total = np.where(np.arange(len(places)) <= last - first - least, cost + 0.0015 * d * d, np.inf)
    at = int(np.argmin(total))
    if not np.isfinite(total[at]):
        return []
    cuts = []
    for after in reversed(trail):
        cuts.append(first + at)
        at = int(after[at])
    return cuts[::-1]


ARROW = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}


def per_frame(frames: DataFrame, f: Callable[[np.ndarray], list[dict]], schema: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``f(frame)`` for each packed frame; it gets an h x w x 4 array. image_id and ``carry`` (longs) come first."""
    own = [c.rsplit(" ", 1) for c in schema.split(", ")]
    kinds = [pa.int64()] * (1 + len(carry)) + [ARROW[k] for _, k in own]
    names = ["image_id", *carry, *[n for n, _ in own]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = list(zip(*(b.column(k).to_pylist() for k in range(1 + len(carry))), strict=True))
            sizes = list(zip(b.column("w").to_pylist(), b.column("h").to_pylist(), strict=True))
            flat = [(b.column(c).values.to_numpy(zero_copy_only=False), b.column(c).offsets.to_numpy()) for c in "rgba"]
            rows = []
            for k, (w, h) in enumerate(sizes):
                if w is not None and h is not None and w * h:
                    frame = np.stack([v[o[k] : o[k + 1]] for v, o in flat], axis=1).reshape(h, w, 4).astype(np.int64)
                    rows += [(*keys[k], *(r[n] for n, _ in own)) for r in f(frame)]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    inputs = frames.select(*[F.col(c).cast("long") for c in ("image_id", *carry)], "w", "h", "r", "g", "b", "a")
    return inputs.mapInArrow(run, ", ".join(["image_id long", *[f"{c} long" for c in carry], schema]))
