"""Frames, packed (one row each, row-major channel arrays) or as tables of pixels (image_id, seq, fidx, w, h, i, x, y, r, g, b, a).

``from_vectors`` reads a vector table as small square rasters; ``from_packed`` explodes packed frames where a question
is about pixels; ``from_png`` decodes PNG files in executors.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The same rasters in SQL.
PX = """px AS (SELECT image_id, seq, fidx, 8 AS w, 8 AS h, i, (i % 8)::INT AS x, (i // 8)::INT AS y,
  least(255, floor(abs(v[(i + 21) % 64 + 1]::DOUBLE) * 1024))::INT AS r, least(255, floor(abs(v[(i + 37) % 64 + 1]::DOUBLE) * 1024))::INT AS g,
  least(255, floor(abs(v[(i + 53) % 64 + 1]::DOUBLE) * 1024))::INT AS b, greatest(0, least(255, floor(v[i + 1]::DOUBLE * 1024)))::INT AS a
  FROM (SELECT vec_id AS image_id, label AS seq, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::INT AS fidx, embedding AS v FROM embeddings) f,
       (SELECT unnest(range(64))::INT AS i) t)"""


def from_vectors(vectors: DataFrame, side: int = 8) -> DataFrame:
    """Packed rasters of ``side`` x ``side`` from (vec_id, embedding, label); label is the sequence, vec_id its order.

    One row a frame: image_id, seq, fidx, w, h and row-major arrays r, g, b, a. The order within a sequence costs a
    shuffle of packed frames, and only where fidx is read.
    """
    n = side * side
    order = Window.partitionBy("label").orderBy("vec_id")
    level = lambda k: f"transform(sequence(0, {n - 1}), i -> cast(least(255, floor(abs(cast(embedding[(i + {k}) % {n}] as double)) * 1024)) as int))"
    alpha = f"transform(sequence(0, {n - 1}), i -> cast(greatest(0, least(255, floor(cast(embedding[i] as double) * 1024))) as int))"
    return vectors.select(
        F.col("vec_id").alias("image_id"), F.col("label").alias("seq"), (F.row_number().over(order) - 1).alias("fidx"), F.lit(side).alias("w"), F.lit(side).alias("h"),
        F.expr(level(21)).alias("r"), F.expr(level(37)).alias("g"), F.expr(level(53)).alias("b"), F.expr(alpha).alias("a"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed frames of a data folder."""
    return from_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_packed(frames(spark, sf_dir))


def with_pixels(packed: DataFrame, name: str = "p") -> DataFrame:
    """Packed frames with one array of pixel structs (i, x, y, r, g, b, a) in place of the channels."""
    zipped = F.arrays_zip("r", "g", "b", "a")
    at = lambda z, i: F.struct(i.alias("i"), (i % F.col("w")).alias("x"), F.floor(i / F.col("w")).cast("int").alias("y"), *[z[c].cast("int").alias(c) for c in "rgba"])
    return packed.select("image_id", "seq", "fidx", "w", "h", F.transform(zipped, at).alias(name))


def from_packed(frames: DataFrame) -> DataFrame:
    """Pixels of packed frames (image_id, seq, fidx, w, h and arrays r, g, b, a, row-major)."""
    zipped = F.arrays_zip("r", "g", "b", "a")
    return frames.select("image_id", "seq", "fidx", "w", "h", F.posexplode(zipped).alias("i", "p")).select(
        "image_id", "seq", "fidx", "w", "h", "i", (F.col("i") % F.col("w")).alias("x"), F.floor(F.col("i") / F.col("w")).cast("int").alias("y"), *[F.col(f"p.{c}").cast("int").alias(c) for c in "rgba"]
    )


def _unfilter(mode: int, line: list[int], above: list[int], channels: int) -> np.ndarray:
    """Average and Paeth rows: each byte needs the one before it."""
    row = [0] * channels + line
    up = [0] * channels + above
    for k in range(channels, len(row)):
        a, b, c = row[k - channels], up[k], up[k - channels]
        if mode == 3:
            p = (a + b) >> 1
        else:
            x, y, z = abs(b - c), abs(a - c), abs(a + b - c - c)
            p = a if x <= y and x <= z else b if y <= z else c
        row[k] = (row[k] + p) & 255
    return np.array(row[channels:], dtype=np.int32)


def decode_png(data: bytes) -> np.ndarray:
    """An 8-bit, not interlaced PNG as height x width x RGBA."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, parts, palette, fade = 8, [], None, None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        at += 12 + n
        if kind == b"IHDR":
            w, h, depth, colour, _, _, laced = struct.unpack(">IIBBBBB", body)
            if depth != 8 or laced:
                raise ValueError("only 8-bit PNG without interlace")
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            fade = np.frombuffer(body, np.uint8)
        elif kind == b"IDAT":
            parts.append(body)
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(h, 1 + w * channels)
    out = np.zeros((h, w * channels), np.uint8)
    above = np.zeros(w * channels, np.int32)
    for y in range(h):
        mode, line = raw[y, 0], raw[y, 1:].astype(np.int32)
        if mode == 0:
            row = line
        elif mode == 1:
            row = np.cumsum(line.reshape(w, channels), axis=0).ravel()
        elif mode == 2:
            row = line + above
        else:
            row = _unfilter(mode, line.tolist(), above.tolist(), channels)
        above = row & 255
        out[y] = above
    x = out.reshape(h, w, channels)
    rgba = np.full((h, w, 4), 255, np.uint8)
    if colour == 3:
        rgba[..., :3] = palette[x[..., 0]]
        if fade is not None:
            rgba[..., 3] = np.append(fade, np.full(256, 255, np.uint8))[x[..., 0]]
    elif colour in (0, 4):
        rgba[..., :3] = x[..., :1]
        if colour == 4:
            rgba[..., 3] = x[..., 1]
    else:
        rgba[..., :channels] = x
    return rgba


def encode_png(rgba: np.ndarray) -> bytes:
    h, w, _ = rgba.shape
    raw = np.concatenate([np.zeros((h, 1), np.uint8), rgba.astype(np.uint8).reshape(h, w * 4)], axis=1).tobytes()
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


PACKED = "path string, w int, h int, r array<smallint>, g array<smallint>, b array<smallint>, a array<smallint>, error string"


#: values of frames, or bytes of files, after which a batch is passed on: what Python holds follows from it and not from rows
ENOUGH = 1 << 19


def from_png(files: DataFrame) -> DataFrame:
    """Packed frames of ``binaryFile`` rows (path, content); what cannot be read has null arrays and an error."""
    packed = pa.list_(pa.int16())

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        paths, images, errors = zip(*rows, strict=True) if rows else ((), (), ())
        size = lambda k: pa.array([None if x is None else x.shape[k] for x in images], pa.int32())
        channels = [pa.array([None if x is None else x[..., k].ravel() for x in images], packed) for k in range(4)]
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), size(1), size(0), *channels, pa.array(errors, pa.string())], names=["path", "w", "h", "r", "g", "b", "a", "error"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, held = [], 0
            for path, data in zip(b.column(0), b.column(1), strict=True):
                try:
                    x = decode_png(data.as_py() or b"").astype(np.int16)
                    rows.append((path.as_py(), x, None))
                    held += x.size
                except (ValueError, KeyError, struct.error, zlib.error, IndexError) as e:
                    rows.append((path.as_py(), None, str(e) or "unreadable"))
                if held >= ENOUGH:
                    yield batch(rows)
                    rows, held = [], 0
            yield batch(rows)

    return files.select("path", "content").mapInArrow(run, PACKED)
