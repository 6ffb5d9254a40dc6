"""Queries on readers and writers of frames and documents (survey rows 3 to 8, 13, 14, 16, 17, 19 to 23, 103, 251, 253)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources import documents as D
from ..sources.frames import PX, frames, from_packed, from_png
from . import kernels as K
from .frames import bounds
from .integrity import table
from .transforms import digest


@query("src_png_frames", f"""WITH {PX} SELECT image_id, w, h, sum(a * (i + 1))::BIGINT AS digest, sum(r + g * 2 + b * 3)::BIGINT AS colours FROM px GROUP BY image_id, w, h""")
def q_png(spark, sf_dir: str) -> DataFrame:
    """Rows 3, 13, 17: frames written as PNG files and read again, in the executors."""
    named = frames(spark, sf_dir).withColumn("path", F.col("image_id").cast("string"))
    read = from_png(D.write_png(named)).where("error IS NULL").withColumn("image_id", F.col("path").cast("long"))

    def run(p: np.ndarray) -> list[dict]:
        return [{"w": p.shape[1], "h": p.shape[0], "digest": digest(p)["digest"], "colours": int((p[..., :3] * np.array([1, 2, 3])).sum())}]

    return K.per_frame(read, run, "w int, h int, digest long, colours long")


@query("src_manifest_layout", """WITH c AS (SELECT p_partkey, p_brand AS state, p_size % 5 AS row_, p_size % 4 + 1 AS frames, p_partkey % 3 = 0 AS told FROM part)
SELECT p_partkey, state, k::INT AS frame, CASE WHEN told THEN p_partkey % 100 + k ELSE k * 10 END::INT AS x, CASE WHEN told THEN 7 ELSE row_ * 20 END::INT AS y, CASE WHEN told THEN 3 ELSE 10 END AS w, CASE WHEN told THEN 4 ELSE 20 END AS h FROM c, range(5) t(k) WHERE k < frames""")
def q_manifest(spark, sf_dir: str) -> DataFrame:
    """Row 14: rectangles of a manifest, explicit ones or the cells of a grid line."""
    told = F.expr("transform(sequence(0, p_size % 4), k -> named_struct('x', cast(p_partkey % 100 + k as int), 'y', 7, 'w', 3, 'h', 4))")
    none = F.expr("cast(array() as array<struct<x:int,y:int,w:int,h:int>>)")
    cells = table(spark, sf_dir, "part").select(F.concat_ws("/", "p_brand", F.col("p_partkey").cast("string")).alias("state"), F.expr("p_size % 5").alias("row"), F.expr("p_size % 4 + 1").alias("frames"), F.when(F.col("p_partkey") % 3 == 0, told).otherwise(none).alias("rects"))
    return D.manifest_layout(cells, 10, 20).select(F.substring_index("state", "/", -1).cast("long").alias("p_partkey"), F.substring_index("state", "/", 1).alias("state"), "frame", "x", "y", "w", "h")


@query("src_grid_layout", f"""WITH {PX} SELECT image_id, (y // 4)::INT AS line, (x // 4)::INT AS column_, min(x // 4 * 4)::INT AS x, min(y // 4 * 4)::INT AS y FROM px WHERE a > 0 GROUP BY image_id, y // 4, x // 4""")
def q_grid(spark, sf_dir: str) -> DataFrame:
    """Row 16: cells of a sheet that hold anything."""
    return D.grid_layout(from_packed(frames(spark, sf_dir)), 2, 2).select("image_id", "line", F.col("column").alias("column_"), "x", "y")


@query("src_curated_names", """WITH n AS (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag AS state, CASE WHEN l_quantity > 25 THEN l_linestatus END AS label FROM lineitem), s AS (SELECT l_orderkey, count(DISTINCT state) > 1 AS several FROM n GROUP BY l_orderkey)
SELECT n.l_orderkey, l_linenumber, l_partkey, CASE WHEN several THEN state || '-' ELSE '' END || coalesce(label, 'frame-' || l_linenumber) AS name FROM n JOIN s USING (l_orderkey)""")
def q_names(spark, sf_dir: str) -> DataFrame:
    """Row 21."""
    n = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run"), "l_partkey", F.col("l_returnflag").alias("state"), F.col("l_linenumber").alias("frame"), F.when(F.col("l_quantity") > 25, F.col("l_linestatus")).alias("label"))
    return D.curated_names(n).select(F.col("run").alias("l_orderkey"), F.col("frame").alias("l_linenumber"), "l_partkey", "name")


@query("src_video_limits", """SELECT p_partkey, CASE WHEN p_size * 100 > 4096 OR p_size < 1 THEN 'size' WHEN NOT p_partkey % 30 > 0 THEN 'rate' WHEN p_partkey % 1000 > 900 THEN 'frames' END AS problem FROM part""")
def q_limits(spark, sf_dir: str) -> DataFrame:
    """Row 8."""
    n = F.col("p_size") * 100
    return table(spark, sf_dir, "part").select("p_partkey", D.size_problem(n, n, F.col("p_partkey") % 30, F.col("p_partkey") % 1000).alias("problem"))


@query("src_report_lines", """SELECT o_orderkey, '{"o_orderkey":' || o_orderkey || ',"status":"' || o_orderstatus || '","ok":' || CASE WHEN o_totalprice > 100000 THEN 'true' ELSE 'false' END || '}' AS line FROM orders""")
def q_lines(spark, sf_dir: str) -> DataFrame:
    """Row 23: what ``write_reports`` writes of each result."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), (F.col("o_totalprice") > 100000).alias("ok"))
    return rows.select("o_orderkey", D.report_line(rows.columns).alias("line"))


@query("src_atlas_cells", """WITH n AS (SELECT vec_id, label AS seq, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k, count(*) OVER (PARTITION BY label) AS n FROM embeddings)
SELECT seq::BIGINT AS seq, k::INT AS fidx, (k % 8 * 8)::INT AS x, (k // 8 * 8)::INT AS y, 64 AS sheet_w, (ceil(n / 8.0) * 8)::INT AS sheet_h, true AS decodes FROM n""")
def q_atlas(spark, sf_dir: str) -> DataFrame:
    """Row 19: the sheets of all sequences as PNG files, their cells, and whether the bytes read back as such a sheet."""
    sheets = D.atlases(frames(spark, sf_dir), 8)
    read = from_png(sheets.select(F.col("seq").cast("string").alias("path"), "content")).select(F.col("path").cast("long").alias("seq"), F.col("w").alias("_w"), F.col("h").alias("_h"))
    cells = sheets.select("seq", "sheet_w", "sheet_h", F.explode("cells").alias("c")).join(read, "seq")
    return cells.select("seq", F.col("c.fidx").alias("fidx"), F.col("c.x").alias("x"), F.col("c.y").alias("y"), "sheet_w", "sheet_h", ((F.col("_w") == F.col("sheet_w")) & (F.col("_h") == F.col("sheet_h"))).alias("decodes"))


@query("src_gif_report", """SELECT label::BIGINT AS seq, count(*)::INT AS frames, 12 AS delay_ticks, true AS transparent FROM embeddings GROUP BY label""")
def q_gif(spark, sf_dir: str) -> DataFrame:
    """Row 22: a GIF of each sequence at 125 ms a frame (halves to even), by what its bytes say."""
    return D.animations(frames(spark, sf_dir), 125).select("seq", "frames", "delay_ticks", "transparent")


@query("src_presets", """SELECT p_partkey AS path, k AS preset, (p_size + CASE k WHEN 'a' THEN 0 ELSE 1 END)::BIGINT AS frames FROM part, (VALUES ('a'), ('b')) t(k) WHERE k = 'a' OR p_partkey % 2 = 0""")
def q_presets(spark, sf_dir: str) -> DataFrame:
    """Row 4: catalogues made of parts, their entries at the root or under presets."""
    entries = F.expr("""concat('{"a":{"frames":', p_size, '}', if(p_partkey % 2 = 0, concat(',"b":{"frames":', p_size + 1, '}'), ''), '}')""")
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit('{"presets":'), entries, F.lit("}"))).otherwise(entries)
    docs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), F.parse_json(text).alias("body"), F.lit(None).cast("string").alias("error"))
    return D.presets(docs).select("path", "preset", F.variant_get("entry", "$.frames", "long").alias("frames"))


@query("src_review_board", """WITH n AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k FROM embeddings) SELECT vec_id, label, (k % 6 * 12 + 4)::INT AS x, (k // 6 * 28 + 20)::INT AS y FROM n""")
def q_board(spark, sf_dir: str) -> DataFrame:
    """Row 103: where each frame of a sequence lies on a review board of six columns, under a caption."""
    return board(table(spark, sf_dir, "embeddings"), "label", "vec_id", 8, 8, 6).select("vec_id", "label", "x", "y")


def board(rows: DataFrame, group: str, order: str, w: int, h: int, columns: int, gap: int = 4, caption: int = 16) -> DataFrame:
    """Row 103: x and y of each row's picture on its group's board."""
    k = F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1
    return rows.withColumn("_k", k).withColumns({"x": F.col("_k") % columns * (w + gap) + gap, "y": F.floor(F.col("_k") / columns).cast("int") * (h + gap + caption) + gap + caption}).drop("_k")


@query("src_onion_series", f"""WITH {PX}, b AS (SELECT image_id, seq, fidx, min(x) FILTER (a > 16) AS x0, max(x) FILTER (a > 16) + 1 AS x1, max(y) FILTER (a > 16) + 1 AS y1 FROM px GROUP BY image_id, seq, fidx)
SELECT image_id, seq::BIGINT AS seq, fidx::BIGINT AS fidx, x0, x1, y1, (x0 + x1) / 2.0::DOUBLE AS center, y1 - first_value(y1) OVER (PARTITION BY seq ORDER BY fidx) AS drift FROM b""")
def q_onion(spark, sf_dir: str) -> DataFrame:
    """Rows 251, 253: bounds and centres that an overlay of a sequence shows, and the drift of its ground line."""

    def run(p: np.ndarray) -> list[dict]:
        x0, _, x1, y1 = bounds(p[..., 3] > 16)
        return [{"x0": x0, "x1": x1, "y1": y1, "center": None if x0 is None else (x0 + x1) / 2}]

    b = K.per_frame(frames(spark, sf_dir), run, "x0 int, x1 int, y1 int, center double", ("seq", "fidx"))
    return b.withColumn("drift", F.col("y1") - F.first("y1").over(Window.partitionBy("seq").orderBy("fidx")))
