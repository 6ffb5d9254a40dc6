"""Readers and writers of contracts, manifests, artifacts and frame folders (survey rows 1 to 25)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .frames import ENOUGH, encode_png, from_png


def json_documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, body (variant) and error of whole-file JSON; a byte-order mark is let pass, and the root has to be an object."""
    raw = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^﻿", "").alias("value"))
    body = raw.withColumn("body", F.try_parse_json("value"))
    kind = F.schema_of_variant("body")
    return body.select("path", F.when(kind.startswith("OBJECT"), F.col("body")).alias("body"), F.when(F.col("body").isNull(), "not JSON").when(~kind.startswith("OBJECT"), "root is not an object").alias("error"))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or pattern matches anything, by the file system that Spark reads it from."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def optional_documents(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Rows 5, 6: like ``json_documents``, but no file is no row; a document of another kind is an error, not a default."""
    if not exists(spark, path):
        return spark.createDataFrame([], "path string, error string").select("path", F.lit("{}").alias("b"), "error").select("path", F.parse_json("b").alias("body"), "error")
    docs = json_documents(spark, path)
    if kind is None:
        return docs
    told = F.try_variant_get("body", "$.kind", "string")
    return docs.withColumn("error", F.coalesce("error", F.when(~(told == kind) | told.isNull(), F.concat(F.lit("kind is not "), F.lit(kind)))))


def presets(docs: DataFrame) -> DataFrame:
    """Row 4: the entries of catalogues (``json_documents``): path, preset and entry (variant)."""
    held = F.coalesce(F.try_variant_get("body", "$.presets", "variant"), F.col("body"))
    named = F.from_json(F.to_json(held), "map<string,variant>")
    return docs.where("error IS NULL").select("path", F.explode(named).alias("preset", "entry"))


def artifacts(spark: SparkSession, folder: str, declared: DataFrame) -> DataFrame:
    """``declared`` (path, ...) with sha256, size_bytes and state: present or missing. Paths are relative to ``folder``."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.substring_index(F.regexp_replace("path", "^file:/+", "/"), folder.rstrip("/") + "/", -1)
    digests = found.select(name.alias("path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"))
    return declared.join(digests, "path", "left").withColumn("state", F.when(F.col("sha256").isNull(), "missing").otherwise("present"))


def single_report(spark: SparkSession, folder: str, state: str, name: str = "video-source.json") -> DataFrame:
    """One row: the path if exactly one report of the state is there, else an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(folder).select("path").where(F.col("path").contains(f"/{state}/"))
    n = F.count(F.lit(1))
    return files.agg(n.alias("n"), F.when(n == 1, F.min("path")).alias("path"), F.when(n != 1, F.concat(F.lit("found "), n.cast("string"))).alias("error"))


def png_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Frames of a folder of PNG files, decoded in the executors: packed arrays, file order, and the common cell size."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").option("recursiveFileLookup", "true").load(folder)
    frames = from_png(files)
    folder_of = F.regexp_replace("path", "/[^/]*$", "")
    # one row a file, without pixels, is numbered in its own folder; pixels join back by path
    plain = frames.where("error IS NULL").select("path", "w", "h", folder_of.alias("folder"))
    over = Window.partitionBy("folder")
    order = plain.withColumns({"fidx": F.row_number().over(over.orderBy("path")) - 1, "cell_w": F.max("w").over(over), "cell_h": F.max("h").over(over)}).drop("w", "h", "folder")
    return frames.join(order, "path", "left")


def manifest_layout(cells: DataFrame, cell_w: int, cell_h: int) -> DataFrame:
    """Rectangles of (state, row, frames, rects): explicit ones, else cells of the row's grid line."""
    made = F.transform(F.sequence(F.lit(0), F.col("frames") - 1), lambda k: F.struct((k * cell_w).alias("x"), (F.col("row") * cell_h).alias("y"), F.lit(cell_w).alias("w"), F.lit(cell_h).alias("h")))
    rects = F.when(F.size("rects") > 0, F.col("rects")).otherwise(made)
    return cells.select("state", F.posexplode(rects).alias("frame", "r")).select("state", "frame", "r.*")


def grid_layout(px: DataFrame, columns: int, rows: int) -> DataFrame:
    """Cells of a sheet that hold anything, with integer bounds."""
    cell = {"column": F.expr(f"cast(x div (w div {columns}) as int)"), "line": F.expr(f"cast(y div (h div {rows}) as int)")}
    used = px.where("a > 0").withColumns(cell).where((F.col("column") < columns) & (F.col("line") < rows))
    return used.groupBy("image_id", "line", "column", "w", "h").agg(F.count(F.lit(1)).alias("n")).select("image_id", "line", "column", F.expr(f"column * (w div {columns})").alias("x"), F.expr(f"line * (h div {rows})").alias("y"), F.expr(f"w div {columns}").alias("cell_w"), F.expr(f"h div {rows}").alias("cell_h"))


def curated_names(frames: DataFrame) -> DataFrame:
    """Output names of (run, state, frame, label): the label, else frame-i; the state in front if a run has several."""
    several = F.size(F.collect_set("state").over(Window.partitionBy("run"))) > 1
    name = F.coalesce("label", F.concat(F.lit("frame-"), F.col("frame").cast("string")))
    return frames.withColumn("name", F.when(several, F.concat_ws("-", "state", name)).otherwise(name))


def write_png(frames: DataFrame) -> DataFrame:
    """path, content and sha256 of packed frames, encoded in the executors; what writes them is up to the sink."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        pack = lambda out: pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.binary())], names=["path", "content"])
        for b in batches:
            out, held = [], 0
            channels = [(b.column(c).values.to_numpy(zero_copy_only=False), b.column(c).offsets.to_numpy()) for c in "rgba"]
            for k, (path, w, h) in enumerate(zip(b.column("path"), b.column("w").to_pylist(), b.column("h").to_pylist(), strict=True)):
                out.append((path.as_py(), encode_png(np.stack([v[o[k] : o[k + 1]] for v, o in channels], axis=1).reshape(h, w, 4))))
                held += len(out[-1][1])
                if held >= ENOUGH:
                    yield pack(out)
                    out, held = [], 0
            yield pack(out)

    return frames.select("path", "w", "h", "r", "g", "b", "a").mapInArrow(run, "path string, content binary").withColumn("sha256", F.sha2("content", 256))


def atlases(packed: DataFrame, columns: int = 8) -> DataFrame:
    """Row 19: one PNG sheet a sequence, with its digest and size, and the cells of its frames in order."""
    import numpy as np
    import pyarrow as pa

    from ..operators.segmentation import sheets

    def run(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                out.append((r["seq"], r["w"], r["h"], encode_png(np.stack([np.array(r[c]) for c in "rgba"], axis=1).reshape(r["h"], r["w"], 4))))
            columns_ = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns_, (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["seq", "sheet_w", "sheet_h", "content"])

    laid = sheets(packed, columns).select("seq", "w", "h", "r", "g", "b", "a").mapInArrow(run, "seq long, sheet_w int, sheet_h int, content binary")
    cell = F.struct("fidx", (F.col("fidx") % columns * F.col("w")).alias("x"), (F.floor(F.col("fidx") / columns).cast("int") * F.col("h")).alias("y"), "w", "h")
    cells = packed.groupBy(F.col("seq").cast("long").alias("seq")).agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    return laid.join(cells, "seq").select("*", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("size_bytes"))


def animations(packed: DataFrame, delay_ms: int = 125, loop: bool = True, threshold: int = 128) -> DataFrame:
    """Row 22: one GIF a sequence (seq, content), with its report: frames, delay in hundredths, whether all are transparent."""
    import numpy as np
    import pyarrow as pa

    from .gif import encode_gif, gif_report

    def run(table):
        order = np.argsort(table["fidx"].to_numpy(), kind="stable").tolist()
        w, h, cells = table["w"][0].as_py(), table["h"][0].as_py(), [table[c].to_pylist() for c in "rgba"]
        data = encode_gif([np.stack([np.array(c[k]) for c in cells], axis=1).reshape(h, w, 4) for k in order], delay_ms, loop, threshold)
        report = gif_report(data)
        return pa.table({"seq": pa.array([table["seq"][0].as_py()], pa.int64()), "content": pa.array([data], pa.binary()), "frames": pa.array([report["frames"]], pa.int32()), "delay_ticks": pa.array([report["delay_ticks"]], pa.int32()), "transparent": pa.array([report["transparent"]], pa.bool_())})

    return packed.select(F.col("seq").cast("long"), "fidx", "w", "h", "r", "g", "b", "a").groupBy("seq").applyInArrow(run, "seq long, content binary, frames int, delay_ticks int, transparent boolean")


def write_bytes(rows: DataFrame, path: str) -> None:
    """Row 18: (path, content) rows as Parquet by Spark's commit protocol: a reader sees all rows of a write or none."""
    rows.select("path", "content").write.mode("overwrite").parquet(path)


def report_line(columns: list[str]) -> Column:
    """Row 23: a result as one line of JSON."""
    return F.to_json(F.struct(*columns))


def write_reports(results: DataFrame, path: str) -> None:
    """One JSON line for each result, by Spark's commit protocol: all files appear or none."""
    results.select(report_line(results.columns).alias("value")).write.mode("overwrite").text(path)


def write_run(frames: DataFrame, path: str) -> None:
    """Frames as Parquet by state; only the states that are written again are replaced."""
    frames.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("state").parquet(path)


def size_problem(w: Column, h: Column, fps: Column, frames: Column) -> Column:
    """Limits of a video's metadata; null if it keeps them."""
    return F.when((w > 4096) | (h > 4096) | (w < 1) | (h < 1), "size").when(~(fps > 0), "rate").when(frames > 900, "frames")
