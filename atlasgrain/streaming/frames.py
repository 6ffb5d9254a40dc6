"""A streaming front for frame checks: PNG files that arrive in a folder are measured and judged as they come.

The reference has no streams; this runs the same batch operators on micro-batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.frames import measure_frame, validate_frame
from ..sources.frames import from_png


def judge(files: DataFrame) -> DataFrame:
    """path, ok, failures and error of binaryFile rows."""
    frames = from_png(files).withColumn("image_id", F.xxhash64("path"))
    good = frames.where("error IS NULL").withColumns({"seq": F.lit(0), "fidx": F.lit(0)})
    verdicts = validate_frame(measure_frame(good))
    return frames.select("path", "image_id", "error").join(verdicts.select("image_id", "ok", "failures"), "image_id", "left").select("path", F.coalesce("ok", F.lit(False)).alias("ok"), "failures", "error")


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Judge what is in ``folder`` and what arrives until none is left; verdicts go to ``out`` as Parquet, each batch once."""
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.png").load(folder)

    def batch(rows: DataFrame, number: int) -> None:
        judge(rows).write.mode("overwrite").parquet(f"{out}/batch={number}")  # a batch that runs again replaces itself

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
