"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; words are what lies between.
SPACE = r"[\x20\x09-\x0D]"
_local_dirs: dict[str, str] = {}
_kept: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    Only where the setting is absent and the master is local (tests) a temporary folder stands in.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = "file://" + tempfile.mkdtemp(prefix="atlasgrain-")
    return _local_dirs[app]


def spill(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors.

    What an application spills lies in one folder, which goes when its driver ends.
    """
    spark = df.sparkSession
    top = f"{shared_dir(spark)}/atlasgrain/{spark.sparkContext.applicationId}"
    if top not in _kept:
        path = spark._jvm.org.apache.hadoop.fs.Path(top)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
        _kept.add(top)
    path = f"{top}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches in slices of few rows, so that what Python makes of one stays small."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, in JVM functions; null text has none."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), "[\x09-\x0d]", " ")
    return F.array_remove(F.split(spaced, " "), "")


def text_mb(docs: DataFrame, column: str = "text") -> tuple[int, int]:
    """Rows and bytes of text: one aggregate, by which bucket counts follow the data."""
    row = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(column).cast("long"))).first()
    return int(row[0]), int(row[1] or 0)


#: Tables below this size (a few splits) may be dealt over the cores.
SMALL_BYTES = 64 << 20


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """Columns of a table, as its splits come; only one of a few splits, in fewer files than cores, is dealt over the cores."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < SMALL_BYTES and len(df.inputFiles()) < cores else df
