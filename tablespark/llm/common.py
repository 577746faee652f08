"""Helpers that all corpus operators share."""

from __future__ import annotations

import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; without one, a folder beside the warehouse.

    The warehouse is shared by all executors too, so no machine's own temporary folder is ever used.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints")
    return context.getCheckpointDir()


#: The shuffle files of a finished write are of no more use; Spark deletes them at once with this.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends, lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def deleted(*tables: DataFrame) -> None:
    """Deletes tables that `written` made and nothing reads any more."""
    for df in tables:
        for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def bounded_batches(spark: SparkSession, rows: int = 512, size: int = 8 << 20) -> None:
    """From now on this session's Arrow batches hold at most so many rows and bytes.

    Tasks that send whole texts through Python then need memory for a few long texts, not for 10,000 of them.
    """
    held = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(min(held, rows) if held > 0 else rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def slices(batch: pa.RecordBatch, column: str, rows: int = 512, size: int = 1 << 20):
    """The batch in parts of at most so many rows and bytes of the column; a longer value is a part of its own."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    at = held = 0
    for end, n in enumerate(lengths):
        if end > at and (held + n > size or end - at == rows):
            yield batch.slice(at, end - at)
            at, held = end, 0
        held += n
    if at < len(lengths):
        yield batch.slice(at)


def row_key(*cols: str):
    """96 bits that name a row by its content; rows that agree in every column share it, nulls included."""
    return F.struct(F.xxhash64(*cols).alias("h"), F.hash(*reversed(cols)).alias("g"))
