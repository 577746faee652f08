"""Rules over streams: they compile to stateless columns, so filters, marks, focus and joins to tables run unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.query import Rules, process
from ..operators.table import Table


def stream_table(spark: SparkSession, folder: str, glob: str, order_by: list[str], name: str = "stream") -> Table:
    """A table over the Parquet files that come into a folder. The schema is that of the files already there."""
    schema = spark.read.option("pathGlobFilter", glob).parquet(folder).schema
    return Table.of(spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder), name, order_by)


def filtered_stream(table: Table, rules: Rules, global_filter: str = "") -> DataFrame:
    """The processed rows of a stream under their headers, with _hl."""
    return process(table, rules, global_filter).public("_hl")


def run_available(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Writes everything that is there as Parquet and stops; a later run goes on after the last finished batch."""
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
