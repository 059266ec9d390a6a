"""Results drawn row by row, and windowed counts over a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def pulled(spark: SparkSession, rows: Iterator[tuple], schema: StructType, query: Callable[[DataFrame], DataFrame], batch: int = 1000) -> Iterator:
    """Results over a source that may never end, a batch at a time: as many source rows are drawn as results ask for.

    Only for queries that treat each row on its own. Each batch is one small job; nothing beyond it is kept.
    """
    while chunk := [r for _, r in zip(range(batch), rows)]:  # noqa: B905  the range goes first, so no row is drawn and lost
        yield from query(spark.createDataFrame(chunk, schema)).toLocalIterator()


def windowed_counts(stream: DataFrame, time: str, key: str, width: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """Rows by tumbling window and key; rows later than late behind the newest are left out once their window is closed."""
    return (
        stream.withColumn(time, F.col(time).cast("timestamp"))
        .withWatermark(time, late)
        .groupBy(F.window(time, width).alias("window"), key)
        .agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("start"), key, "n")
    )
