"""An extension, not parity: filters and updates of the engine over Structured Streaming sources."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.writes import update_many
from ..plans import filters


def read(spark: SparkSession, path: str, schema: T.StructType, pattern: str | None = None) -> DataFrame:
    """New Parquet files below a folder, as they come."""
    source = spark.readStream.schema(schema)
    return (source.option("pathGlobFilter", pattern) if pattern else source).parquet(path)


def matching(stream: DataFrame, filter_: dict[str, Any]) -> DataFrame:
    return stream.filter(filters.compile_filter(filter_, stream.schema))


def with_update(stream: DataFrame, filter_: dict[str, Any], update: dict[str, Any]) -> DataFrame:
    """Every row, with the update applied where the filter matches."""
    return update_many(stream, filter_, update)


def counts(stream: DataFrame, time: str, width: str, late: str, filter_: dict[str, Any] | None = None) -> DataFrame:
    """Matching rows per window of event time; windows close once the watermark has passed."""
    timed = matching(stream, filter_ or {}).withColumn(time, F.col(time).cast("timestamp"))
    return timed.withWatermark(time, late).groupBy(F.window(time, width)).agg(F.count("*").alias("n"))
