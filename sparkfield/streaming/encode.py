"""Fields that arrive as a stream: each array is coded as it comes, without state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Config
from ..operators import codec
from ..schema import Scalar


def encode_stream(rows: DataFrame, column: str, kind: str | Scalar, cfg: Config) -> DataFrame:
    """``rows`` with the array ``column`` replaced by ``stream`` and ``n_values``. Works on batch tables too."""
    return rows.withColumns({"n_values": F.size(column), "stream": codec.encode_arrays(column, kind, cfg)}).drop(column)


def decode_stream(rows: DataFrame, column: str, kind: str | Scalar, cfg: Config) -> DataFrame:
    return rows.withColumn(column, codec.decode_arrays("stream", "n_values", kind, cfg)).drop("stream", "n_values")


def windowed_sizes(rows: DataFrame, time: str, every: str, late: str) -> DataFrame:
    """Coded bytes by event-time window, of coded rows; rows later than ``late`` are dropped by the watermark."""
    return (
        rows.withWatermark(time, late)
        .groupBy(F.window(time, every))
        .agg(F.count("*").alias("n_fields"), F.sum(F.length("stream")).alias("bytes"), F.sum("n_values").alias("n_values"))
    )


def write_stream(rows: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append coded rows to Parquet files, exactly once."""
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start(path)
