"""Fields in tables and files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ERROR
from ..operators import kernels
from ..schema import Scalar, Shape, scalar


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embedding_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x: place in the vector, y: its number."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("y"), F.posexplode("embedding").alias("x", "value"))
    return rows.select(F.col("x").cast("bigint").alias("x"), F.col("y").cast("bigint").alias("y"), "value")


def event_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour, day of month and user group; 0 where there are none."""
    events = table(spark, sf_dir, "events")
    cell = [F.hour("ts").cast("bigint").alias("x"), (F.dayofmonth("ts") - 1).cast("bigint").alias("y"), (F.col("user_id") % 6).cast("bigint").alias("z")]
    counts = events.groupBy(*cell).agg(F.count("*").cast("int").alias("value"))
    at = F.col("id")
    cells = spark.range(24 * 31 * 6).select((at % 24).alias("x"), (F.floor(at / 24) % 31).alias("y"), F.floor(at / 744).alias("z"))
    return cells.join(F.broadcast(counts), ["x", "y", "z"], "left").select("x", "y", "z", F.coalesce("value", F.lit(0)).alias("value"))


def raw_blocks(files: DataFrame, kind: str | Scalar, dims, strides=(0, 0, 0, 0), slab: int = 4096) -> DataFrame:
    """Block tables of raw little-endian buffers (path, content), as Spark's binaryFile source gives them.

    A buffer shorter than the layout gives one row with an error.
    """
    kind, shape = scalar(kind), Shape.of(dims, strides)
    need = shape.span_bytes(kind.size)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = None if shape.contiguous else shape.element_index()
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                if len(content) < need:
                    error = {"kind": "InsufficientData", "required": need, "capacity": len(content)}
                    yield pd.DataFrame([{"field_id": path, "block": pd.NA, "vals": None, "error": error}]).astype({"block": "Int64"})
                    continue
                values = np.frombuffer(content, np.dtype(kind.dtype).newbyteorder("<"), need // kind.size)
                values = values if index is None else values[index]
                for first in range(0, shape.blocks, slab):
                    n = min(slab, shape.blocks - first)
                    blocks = kernels.gather(values, shape.active, first, n)
                    yield pd.DataFrame({"field_id": path, "block": first + np.arange(n), "vals": list(blocks), "error": None})

    return files.select("path", "content").mapInPandas(each, f"field_id string, block long, vals array<{kind.sql}>, error {ERROR}")


def read_raw(spark: SparkSession, path: str, kind: str | Scalar, dims, strides=(0, 0, 0, 0)) -> DataFrame:
    return raw_blocks(spark.read.format("binaryFile").load(path), kind, dims, strides)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """The chunk table as Parquet, ordered so that a box of a field reads few row groups."""
    key = [c for c in ("field_id", "chunk_id") if c in chunks.columns]
    chunks.repartitionByRange(*key).sortWithinPartitions(*key).write.parquet(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
