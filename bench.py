"""Headline queries of the engine, timed: one JSON line.

BENCH_SF_DIR: the tables (default /root/testdata/sf0.1). BENCH_CPUS: Spark's threads
(default all). The field queries code and decode 16,777,216 values per shape and mode;
``melem_per_s`` has their throughput as Spark jobs, ``kernel_melem_per_s`` that of the block
coder alone on one core, each as [encode, decode]. Table queries and decoding are run twice,
and the second run counts.
"""

from __future__ import annotations

import json
import os
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sparkfield.config import Config
from sparkfield.operators import codec, kernels
from sparkfield.plans import catalogue
from sparkfield.schema import Shape, scalar

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "*")
ELEMENTS = 1 << 24
KERNEL_ELEMENTS = 1 << 18
SHAPES = {1: (ELEMENTS,), 2: (4096, 4096), 3: (256, 256, 256), 4: (64, 64, 64, 64)}
TABLE_QUERIES = ("block_bits_precision_1d", "field_size_by_mode", "reversible_price", "reversible_embeddings", "box_of_embeddings", "array_streams", "rate_distortion")


def timed(make, runs: int = 2) -> float:
    for _ in range(runs):
        began = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        took = time.perf_counter() - began
    return round(took, 3)


def values_at(i: np.ndarray) -> np.ndarray:
    return np.sin(0.001 * i) * 32 + np.cos(0.000037 * i) * 4


def field_blocks(spark: SparkSession, kind: str, dims: tuple[int, ...], parts: int):
    """The published test field, as a block table made where it is coded."""
    shape, real = Shape.of(dims), np.dtype(scalar(kind).dtype)
    size = 4**shape.rank

    def each(batches):
        values = values_at(np.arange(shape.elements)).astype(real)
        for batch in batches:
            ids = batch.column("id").to_numpy()
            flat = kernels.gather(values, shape.active, int(ids[0]), len(ids)).reshape(-1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, size, dtype=np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_pydict({"block": batch.column("id"), "vals": lists})

    return spark.range(0, shape.blocks, 1, parts).mapInArrow(each, f"block long, vals array<{scalar(kind).sql}>")


def kernel_speed(rank: int, cfg: Config) -> list[float]:
    kind, blocks = scalar("f64"), values_at(np.arange(KERNEL_ELEMENTS)).reshape(-1, 4**rank)
    began = time.perf_counter()
    bits, sizes = kernels.encode_blocks(blocks, kind, rank, cfg)
    middle = time.perf_counter()
    kernels.decode_blocks(kernels.Bits(codec.pack(bits)), np.concatenate(([0], np.cumsum(sizes)[:-1])), kind, rank, cfg)
    return [round(KERNEL_ELEMENTS / 1e6 / t, 2) for t in (middle - began, time.perf_counter() - middle)]


def main() -> None:
    builder = SparkSession.builder.master(f"local[{CPUS}]").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
    builder = builder.config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
    cores = os.cpu_count() if CPUS == "*" else int(CPUS)
    spark = builder.config("spark.sql.shuffle.partitions", str(cores)).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in TABLE_QUERIES:
        seconds[name] = timed(lambda name=name: catalogue.QUERIES[name](spark, SF_DIR))
    speed, kernel = {}, {}
    for rank, dims in SHAPES.items():
        blocks = field_blocks(spark, "f64", dims, 4 * cores).persist()
        blocks.count()
        for mode, cfg in (("rate", Config.fixed_rate(8, "f64", rank)), ("precision", Config.fixed_precision(16)), ("accuracy", Config.fixed_accuracy(2.0**-8)), ("reversible", Config.reversible())):
            chunk = max(1, Shape.of(dims).blocks // (4 * cores))
            name = f"f64_d{rank}_{mode}"
            seconds[f"encode_{name}"] = timed(lambda: codec.encode(blocks, "f64", dims, cfg, by=[], chunk_blocks=chunk), 1)
            chunks = codec.encode(blocks, "f64", dims, cfg, by=[], chunk_blocks=chunk).repartition(4 * cores, F.col("chunk_id")).persist()
            chunks.count()
            seconds[f"decode_{name}"] = timed(lambda: codec.decode(chunks, "f64", dims, cfg, by=[]))
            speed[name] = [round(ELEMENTS / 1e6 / seconds[f"{step}_{name}"], 2) for step in ("encode", "decode")]
            kernel[name] = kernel_speed(rank, cfg)
            chunks.unpersist()
        blocks.unpersist()
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": seconds, "melem_per_s": speed, "kernel_melem_per_s": kernel, "elements": ELEMENTS, "sf": SF_DIR.rsplit("sf", 1)[-1], "cpus": cores}))
    spark.stop()


if __name__ == "__main__":
    main()
