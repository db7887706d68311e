"""What the corpus operators share: tables, shared storage, row identity."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Texts are long, so a batch between the JVM and Python holds ``BATCH_ROWS`` rows at most."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only where driver and executors are one process may it be unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="sparkfield-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/sparkfield/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, free: bool = True) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    The files survive the loss of any executor; :func:`clean_up` removes all of an application's.
    With ``free`` the shuffle files of what nobody holds any more go at once.
    """
    spark, path, schema = df.sparkSession, new_path(df.sparkSession, name), df.schema
    df.write.parquet(path)
    del df
    if free:
        _free_shuffles(spark)
    out = spark.read.schema(schema).parquet(path)
    out._written_to = path
    return out


def _free_shuffles(spark: SparkSession) -> None:
    """Spark drops the shuffle files of plans that nobody holds any more once both sides have collected their garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release(table: DataFrame) -> None:
    """Remove a :func:`written` table that nothing reads any more."""
    if path := getattr(table, "_written_to", None):
        spark = table.sparkSession
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def clean_up(spark: SparkSession, keep: DataFrame | None = None) -> None:
    """Remove every table this application wrote to the shared folder, but ``keep``; results that still read them are lost."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/sparkfield/{spark.sparkContext.applicationId}")
    store = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in store.listStatus(top) if store.exists(top) else []:
        if keep is None or found.getPath().getName() != keep._written_to.rpartition("/")[2]:
            store.delete(found.getPath(), True)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only, whatever the locale."""
    return F.translate(text, UPPER, LOWER)


def slices(batches: Iterator[pd.DataFrame], rows: int = 1000) -> Iterator[pd.DataFrame]:
    """Smaller batches, so that what is made of a batch stays small too."""
    for batch in batches:
        for k in range(0, len(batch), rows):
            yield batch.iloc[k : k + rows]


def give_back() -> None:
    """Return freed memory to the system: a Python worker lives on after its task, beside whatever comes next."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
