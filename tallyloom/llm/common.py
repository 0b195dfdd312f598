"""Helpers shared by the corpus operators: reading tables, durable cuts of the lineage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.shipping import ship

#: Used only where the session runs in one process and names no folder, as in tests.
DEFAULT_CHECKPOINT_DIR = "/tmp/checkpoints/tallyloom"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir); a folder of this machine only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = DEFAULT_CHECKPOINT_DIR
    return found.rstrip("/")


def durable(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back.

    Unlike a cache the copy outlives a lost executor, and the plan that made it runs once.
    The path is kept on the result for release().
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/cuts/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def release(*cuts: DataFrame) -> None:
    """Deletes durable copies that no later plan reads."""
    for cut in cuts:
        path = getattr(cut, "_cut_path", None)
        if path:
            jvm = cut.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(cut.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


#: Keys that are broadcast for a semi-join: so many bytes at 16 a key; more are joined by a shuffle.
BROADCAST_KEY_BYTES = 32 << 20


def rows_of(rows: DataFrame, keys: DataFrame, on: str | list[str], how: str = "left_semi") -> DataFrame:
    """The rows whose key is among keys (durable), or with left_anti isn't. Few keys, by count, are broadcast."""
    few = keys.count() * 16 * len(keys.columns) <= BROADCAST_KEY_BYTES
    return rows.join(F.broadcast(keys) if few else keys, on, how)


#: Bytes that a task turns into Python objects at once.
SLICE_BYTES = 4 << 20


def slices(batches: Iterator[pa.RecordBatch], column: int = 1) -> Iterator[pa.RecordBatch]:
    """The batches in pieces whose texts (in `column`) have about SLICE_BYTES, at least a row each."""
    for batch in batches:
        size = max(1, batch.column(column).nbytes)
        step = max(1, batch.num_rows * SLICE_BYTES // size)
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """The name, lengthened until no column of df has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def whole_text() -> F.Column:
    """The text, null as empty."""
    return F.coalesce(F.col("text"), F.lit(""))
