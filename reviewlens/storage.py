"""Tables written between the passes of a multi-pass job, and checks on small results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.storagelevel import StorageLevel


def shared_dir(spark: SparkSession) -> str | None:
    """The cluster's shared checkpoint folder. A temporary one is made only on a local master."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and spark.sparkContext.getCheckpointDir():
        path = spark.sparkContext.getCheckpointDir()
    if not path and spark.sparkContext.master.startswith("local"):
        path = tempfile.mkdtemp(prefix="reviewlens-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    base = shared_dir(spark)
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once and read it back: later passes skip the work before it and read only
    the columns they need, and a lost executor costs no recomputation of the lineage.

    A cluster that names no shared folder gets a cached frame, which Spark recomputes on loss.
    """
    spark = df.sparkSession
    if not shared_dir(spark):
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def collect_small(df: DataFrame, at_most: int, what: str) -> list[Row]:
    """Collect a result that must be small, such as one row per class; refuse a larger one."""
    rows = df.limit(at_most + 1).collect()
    if len(rows) > at_most:
        raise ValueError(f"{what}: more than {at_most} rows")
    return rows
