"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.storage import materialize

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ARROW_BYTES = "16m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_by_bytes(spark: SparkSession) -> None:
    """Bound the batches that Python workers get by size, so that very long texts come few at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def give_back() -> None:
    """Return what Arrow's pool in this Python process holds unused: workers outlive their tasks and the driver its steps, and the pool
    keeps the most that any of these took, beside what the next stage needs."""
    pa.default_memory_pool().release_unused()


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_key(text: Column) -> list[Column]:
    """Two 64-bit hashes that stand for a text in joins."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the edges (a, b): one row (node, component) per end point, where
    component is the smallest node that can be reached.

    Every round points each node to its smallest neighbour, shortens these chains to their roots by
    pointer jumping, and goes on with the edges between roots. Each step is written to the shared folder.
    Self loops and nulls are ignored.
    """
    edges = materialize(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(),
        "edges",
    )
    labels = edges.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    first = True
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = materialize(
            both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("up")), "parents"
        )
        while True:
            above = parent.select(F.col("node").alias("up"), F.col("up").alias("root"))
            jumped = materialize(
                parent.join(above, "up").select("node", F.col("root").alias("up"), (F.col("root") < F.col("up")).alias("moved")),
                "parents",
            )
            parent = jumped.select("node", "up")
            if jumped.where("moved").isEmpty():
                break
        if first:
            labels = parent.select("node", F.col("up").alias("component"))
            first = False
        else:
            moved = parent.select(F.col("node").alias("component"), "up")
            labels = materialize(
                labels.join(moved, "component", "left").select("node", F.coalesce("up", "component").alias("component")),
                "labels",
            )
        left = parent.select(F.col("node").alias("a"), F.col("up").alias("ra"))
        right = parent.select(F.col("node").alias("b"), F.col("up").alias("rb"))
        edges = materialize(
            edges.join(left, "a").join(right, "b").where("ra != rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(),
            "edges",
        )
    return labels


BROADCAST_ROWS = 300_000


def small(stored: DataFrame, at_most: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of narrow rows, to be broadcast if it has at most ``at_most`` of them; beyond that Spark
    joins it by shuffle. Either way gives the same rows."""
    return F.broadcast(stored) if stored.count() <= at_most else stored
