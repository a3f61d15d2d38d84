"""Exact, seeded sampling, splitting and batching.

Every random order is the order of ``md5(salt:seed:key)``: the same picks on any partitioning.
Exact ranks never sort a whole table in one task. The rows are counted per bucket of the order,
the running total over the (at most 65,536) buckets gives each bucket its offset, and only rows of
one bucket are ever ranked together. Where a cut is enough (sample, split), no data row is moved.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlens.operators.scan import running
from reviewlens.storage import collect_small

BUCKET_DIGITS = 4
MAX_STRATA = 1_000


def order_hash(salt: str, seed: int, key: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(salt), F.lit(str(seed)), F.col(key).cast("string")))


def _prefix(hash_col: str) -> Column:
    return F.substring(hash_col, 1, BUCKET_DIGITS)


def ranked(
    df: DataFrame,
    order_by: list[str],
    bucket: str,
    part_cols: list[str] | None = None,
    rank: str = "rank",
    size: str = "part_rows",
) -> DataFrame:
    """Exact rank from 1 within ``part_cols`` (non-null), and the size of the part. ``bucket`` must
    not decrease along ``order_by``. The window and the join share one hash partitioning."""
    parts = list(part_cols or [])
    keys = [*parts, bucket]
    # At most one row per bucket and part reaches these windows.
    along = Window.partitionBy(*(parts or [F.lit(0)])).orderBy(bucket)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            *keys,
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
            F.sum("_n").over(whole).alias(size),
        )
    )
    inside = Window.partitionBy(*keys).orderBy(*order_by)
    return (
        df.withColumn("_within", F.row_number().over(inside))
        .join(offsets, keys)
        .withColumn(rank, F.col("_before") + F.col("_within"))
        .drop("_within", "_before")
    )


def hash_ranked(
    df: DataFrame, salt: str, seed: int, key: str = "row_id", part_cols: list[str] | None = None
) -> DataFrame:
    """Exact rank in the seeded hash order."""
    columns = [*df.columns, "rank", "part_rows"]
    hashed = df.withColumn("_hash", order_hash(salt, seed, key)).withColumn("_bucket", _prefix("_hash"))
    return ranked(hashed, ["_hash", key], "_bucket", part_cols).select(*columns)


def row_index(df: DataFrame, key: str = "row_id", out: str = "row_index") -> DataFrame:
    """Dense index from 0 in key order."""
    rows = running(df, [], [F.col(key)], [])
    return rows.select(*df.columns, (F.col("rank") - 1).alias(out))


def largest_remainder(counts: list[int], pick: int) -> list[int]:
    """Share ``pick`` over the counts in proportion; left-over units go to the largest remainders,
    the earlier stratum first on ties."""
    total = sum(counts)
    base = [pick * c // total for c in counts] if total else [0] * len(counts)
    by_remainder = sorted(range(len(counts)), key=lambda i: (-((pick * counts[i]) % max(total, 1)), i))
    for i in by_remainder[: pick - sum(base)]:
        base[i] += 1
    return base


def _local(df: DataFrame, rows: list[tuple], strata: list[str], more: list[T.StructField]) -> DataFrame:
    schema = T.StructType([*[df.schema[c] for c in strata], *more])
    return F.broadcast(df.sparkSession.createDataFrame(rows, schema))


def _with_cuts(
    df: DataFrame, hash_col: str, key: str, strata: list[str], quotas_of
) -> DataFrame:
    """Add ``_cut_1, _cut_2 …``: per stratum the (hash, key) of the last row within each quota, or
    null for a quota of zero. ``quotas_of`` maps the stratum sizes to a list of quotas each.

    Pass one counts rows per (stratum, hash prefix); pass two ranks only the rows of the prefix in
    which a cut falls, about one row in 65,536. Both read the key and the strata alone. What comes
    back to the driver is one row per stratum, and so is what is broadcast (at most MAX_STRATA).
    """
    keyed = df.select(*strata, key, hash_col)
    histogram = (
        keyed.groupBy(*strata, _prefix(hash_col).alias("_bucket"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .persist()
    )
    try:
        sizes = collect_small(
            histogram.groupBy(*strata).agg(F.sum("_n").alias("_size")).orderBy(*strata),
            MAX_STRATA,
            "strata",
        )
        names = [tuple(r[c] for c in strata) for r in sizes]
        quotas = quotas_of([r["_size"] for r in sizes])
        wanted = [
            (*name, number, quota)
            for name, row in zip(names, quotas)
            for number, quota in enumerate(row, 1)
            if quota > 0
        ]
        number = T.StructField("_number", T.IntegerType())
        targets = _local(df, wanted, strata, [number, T.StructField("_quota", T.LongType())])
        along = Window.partitionBy(*strata).orderBy("_bucket")
        running = histogram.withColumn("_upto", F.sum("_n").over(along))
        hits = (
            running.join(targets, strata)
            .filter((F.col("_upto") >= F.col("_quota")) & (F.col("_upto") - F.col("_n") < F.col("_quota")))
            .select(*strata, "_bucket", "_number", (F.col("_quota") - F.col("_upto") + F.col("_n")).alias("_left"))
        )
        hit_rows = [tuple(r) for r in collect_small(hits, 10 * MAX_STRATA, "cuts")]
    finally:
        histogram.unpersist()
    more = [T.StructField("_bucket", T.StringType()), number, T.StructField("_left", T.LongType())]
    boundary = keyed.withColumn("_bucket", _prefix(hash_col)).join(
        _local(df, hit_rows, strata, more), [*strata, "_bucket"]
    )
    inside = Window.partitionBy(*strata, "_bucket", "_number").orderBy(hash_col, key)
    exact = boundary.withColumn("_within", F.row_number().over(inside)).filter(
        F.col("_within") == F.col("_left")
    )
    found: dict[tuple, dict[int, tuple]] = {name: {} for name in names}
    for r in collect_small(exact, 10 * MAX_STRATA, "cuts"):
        found[tuple(r[c] for c in strata)][r["_number"]] = (r[hash_col], r[key])
    count = max((len(q) for q in quotas), default=0)
    pair = T.StructType([T.StructField("hash", T.StringType()), T.StructField("key", df.schema[key].dataType)])
    cuts = [(*name, *[found[name].get(i) for i in range(1, count + 1)]) for name in names]
    table = _local(df, cuts, strata, [T.StructField(f"_cut_{i}", pair) for i in range(1, count + 1)])
    return df.join(table, strata, "left")


def _upto(hash_col: str, key: str, cut: str) -> Column:
    at = F.struct(F.col(hash_col).alias("hash"), F.col(key).alias("key"))
    return F.coalesce(at <= F.col(cut), F.lit(False))


def sample_n(df: DataFrame, n: int | None, seed: int = 42, key: str = "row_id") -> DataFrame:
    """Exactly ``n`` rows without replacement (all rows if there are no more than ``n``)."""
    if n is None:
        return df
    hashed = df.withColumn("_hash", order_hash("sample", seed, key)).withColumn("_all", F.lit(0))
    cut = _with_cuts(hashed, "_hash", key, ["_all"], lambda sizes: [[min(n, s)] for s in sizes])
    return cut.filter(_upto("_hash", key, "_cut_1")).select(*df.columns)


def _split_quotas(fracs: list[float]):
    def quotas(sizes: list[int]) -> list[list[int]]:
        left = list(sizes)
        upto = [0] * len(sizes)
        cuts: list[list[int]] = [[] for _ in sizes]
        for frac in fracs:
            picked = largest_remainder(left, math.ceil(frac * sum(left)))
            for i, p in enumerate(picked):
                left[i] -= p
                upto[i] += p
                cuts[i].append(upto[i])
        return cuts

    return quotas


def _split(df, fracs, names, rest, strata, seed, key, out) -> DataFrame:
    hashed = df.withColumn("_hash", order_hash("split", seed, key))
    cut = _with_cuts(hashed, "_hash", key, strata, _split_quotas(fracs))
    which = F.lit(rest)
    for number in range(len(fracs), 0, -1):
        which = F.when(_upto("_hash", key, f"_cut_{number}"), names[number - 1]).otherwise(which)
    return cut.withColumn(out, which).select(*df.columns, out)


def stratified_split(
    df: DataFrame,
    frac: float = 0.20,
    strata: list[str] | None = None,
    seed: int = 42,
    key: str = "row_id",
) -> DataFrame:
    """Add ``split``: ``test`` for a ceil(frac·n) share held out in proportion to the strata
    (default the label), else ``train``."""
    return _split(df, [frac], ["test"], "train", strata or ["label"], seed, key, "split")


def train_val_test_split(
    df: DataFrame,
    test_size: float = 0.20,
    val_size: float = 0.10,
    strata: list[str] | None = None,
    seed: int = 42,
    key: str = "row_id",
) -> DataFrame:
    """Add ``split``: the test share of all rows, then the validation share of the remaining ones
    (``val_size / (1 - test_size)`` of them), both stratified. The validation rows are the next ones
    in the hash order, so both cuts come from one histogram."""
    fracs = [test_size, val_size / (1 - test_size)]
    return _split(df, fracs, ["test", "val"], "train", strata or ["label"], seed, key, "split")


def split_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("split", "label").agg(F.count(F.lit(1)).alias("rows"))


def assign_batches(
    df: DataFrame,
    size: int,
    seed: int = 42,
    epoch: int = 1,
    shuffle: bool = True,
    drop_last: bool = True,
    key: str = "row_id",
) -> DataFrame:
    """Add ``epoch`` and ``batch_id``. Training batches follow a new hash order each epoch and the
    last partial batch is dropped; evaluation batches follow the key order and are all kept."""
    if shuffle:
        rows = hash_ranked(df, f"epoch{epoch}", seed, key)
    else:
        rows = running(df, [], [F.col(key)], []).withColumnRenamed("rows", "part_rows")
    if drop_last:
        rows = rows.filter(F.col("rank") <= F.floor(F.col("part_rows") / size) * size)
    return rows.select(
        *df.columns,
        F.lit(epoch).alias("epoch"),
        F.floor((F.col("rank") - 1) / size).alias("batch_id"),
    )


def stratified_folds(df: DataFrame, folds: int, seed: int, key: str = "row_id") -> DataFrame:
    """Add ``fold``: per label the folds differ by at most one row."""
    rows = hash_ranked(df, "fold", seed, key, ["label"])
    return rows.select(*df.columns, ((F.col("rank") - 1) % folds).cast("int").alias("fold"))


def cut_folds(df: DataFrame, folds: int, seed: int, key: str = "row_id") -> DataFrame:
    """Add ``fold``: ranges of the seeded hash order whose sizes per label differ by at most one row. As a fold is a comparison with
    cuts, no row is moved."""

    def quotas(sizes: list[int]) -> list[list[int]]:
        return [[n * (i + 1) // folds for i in range(folds - 1)] for n in sizes]

    hashed = df.withColumn("_hash", order_hash("fold", seed, key))
    cut = _with_cuts(hashed, "_hash", key, ["label"], quotas)
    beyond = [(~_upto("_hash", key, f"_cut_{i}")).cast("int") for i in range(1, folds)]
    return cut.withColumn("fold", sum(beyond, F.lit(0))).select(*df.columns, "fold")
