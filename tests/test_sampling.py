import math

import pytest
from pyspark.sql import functions as F

from reviewlens.operators import sampling


def rows(spark, n, hot=0.9):
    label = (F.col("id") < int(n * hot)).cast("int")
    return spark.range(n).select(F.col("id").alias("row_id"), label.alias("label"))


def picks(df, col="row_id"):
    return sorted(r[col] for r in df.collect())


def test_sample_is_exact_and_independent_of_partitioning(spark):
    df = rows(spark, 5000)
    first = picks(sampling.sample_n(df, 1234, 7))
    assert len(first) == len(set(first)) == 1234
    assert first == picks(sampling.sample_n(df.repartition(13, F.rand(1)), 1234, 7))
    assert first != picks(sampling.sample_n(df, 1234, 8))
    assert len(picks(sampling.sample_n(df, 6000, 7))) == 5000
    assert picks(sampling.sample_n(df, 0, 7)) == []


def test_sample_is_the_smallest_hashes(spark):
    df = rows(spark, 800)
    hashed = df.withColumn("h", sampling.order_hash("sample", 3, "row_id")).orderBy("h", "row_id").limit(100)
    assert picks(sampling.sample_n(df, 100, 3)) == picks(hashed)


def test_largest_remainder():
    assert sampling.largest_remainder([49 + 9, 299 + 42], 80) == [12, 68]
    assert sampling.largest_remainder([5, 5], 5) == [3, 2]
    assert sampling.largest_remainder([], 0) == []


@pytest.mark.parametrize("n", [40, 399, 3000])
def test_split_is_disjoint_complete_and_stratified(spark, n):
    out = sampling.train_val_test_split(rows(spark, n)).collect()
    assert sorted(r["row_id"] for r in out) == list(range(n))
    test = math.ceil(0.2 * n)
    val = math.ceil(0.125 * (n - test))
    sizes = {s: sum(r["split"] == s for r in out) for s in ("train", "val", "test")}
    assert sizes == {"test": test, "val": val, "train": n - test - val}
    share = sum(r["label"] for r in out) / n
    for s, size in sizes.items():
        assert abs(sum(r["label"] for r in out if r["split"] == s) - share * size) <= 1.5


def test_too_many_strata_are_refused(spark):
    df = spark.range(sampling.MAX_STRATA + 5).select(F.col("id").alias("row_id"), F.col("id").alias("label"))
    with pytest.raises(ValueError, match="strata"):
        sampling.stratified_split(df)


def test_ranks_with_a_hot_stratum(spark):
    df = rows(spark, 2000)
    out = sampling.hash_ranked(df, "x", 1, part_cols=["label"]).collect()
    for label, size in ((1, 1800), (0, 200)):
        part = [r for r in out if r["label"] == label]
        assert sorted(r["rank"] for r in part) == list(range(1, size + 1))
        assert {r["part_rows"] for r in part} == {size}


def test_row_index_over_uneven_keys(spark):
    keys = [*range(500), *range(10**12, 10**12 + 50), -7]
    df = spark.createDataFrame([(k,) for k in keys], "row_id long")
    got = {r["row_id"]: r["row_index"] for r in sampling.row_index(df).collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}


def test_batches(spark):
    df = rows(spark, 700)
    one = sampling.assign_batches(df, 128, 42, epoch=1).collect()
    sizes = {}
    for r in one:
        sizes[r["batch_id"]] = sizes.get(r["batch_id"], 0) + 1
    assert sizes == {i: 128 for i in range(5)}
    two = sampling.assign_batches(df, 128, 42, epoch=2).collect()
    assert {r["row_id"]: r["batch_id"] for r in one} != {r["row_id"]: r["batch_id"] for r in two}
    kept = sampling.assign_batches(df, 256, shuffle=False, drop_last=False).collect()
    assert {r["row_id"]: r["batch_id"] for r in kept} == {i: i // 256 for i in range(700)}


def test_folds_are_even(spark):
    out = sampling.stratified_folds(rows(spark, 403), 5, 1).collect()
    for label in (0, 1):
        sizes = [sum(r["fold"] == f and r["label"] == label for r in out) for f in range(5)]
        assert max(sizes) - min(sizes) <= 1
