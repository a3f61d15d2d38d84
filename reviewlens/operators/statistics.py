"""Class weights and statistics over seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.functions import fmt_gain, fmt_mean_std, t_p_value
from reviewlens.operators.sampling import MAX_STRATA
from reviewlens.storage import collect_small

METRICS = ("accuracy", "macro_f1", "f1_pos", "f1_neg", "auc")


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weight n / (k · n_c) of every class c, from one aggregation."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))
    # one row per class reaches this window
    whole = Window.partitionBy(F.lit(0))
    n, k = F.sum("rows").over(whole), F.count(F.lit(1)).over(whole)
    return counts.select(label, "rows", (n / (k * F.col("rows"))).alias("weight"))


def class_weight_map(df: DataFrame, label: str = "label") -> dict[int, float]:
    rows = collect_small(class_weights(df, label), MAX_STRATA, "classes")
    return {r[label]: r["weight"] for r in rows}


def with_class_weight(df: DataFrame, weights: dict[int, float], label: str = "label") -> DataFrame:
    """Attach each row's class weight. The classes are a counted handful (at most MAX_STRATA), so
    the lookup table is broadcast."""
    schema = df.select(label).schema.add("weight", "double")
    table = df.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], schema)
    return df.join(F.broadcast(table), label, "left")


def seed_statistics(df: DataFrame) -> DataFrame:
    """Mean and sample standard deviation of every metric per model."""
    return df.groupBy("model").agg(
        *[F.avg(m).alias(f"{m}_mean") for m in METRICS],
        *[F.stddev_samp(m).alias(f"{m}_std") for m in METRICS],
    )


def seed_summary(df: DataFrame) -> DataFrame:
    """One row per model with "mean ± std" cells; a single seed has no deviation ("nan")."""
    stats = seed_statistics(df)

    def cell(m: str) -> Column:
        std = F.coalesce(F.col(f"{m}_std"), F.lit(float("nan")))
        return F.regexp_replace(fmt_mean_std(F.col(f"{m}_mean"), std), "NaN", "nan").alias(m)

    return stats.select("model", *[cell(m) for m in METRICS])


def paired_gain(df: DataFrame, base: str, other: str, metric: str = "macro_f1") -> DataFrame:
    """``other - base`` per seed, with the signed text form."""

    def side(model: str, name: str) -> DataFrame:
        return df.filter(F.col("model") == model).select("seed", F.col(metric).alias(name))

    gain = F.col("_other") - F.col("_base")
    return side(base, "_base").join(side(other, "_other"), "seed").select(
        "seed", gain.alias("gain"), fmt_gain(gain).alias("gain_text")
    )


def gain_summary(gains: DataFrame) -> DataFrame:
    """Mean, population standard deviation, minimum and maximum of the gains."""
    g = F.col("gain")
    return gains.agg(
        F.count(g).alias("n"),
        F.avg(g).alias("mean"),
        F.stddev_pop(g).alias("std"),
        F.min(g).alias("min"),
        F.max(g).alias("max"),
        fmt_gain(F.avg(g)).alias("mean_text"),
    )


def ttest_1samp(
    df: DataFrame, value: str, group_cols: list[str] | None = None, mu: float = 0.0, min_n: int = 3
) -> DataFrame:
    """Two-sided one-sample t-test per group. Fewer than ``min_n`` values or no variance: nulls."""
    n, mean, std = F.count(value), F.avg(value), F.stddev_samp(value)
    sums = df.groupBy(*(group_cols or [])).agg(n.alias("n"), mean.alias("mean"), std.alias("std"))
    usable = (F.col("n") >= min_n) & (F.col("std") > 0)
    t = F.when(usable, (F.col("mean") - mu) / (F.col("std") / F.sqrt(F.col("n").cast("double"))))
    tested = sums.withColumn("t", t)
    tested = tested.withColumn(
        "p_value", F.when(F.col("t").isNotNull(), t_p_value(F.col("t"), F.col("n") - 1))
    )
    return tested.select(
        *(group_cols or []), "n", "t", "p_value", (F.col("p_value") < 0.05).alias("significant")
    )


def best_epoch(history: DataFrame) -> DataFrame:
    """Per (model, seed) the epoch with the highest validation F1, the earliest on ties. A run that
    never rises over zero has none. Each run has one row per epoch; only the winner is kept."""
    score = F.struct(F.col("val_f1"), (-F.col("epoch")).alias("order"))
    return (
        history.filter(F.col("val_f1") > 0)
        .groupBy("model", "seed")
        .agg(F.max(score).alias("_best"))
        .select(
            "model", "seed", (-F.col("_best.order")).alias("epoch"), F.col("_best.val_f1").alias("val_f1")
        )
    )
