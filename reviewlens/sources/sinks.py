"""Result sinks: one nested JSON document and CSV tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.config import MULTI_TASK, SINGLE_TASK, Config

SEED_METRICS = ("accuracy", "macro_f1", "f1_pos", "f1_neg", "auc")


def results_document(seed_metrics: DataFrame, summary: DataFrame, config: Config) -> DataFrame:
    """One row: per-seed lists of both tasks in seed order, the summary rows, seeds and settings.
    There is one row per (task, seed), so the collected lists are as short as the seed list."""
    order = F.array(*[F.lit(s) for s in config.seeds])
    entry = F.struct(
        F.array_position(order, F.col("seed")).alias("_order"),
        F.col("seed"),
        *[F.col(m) for m in SEED_METRICS],
    )

    def per_seed(model: str):
        # collect_list skips the nulls that ``when`` leaves for the other model
        ordered = F.array_sort(F.collect_list(F.when(F.col("model") == model, entry)))
        return F.transform(
            ordered, lambda r: F.struct(r["seed"].alias("seed"), *[r[m].alias(m) for m in SEED_METRICS])
        )

    lists = seed_metrics.agg(
        per_seed(SINGLE_TASK).alias("single_task_per_seed"),
        per_seed(MULTI_TASK).alias("multi_task_per_seed"),
    ).withColumn("_k", F.lit(1))
    rows = summary.agg(
        F.sort_array(F.collect_list(F.struct("model", *SEED_METRICS)), asc=False).alias("summary")
    ).withColumn("_k", F.lit(1))
    settings = F.struct(
        F.lit("tf-idf").alias("encoder"),
        F.lit(config.epochs).alias("epochs"),
        F.lit(config.batch_size).alias("batch_size"),
        F.lit(config.learning_rate).alias("lr"),
        F.lit(config.sentiment_weight).alias("sentiment_weight"),
        F.lit(config.recommend_weight).alias("recommend_weight"),
    )
    return lists.join(rows, "_k").select(
        "single_task_per_seed",
        "multi_task_per_seed",
        "summary",
        order.alias("seeds"),
        settings.alias("config"),
    )


def write_results_json(document: DataFrame, path: str) -> None:
    """Write the one-row document."""
    document.coalesce(1).write.mode("overwrite").json(path)


def write_table_csv(df: DataFrame, path: str) -> bool:
    """Write a table as CSV with a header, unless it is empty. Outer whitespace and quotes survive."""
    if df.isEmpty():
        return False
    df.write.mode("overwrite").options(
        header=True,
        quote='"',
        escape='"',
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    ).csv(path)
    return True
