"""The whole experiment: load, split once, baselines once, both networks under every seed, report."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from reviewlens.config import MULTI_TASK, SINGLE_TASK, Config
from reviewlens.models.baselines import BaselineSettings, Features, prepare_features, train_and_evaluate
from reviewlens.models.net import TRAINERS, dealt_to_workers
from reviewlens.operators import metrics, report, sampling, statistics
from reviewlens.operators.clean import clean_reviews
from reviewlens.sources import (
    canonicalize,
    normalize_headers,
    read_reviews_csv,
    results_document,
    write_results_json,
    write_table_csv,
)
from reviewlens.storage import materialize

#: Networks that are trained side by side, each by ``Config.workers`` tasks.
NETS_AT_ONCE = 4


def load_reviews(
    spark: SparkSession, path: str, max_rows: int | None = None, seed: int = 42, strict_nulls: bool = True
) -> DataFrame:
    """CSV file or folder to clean, labelled reviews, at most ``max_rows`` of them."""
    rows = canonicalize(normalize_headers(read_reviews_csv(spark, path, row_id=True)))
    clean = clean_reviews(rows.withColumn("row_id", F.col("row_id").cast("long")), strict_nulls)
    clean = materialize(clean, "clean")
    return clean if max_rows is None else sampling.sample_n(clean, max_rows, seed)


@dataclass
class MultiSeedResult:
    """``seed_metrics`` (model, seed, five metrics), ``history`` (one row per epoch), the test
    ``predictions`` of all runs, and the ROC points of the first seed."""

    seed_metrics: DataFrame
    history: DataFrame
    predictions: DataFrame
    roc: DataFrame


def run_multi_seed(
    data: Features, val: DataFrame, config: Config = Config(), models_path: str | None = None
) -> MultiSeedResult:
    """Train and score both networks under every seed. Data and split stay fixed: the seed only sets
    the initial weights, the row order and the dropout. The feature tables are read, never rebuilt. A network keeps only ``workers``
    tasks busy, so ``NETS_AT_ONCE`` are trained side by side on rows dealt once."""
    spark = data.train.sparkSession
    scored, history = None, []
    dealt = dealt_to_workers(data.train, config.workers).persist(StorageLevel.MEMORY_AND_DISK)

    def run(seed: int, name: str) -> tuple[list[tuple], DataFrame]:
        model = TRAINERS[name](data.train, val, data.size, seed, config, dealt=dealt)
        if models_path:
            task = "single" if name == SINGLE_TASK else "multi"
            model.save(spark, f"{models_path}/best_{task}_task_seed{seed}")
        rows = model.transform(data.test).select(
            F.lit(name).alias("model"), F.lit(seed).alias("seed"), "row_id", "label", "prediction", "probability"
        )
        return [(name, seed, e, loss, f1) for e, loss, f1 in model.history], materialize(rows, "predictions")

    try:
        dealt.count()  # kept before several networks ask for it at once
        with ThreadPoolExecutor(NETS_AT_ONCE) as pool:
            runs = [pool.submit(run, seed, name) for seed in config.seeds for name in TRAINERS]
            try:
                for done, rows in (r.result() for r in runs):
                    history += done
                    scored = rows if scored is None else scored.unionByName(rows)
            finally:
                for r in runs:  # after a failure no other network is begun
                    r.cancel()
    finally:
        dealt.unpersist()
    first = scored.filter(F.col("seed") == config.seeds[0])
    return MultiSeedResult(
        metrics.evaluate(scored, ["model", "seed"]),
        spark.createDataFrame(history, "model string, seed int, epoch int, train_loss double, val_f1 double"),
        scored,
        metrics.roc_curve(first),
    )


def features_of(reviews: DataFrame, config: Config, lexicon=None) -> tuple[Features, DataFrame, DataFrame]:
    """Split the reviews, fit the features on the training rows and build them for all three parts."""
    split = materialize(
        sampling.train_val_test_split(reviews, config.test_size, config.val_size, seed=config.seeds[0]), "split"
    )
    train = split.filter(F.col("split") == "train")
    rest = split.filter(F.col("split") != "train")
    data = prepare_features(train, rest, config.max_features, config.min_df, lexicon)
    val = data.test.filter(F.col("split") == "val")
    data = Features(data.train, data.test.filter(F.col("split") == "test"), data.size, data.tfidf)
    return data, val, split


def run_experiment(
    reviews: DataFrame,
    config: Config = Config(),
    output: str | None = None,
    include_trees: bool = True,
    settings: BaselineSettings = BaselineSettings(),
    lexicon: dict[str, list[str]] | None = None,
) -> dict[str, DataFrame]:
    """All result tables, by name; written below ``output`` when it is given."""
    data, val, split = features_of(reviews, config, lexicon)
    baselines, baseline_roc = train_and_evaluate(data.train, data.test, include_trees, settings, data)
    baselines = materialize(baselines, "baselines")
    nets = run_multi_seed(data, val, config, f"{output}/models" if output else None)
    seeds = materialize(nets.seed_metrics, "seed-metrics")
    gains = statistics.paired_gain(seeds, SINGLE_TASK, MULTI_TASK)
    summary = statistics.seed_summary(seeds)
    models = report.model_table(baselines.filter(F.col("status") == "ok"), seeds)
    names = [*[r["model"] for r in baselines.select("model", "status").collect() if r["status"] == "ok"],
             SINGLE_TASK, MULTI_TASK]
    tables = {
        "split_counts": sampling.split_counts(split),
        "baselines": baselines,
        "seed_metrics": seeds,
        "history": nets.history,
        "summary": summary,
        "gains": gains,
        "gain_summary": statistics.gain_summary(gains),
        "ttest": statistics.ttest_1samp(gains, "gain"),
        "f1_table": report.f1_table(models),
        "metric_matrix": report.metric_matrix(models, names),
        "roc": nets.roc if baseline_roc is None else baseline_roc.unionByName(nets.roc),
    }
    if output:
        write_results_json(results_document(seeds, summary, config), f"{output}/multi_seed_results.json")
        write_table_csv(report.seed_detail(seeds, SINGLE_TASK), f"{output}/single_task_per_seed.csv")
        write_table_csv(report.seed_detail(seeds, MULTI_TASK), f"{output}/multi_task_per_seed.csv")
        write_table_csv(summary, f"{output}/summary_table.csv")
        for name in ("baselines", "gains", "gain_summary", "ttest", "f1_table", "metric_matrix", "roc"):
            tables[name].write.mode("overwrite").parquet(f"{output}/tables/{name}")
    return tables
