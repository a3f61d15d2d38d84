"""``python -m reviewlens reviews.csv --output results``: the whole experiment on a review CSV."""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import SparkSession

from reviewlens.config import Config
from reviewlens.models.baselines import BaselineSettings
from reviewlens.plans.experiment import load_reviews, run_experiment


def main() -> None:
    defaults, settings = Config(), BaselineSettings()
    parser = argparse.ArgumentParser(prog="reviewlens")
    parser.add_argument("csv", help="CSV file or folder of CSV files")
    parser.add_argument("--output", default="results", help="folder for tables, models and summaries")
    parser.add_argument("--max-rows", type=int, default=defaults.max_rows, help="draw so many rows; all by default")
    parser.add_argument("--seeds", type=int, nargs="+", default=list(defaults.seeds))
    parser.add_argument("--epochs", type=int, default=defaults.epochs)
    parser.add_argument("--batch-size", type=int, default=defaults.batch_size)
    parser.add_argument("--workers", type=int, default=defaults.workers, help="shards of a network's training rows, each a task of its own")
    parser.add_argument("--trees", type=int, default=settings.forest_trees, help="trees of the forest")
    parser.add_argument("--tree-depth", type=int, default=settings.forest_depth)
    parser.add_argument("--rounds", type=int, default=settings.boosting_rounds, help="rounds of boosting")
    parser.add_argument("--round-depth", type=int, default=settings.boosting_depth)
    parser.add_argument("--no-trees", action="store_true", help="skip the two tree baselines")
    args = parser.parse_args()

    config = replace(
        defaults,
        max_rows=args.max_rows or None,
        seeds=tuple(args.seeds),
        epochs=args.epochs,
        batch_size=args.batch_size,
        workers=args.workers,
    )
    settings = replace(
        settings,
        forest_trees=args.trees,
        forest_depth=args.tree_depth,
        boosting_rounds=args.rounds,
        boosting_depth=args.round_depth,
    )
    spark = SparkSession.builder.appName("reviewlens").getOrCreate()
    reviews = load_reviews(spark, args.csv, config.max_rows, config.seeds[0])
    tables = run_experiment(reviews, config, args.output, not args.no_trees, settings)
    for name in ("split_counts", "baselines", "summary", "gains", "gain_summary", "ttest", "f1_table"):
        print(f"\n{name}")
        tables[name].show(50, truncate=False)
    spark.stop()


if __name__ == "__main__":
    main()
