"""The registered queries: every operator over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens import functions as fn
from reviewlens.config import MULTI_TASK, SINGLE_TASK, Config
from reviewlens.models import baselines, net, trees
from reviewlens.models import tree_attributions as shapley
from reviewlens.models.baselines import BaselineSettings, Features
from reviewlens.models.calibrated_svm import fit_calibrated_svm
from reviewlens.models.naive_bayes import fit_naive_bayes
from reviewlens.operators import clean, features, metrics, report, sampling, statistics
from reviewlens.plans.experiment import features_of, run_multi_seed
from reviewlens.sources import (
    canonicalize,
    normalize_headers,
    read_reviews_csv,
    results_document,
    reviews_from_fixture,
    write_results_json,
    write_table_csv,
)
from reviewlens.storage import materialize, scratch_path

SEED = 42
SAMPLE_ROWS = 400
# The test reviews are few: smaller batches give the networks enough steps.
CONFIG = Config(max_rows=None, batch_size=32)
SETTINGS = BaselineSettings()
SEEDS = Config().seeds
NETS = (SINGLE_TASK, MULTI_TASK)
BASELINES = ("Logistic Regression", "Naive Bayes", "SVM", "Random Forest", "Gradient Boosting")

# A lexicon that matches the prose of the test tables.
TEST_LEXICON = {
    "insult": ["idiot", "moron", "stupid", "clown", "loser"],
    "disdain": ["worthless", "pathetic", "disgusting", "trash", "scum"],
    "english": ["the", "and", "of", "that"],
    "german": ["und", "der", "die"],
    "french": ["que", "les", "des"],
}

# Header spellings of the raw view, as a review export would have them.
MESSY_HEADERS = {
    "review_text": " ReviewText ",
    "rating": "Overall",
    "summary": "Summary",
    "verified_purchase": "Verified",
    "helpful_votes": "Vote",
    "product_id": "ASIN",
    "reviewer_id": "reviewerID",
}


# ---- shared inputs ----


def raw(spark: SparkSession, sf: str) -> DataFrame:
    return reviews_from_fixture(spark, sf)


def messy(spark: SparkSession, sf: str) -> DataFrame:
    return raw(spark, sf).withColumnsRenamed(MESSY_HEADERS)


def reviews(spark: SparkSession, sf: str) -> DataFrame:
    return clean.clean_reviews(raw(spark, sf))


def split_reviews(spark: SparkSession, sf: str) -> DataFrame:
    """Clean reviews with their split; written once, since fitting and applying both read it."""
    return sampling.train_val_test_split(materialize(reviews(spark, sf), "clean"), seed=SEED)


def train_rows(df: DataFrame) -> DataFrame:
    return df.filter(F.col("split") == "train")


def _digest_score(*parts: Column) -> Column:
    """A score in [0, 1] with ties, from the first digits of a hash of the parts."""
    digits = F.substring(F.md5(F.concat_ws(":", *parts)), 1, 4)
    return F.round(F.conv(digits, 16, 10).cast("double") / 65536, 2)


def _scored(df: DataFrame, runs: list[tuple], names: list[str]) -> DataFrame:
    """Every row under every run of a fixed list, with a score and a prediction."""
    run = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r)]) for r in runs])
    rows = df.select("row_id", "label", F.inline(run))
    score = _digest_score(*[F.col(n).cast("string") for n in names], F.col("row_id").cast("string"))
    return rows.withColumn("probability", score).withColumn(
        "prediction", (F.col("probability") >= 0.5).cast("int")
    )


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of both networks under every seed."""
    return _scored(reviews(spark, sf), [(m, s) for m in NETS for s in SEEDS], ["model", "seed"])


def baseline_predictions(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(reviews(spark, sf), [(m,) for m in BASELINES], ["model"])


def seed_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.evaluate(predictions(spark, sf), ["model", "seed"])


def history(spark: SparkSession, sf: str) -> DataFrame:
    """Validation F1 per (model, seed, epoch)."""
    val = split_reviews(spark, sf).filter(F.col("split") == "val")
    runs = [(m, s, e) for m in NETS for s in SEEDS for e in range(1, 6)]
    keys = ["model", "seed", "epoch"]
    scores = metrics.accuracy_f1(_scored(val, runs, keys), keys)
    return scores.select(*keys, F.round("macro_f1", 6).alias("val_f1"))


def models(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics of the baselines and the seed means of the networks."""
    rows = materialize(reviews(spark, sf).select("row_id", "label"), "labels")
    nets = _scored(rows, [(m, s) for m in NETS for s in SEEDS], ["model", "seed"])
    classical = _scored(rows, [(m,) for m in BASELINES], ["model"])
    return report.model_table(metrics.evaluate(classical), metrics.evaluate(nets, ["model", "seed"]))


def _r6(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# ---- sources ----


def headers_normalized(spark, sf):
    return normalize_headers(messy(spark, sf))


def reviews_canonical(spark, sf):
    both = normalize_headers(messy(spark, sf)).withColumn(
        "parent_asin", F.concat(F.lit("Q"), F.col("row_id").cast("string"))
    )
    half = F.when(F.col("row_id") % 2 == 0, F.col("asin"))
    return canonicalize(both.withColumn("asin", half))


def csv_roundtrip(spark, sf):
    path = scratch_path(spark, "reviews-csv")
    write_table_csv(messy(spark, sf), path)
    rows = canonicalize(normalize_headers(read_reviews_csv(spark, path)))
    return rows.withColumn("row_id", F.col("row_id").cast("long"))


def csv_folder(spark, sf):
    """Write the reviews in two layouts, of other column order and with a column more, and read both at once."""
    path = scratch_path(spark, "reviews-folder")
    rows = messy(spark, sf)
    even = F.col("row_id") % 2 == 0
    write_table_csv(rows.where(even), f"{path}/even")
    turned = rows.where(~even).withColumn("extra", F.lit("x")).select("extra", *reversed(rows.columns))
    write_table_csv(turned, f"{path}/odd")
    back = canonicalize(normalize_headers(read_reviews_csv(spark, f"{path}/*"))).drop("extra")
    return back.withColumn("row_id", F.col("row_id").cast("long"))


def csv_to_clean(spark, sf):
    path = scratch_path(spark, "reviews-csv")
    write_table_csv(messy(spark, sf), path)
    rows = canonicalize(normalize_headers(read_reviews_csv(spark, path)))
    return clean.clean_reviews(rows.withColumn("row_id", F.col("row_id").cast("long")))


def summary_csv(spark, sf):
    path = scratch_path(spark, "summary-csv")
    write_table_csv(statistics.seed_summary(seed_metrics(spark, sf)), path)
    return spark.read.csv(path, header=True)


# ---- projections and filters ----


def reviews_combined(spark, sf):
    return clean.combine_summary(raw(spark, sf)).select("row_id", "review_text")


def reviews_combined_compat(spark, sf):
    return clean.combine_summary(raw(spark, sf), strict_nulls=False).select("row_id", "review_text")


def rating_parsed(spark, sf):
    rows = raw(spark, sf)
    return rows.select("row_id", fn.parse_rating(F.col("rating")).alias("rating"))


def label_and_sentiment(spark, sf):
    rows = clean.with_rating_and_label(raw(spark, sf))
    return rows.select("row_id", "label", fn.sentiment_class(F.col("rating")).alias("sentiment"))


def text_stripped(spark, sf):
    return raw(spark, sf).select("row_id", fn.strip_column("review_text").alias("review_text"))


def text_lowered(spark, sf):
    return raw(spark, sf).select("row_id", F.lower("review_text").alias("review_text"))


def null_text_dropped(spark, sf):
    return clean.drop_null_text(raw(spark, sf)).select("row_id", "review_text")


def long_enough(spark, sf):
    rows = clean.drop_null_text(raw(spark, sf)).select("row_id", "review_text")
    return clean.strip_and_filter_length(rows)


def defaults_filled(spark, sf):
    rows = clean.with_rating_and_label(raw(spark, sf))
    return clean.fill_defaults(rows).select("row_id", "review_text", "rating")


def dedupe_first(spark, sf):
    rows = clean.drop_null_text(raw(spark, sf))
    return clean.dedupe_first(rows, ["review_text"], "row_id")


def reviews_clean(spark, sf):
    return reviews(spark, sf)


def reviews_clean_compat(spark, sf):
    return clean.clean_reviews(raw(spark, sf), strict_nulls=False)


def label_profile(spark, sf):
    return _r6(clean.profile(raw(spark, sf), reviews(spark, sf)), "positive", "negative")


def softmax_scores(spark, sf):
    rows = reviews(spark, sf)

    def logit(i: int) -> Column:
        return _digest_score(F.lit(f"logit{i}"), F.col("row_id").cast("string")) * 8 - 4

    logits = rows.select("row_id", F.array(*[logit(i) for i in range(3)]).alias("logits"))
    return logits.select(
        "row_id",
        F.round(fn.softmax_probability(F.col("logits")), 6).alias("probability"),
        fn.argmax(F.col("logits")).alias("prediction"),
    )


# ---- sampling ----


def sample_n(spark, sf):
    """A sample of ``SAMPLE_ROWS`` rows."""
    rows = materialize(reviews(spark, sf), "clean")
    return sampling.sample_n(rows, SAMPLE_ROWS, SEED)


def split_assign(spark, sf):
    return split_reviews(spark, sf).select("row_id", "label", "split")


def holdout_split(spark, sf):
    rows = materialize(reviews(spark, sf).select("row_id", "label", "sentiment"), "clean")
    return sampling.stratified_split(rows, 0.20, ["sentiment"], SEED)


def split_counts(spark, sf):
    return sampling.split_counts(split_reviews(spark, sf))


def row_index(spark, sf):
    return sampling.row_index(materialize(reviews(spark, sf).select("row_id"), "clean"))


def epoch_batches(spark, sf):
    rows = train_rows(split_reviews(spark, sf)).select("row_id")
    first = sampling.assign_batches(rows, 128, SEED, epoch=1)
    return first.unionByName(sampling.assign_batches(rows, 128, SEED, epoch=2))


def eval_batches(spark, sf):
    rows = materialize(reviews(spark, sf).select("row_id"), "clean")
    return sampling.assign_batches(rows, 256, SEED, shuffle=False, drop_last=False)


def folds(spark, sf):
    rows = materialize(reviews(spark, sf).select("row_id", "label"), "clean")
    return sampling.stratified_folds(rows, 5, SEED)


# ---- text features ----


def aspect_scores(spark, sf):
    names = list(features.aspect_columns())
    return features.aspect_scores(reviews(spark, sf)).select("row_id", *names)


def aspect_scores_test_lexicon(spark, sf):
    names = list(features.aspect_columns(TEST_LEXICON))
    return _r6(features.aspect_scores(reviews(spark, sf), TEST_LEXICON).select("row_id", *names), *names)


def aspect_sentiment(spark, sf):
    rows = features.aspect_sentiment(reviews(spark, sf), TEST_LEXICON)
    return _r6(rows, "mention_share", "mean_score")


def aspect_by_class(spark, sf):
    """Mean aspect scores and the positive rate per sentiment class."""
    columns = features.aspect_columns()
    rows = reviews(spark, sf).select("sentiment", "label", *[c.alias(n) for n, c in columns.items()])
    return rows.groupBy("sentiment").agg(
        F.count(F.lit(1)).alias("reviews"),
        F.round(F.avg("label"), 6).alias("positive_rate"),
        *[F.round(F.avg(n), 6).alias(n) for n in columns],
    )


def tokens(spark, sf):
    rows = reviews(spark, sf).select("row_id", F.posexplode(fn.tokenize(F.col("review_text"))))
    return rows.select("row_id", F.col("pos").cast("long").alias("pos"), F.col("col").alias("token"))


def term_counts(spark, sf):
    return features.term_counts(reviews(spark, sf))


def vocabulary(spark, sf):
    return features.vocabulary(train_rows(split_reviews(spark, sf)))


def idf(spark, sf):
    train = train_rows(split_reviews(spark, sf))
    terms = features.vocabulary(train)
    weight = features.smoothed_idf(train.count(), F.col("df"))
    return terms.select("term", F.round(weight, 6).alias("idf"))


def _tfidf(spark, sf) -> tuple[features.TfidfModel, DataFrame]:
    split = split_reviews(spark, sf)
    return features.TfidfModel.fit(train_rows(split)), split


def sublinear_tf(spark, sf):
    """Weights by position of each review's terms."""
    model, split = _tfidf(spark, sf)
    rows = model.counts(split).select(
        "row_id", F.inline(F.arrays_zip("_tf.indices", "_tf.values"))
    )
    return rows.toDF("row_id", "term_idx", "tf").select(
        "row_id", "term_idx", F.round(1 + F.log("tf"), 6).alias("weight")
    )


def tfidf_long(spark, sf):
    model, split = _tfidf(spark, sf)
    rows = features.long_form(model.transform(split), "row_id")
    return rows.select("row_id", F.col("idx").alias("term_idx"), F.round("weight", 6).alias("weight"))


def feature_rows(spark, sf):
    """TF-IDF and aspects side by side, absolute values, in long form."""
    model, split = _tfidf(spark, sf)
    rows = features.append_aspects(model.transform(split), model.size, TEST_LEXICON)
    long = features.long_form(features.absolute_values(rows), "row_id")
    return long.select("row_id", "idx", F.round("weight", 6).alias("weight"))


def encode_fixed(spark, sf):
    split = split_reviews(spark, sf)
    words = features.token_vocabulary(train_rows(split))
    rows = features.encode_fixed(split, words)
    return rows.select(
        "row_id",
        F.array_join("input_ids", " ").alias("input_ids"),
        F.array_join("attention_mask", " ").alias("attention_mask"),
    )


# ---- metrics ----


def class_weights(spark, sf):
    return _r6(statistics.class_weights(train_rows(split_reviews(spark, sf))), "weight")


def weighted_rows(spark, sf):
    train = materialize(train_rows(split_reviews(spark, sf)).select("row_id", "label"), "train")
    weights = statistics.class_weight_map(train)
    return _r6(statistics.with_class_weight(train, weights).select("row_id", "label", "weight"), "weight")


def confusion(spark, sf):
    return metrics.confusion(predictions(spark, sf), ["model", "seed"])


def accuracy_f1(spark, sf):
    rows = metrics.accuracy_f1(predictions(spark, sf), ["model", "seed"])
    return _r6(rows, "accuracy", "macro_f1", "f1_pos", "f1_neg")


def class_report(spark, sf):
    return _r6(
        metrics.classification_report(baseline_predictions(spark, sf)), "precision", "recall", "f1"
    )


def roc_points(spark, sf):
    rows = metrics.roc_curve(baseline_predictions(spark, sf), drop_intermediate=False)
    return _r6(rows, "fpr", "tpr")


def roc_points_reduced(spark, sf):
    return _r6(metrics.roc_curve(baseline_predictions(spark, sf)), "fpr", "tpr")


def auc(spark, sf):
    return _r6(metrics.auc(predictions(spark, sf), ["model", "seed"]), "auc")


def roc_table(spark, sf):
    return _r6(metrics.roc_table(baseline_predictions(spark, sf)), "fpr", "tpr")


def epoch_loss(spark, sf):
    train = materialize(train_rows(split_reviews(spark, sf)).select("row_id", "label"), "train")
    parts = [sampling.assign_batches(train, 128, SEED, epoch=e) for e in (1, 2)]
    rows = parts[0].unionByName(parts[1])
    score = _digest_score(F.col("epoch").cast("string"), F.col("row_id").cast("string"))
    losses = metrics.batch_loss(rows.withColumn("probability", score), ["epoch", "batch_id"])
    return _r6(metrics.epoch_loss(losses, ["epoch"]), "train_loss")


# ---- seeds and reports ----


def seed_detail(spark, sf):
    return report.seed_detail(seed_metrics(spark, sf), SINGLE_TASK)


def seed_summary(spark, sf):
    return statistics.seed_summary(seed_metrics(spark, sf))


def _gains(spark, sf) -> DataFrame:
    return statistics.paired_gain(
        metrics.accuracy_f1(predictions(spark, sf), ["model", "seed"]), SINGLE_TASK, MULTI_TASK
    )


def paired_gain(spark, sf):
    return _r6(_gains(spark, sf), "gain")


def gain_summary(spark, sf):
    return _r6(statistics.gain_summary(_gains(spark, sf)), "mean", "std", "min", "max")


def ttest(spark, sf):
    return _r6(statistics.ttest_1samp(_gains(spark, sf), "gain"), "t", "p_value")


def ttest_by_product(spark, sf):
    """Is a product's mean rating different from 3? One test per product over all rated reviews."""
    rows = raw(spark, sf).select("product_id", fn.parse_rating(F.col("rating")).alias("rating"))
    return _r6(statistics.ttest_1samp(rows, "rating", ["product_id"], 3.0), "t", "p_value")


def best_epoch(spark, sf):
    return statistics.best_epoch(history(spark, sf))


def model_union(spark, sf):
    return models(spark, sf)


def f1_table(spark, sf):
    return report.f1_table(models(spark, sf))


def metric_matrix(spark, sf):
    return report.metric_matrix(models(spark, sf), [*BASELINES, *NETS])


# ---- models: trained on all clean reviews ----


def _model_features(spark, sf) -> tuple[Features, DataFrame]:
    data, val, _ = features_of(materialize(reviews(spark, sf), "clean"), CONFIG, TEST_LEXICON)
    return data, val


def nb_scores(spark, sf):
    data, _ = _model_features(spark, sf)
    rows = fit_naive_bayes(data.train, data.size).transform(data.test)
    return rows.select("row_id", "label", F.round("probability", 6).alias("probability"), "prediction")


def linear_attributions(spark, sf):
    """The terms that move the naive Bayes log-odds of each test review most."""
    data, _ = _model_features(spark, sf)
    model = fit_naive_bayes(data.train, data.size)
    odds = [b - a for a, b in zip(*model.log_share)]
    names = [*data.tfidf.terms, *features.aspect_columns(TEST_LEXICON)]
    return _r6(
        baselines.linear_attributions(data.test, odds, baselines.feature_means(data.train), names, 5),
        "contribution",
    )


def baseline_suite(spark, sf):
    """All five baselines with their default settings."""
    data, _ = _model_features(spark, sf)
    results, _ = baselines.train_and_evaluate(
        data.train, data.test, include_trees=True, settings=SETTINGS, data=data
    )
    return results.select("model", "type", "status", *statistics.METRICS)


def calibrated_svm(spark, sf):
    data, _ = _model_features(spark, sf)
    model = fit_calibrated_svm(data.train, SETTINGS.svm_folds, SETTINGS.svm_iterations)
    return model.transform(data.test).select("row_id", "label", "probability", "prediction")


def svm_folds(spark, sf):
    """The sizes of the calibrated SVM's folds, and whether the gradient of the fold's classifier has vanished at its solution."""
    data, _ = _model_features(spark, sf)
    model = fit_calibrated_svm(data.train, SETTINGS.svm_folds, SETTINGS.svm_iterations, size=data.size)
    solved = spark.createDataFrame([(i, bool(g <= 1e-3)) for i, g in enumerate(model.gradients)], "fold int, solved boolean")
    folds = sampling.cut_folds(data.train.select("row_id", "label"), SETTINGS.svm_folds, SEED)
    return folds.groupBy("label", "fold").agg(F.count("*").alias("rows")).join(F.broadcast(solved), "fold")


def tree_attributions(spark, sf):
    """The features that move the forest's probability of each test review most."""
    data, _ = _model_features(spark, sf)
    model = trees.fit_forest(data.train, data.size, trees=SETTINGS.forest_trees, depth=SETTINGS.forest_depth, weights=statistics.class_weight_map(data.train))
    names = [*data.tfidf.terms, *features.aspect_columns(TEST_LEXICON)]
    return shapley.tree_attributions(model, data.test, names, 5)


def logistic_attributions(spark, sf):
    data, _ = _model_features(spark, sf)
    model = baselines.fit_logistic(data.train, SETTINGS.logistic_iterations)
    names = [*data.tfidf.terms, *features.aspect_columns(TEST_LEXICON)]
    means = baselines.feature_means(data.train)
    return baselines.linear_attributions(data.test, model.coefficients.tolist(), means, names, 5)


def _net(spark, sf, name: str) -> DataFrame:
    data, val = _model_features(spark, sf)
    model = net.TRAINERS[name](data.train, val, data.size, SEED, CONFIG)
    path = scratch_path(spark, "net")
    model.save(spark, path)
    return net.NetModel.load(spark, path).transform(data.test)


def net_single(spark, sf):
    """Train, save the best weights, load them and score the test rows."""
    return _net(spark, sf, SINGLE_TASK).select("row_id", "label", "probability", "prediction")


def net_multi(spark, sf):
    rows = _net(spark, sf, MULTI_TASK)
    return rows.select("row_id", "label", "probability", "prediction", "sentiment_prediction")


def multi_seed(spark, sf):
    data, val = _model_features(spark, sf)
    return run_multi_seed(data, val, CONFIG).seed_metrics


def results_json(spark, sf):
    """Write the nested result document and read it back."""
    rows = seed_metrics(spark, sf)
    path = scratch_path(spark, "results-json")
    write_results_json(results_document(rows, statistics.seed_summary(rows), Config()), path)
    back = spark.read.json(path)

    def runs(column: str, model: str) -> DataFrame:
        fields = F.transform(column, lambda r, i: F.struct((i + 1).cast("long").alias("place"), *[r[x].alias(x) for x in ("seed", *statistics.METRICS)]))
        return back.select(F.lit(model).alias("model"), F.inline(fields))

    rows = runs("single_task_per_seed", SINGLE_TASK).unionByName(runs("multi_task_per_seed", MULTI_TASK))
    texts = back.select(F.inline("summary"), F.col("config.batch_size").alias("batch_size"), F.col("config.epochs").alias("epochs"))
    texts = texts.select("model", F.col("macro_f1").alias("summary_f1"), "batch_size", "epochs")
    return _r6(rows, *statistics.METRICS).join(texts, "model")


ROWS_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (baseline_suite, calibrated_svm, logistic_attributions, tree_attributions, net_single, net_multi, multi_seed)
}

SQL_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        headers_normalized, reviews_canonical, csv_roundtrip, csv_folder, csv_to_clean, summary_csv,
        reviews_combined, reviews_combined_compat, rating_parsed, label_and_sentiment, text_stripped,
        text_lowered, null_text_dropped, long_enough, defaults_filled, dedupe_first, reviews_clean,
        reviews_clean_compat, label_profile, softmax_scores, sample_n, split_assign, holdout_split,
        split_counts, row_index, epoch_batches, eval_batches, folds, aspect_scores,
        aspect_scores_test_lexicon, aspect_sentiment, aspect_by_class, tokens, term_counts, vocabulary,
        idf, sublinear_tf, tfidf_long, feature_rows, encode_fixed, class_weights, weighted_rows,
        confusion, accuracy_f1, class_report, roc_points, roc_points_reduced, auc, roc_table,
        epoch_loss, seed_detail, seed_summary, paired_gain, gain_summary, ttest, ttest_by_product,
        best_epoch, model_union, f1_table, metric_matrix, nb_scores, linear_attributions, results_json, svm_folds,
    )
}
SQL_QUERIES["raw_reviews"] = raw
SQL_QUERIES["seed_metrics"] = lambda spark, sf: _r6(seed_metrics(spark, sf), *statistics.METRICS)
