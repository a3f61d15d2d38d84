"""Classification metrics. Predictions are reduced to counts first, with map-side combining; all
further steps run on a few rows per model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.operators.scan import PART, running, within_parts
from reviewlens.storage import materialize

GROUP = ["model"]


def confusion(df: DataFrame, group: list[str] = GROUP) -> DataFrame:
    return df.groupBy(*group, "label", "prediction").agg(F.count(F.lit(1)).alias("rows"))


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def class_scores(counts: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """Precision, recall, F1 and support of every class that is a label or a prediction."""
    n, zero = F.col("rows"), F.lit(0).cast("long")
    hit = F.when(F.col("label") == F.col("prediction"), n).otherwise(zero)
    as_label = F.struct(
        F.col("label").alias("class"), n.alias("support"), zero.alias("predicted"), hit.alias("hits")
    )
    as_prediction = F.struct(
        F.col("prediction").alias("class"), zero.alias("support"), n.alias("predicted"), zero.alias("hits")
    )
    sums = (
        counts.select(*group, F.inline(F.array(as_label, as_prediction)))
        .groupBy(*group, "class")
        .agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])
    )
    hits = F.col("hits")
    return sums.select(
        *group,
        "class",
        _ratio(hits, F.col("predicted")).alias("precision"),
        _ratio(hits, F.col("support")).alias("recall"),
        _ratio(2 * hits, F.col("support") + F.col("predicted")).alias("f1"),
        "support",
        "hits",
    )


def accuracy_f1(df: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """Accuracy, macro F1 and the F1 of both classes (0 for a class that is absent)."""
    return _accuracy_f1(confusion(df, group), group)


def _accuracy_f1(counts: DataFrame, group: list[str]) -> DataFrame:
    def one_class(c: int) -> Column:
        return F.coalesce(F.max(F.when(F.col("class") == c, F.col("f1"))), F.lit(0.0))

    return (
        class_scores(counts, group)
        .groupBy(*group)
        .agg(
            (F.sum("hits") / F.sum("support")).alias("accuracy"),
            F.avg("f1").alias("macro_f1"),
            one_class(1).alias("f1_pos"),
            one_class(0).alias("f1_neg"),
        )
    )


def classification_report(df: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """One row per class, then accuracy, macro average and support-weighted average."""
    classes = class_scores(confusion(df, group), group)
    columns = ["precision", "recall", "f1"]
    total = F.sum("support")
    sums = classes.groupBy(*group).agg(
        total.alias("support"),
        (F.sum("hits") / total).alias("accuracy"),
        *[F.avg(c).alias(f"macro_{c}") for c in columns],
        *[(F.sum(F.col(c) * F.col("support")) / total).alias(f"weighted_{c}") for c in columns],
    )

    def row(name: str, values: list[Column]) -> Column:
        return F.struct(
            F.lit(name).alias("class"),
            *[v.alias(c) for c, v in zip(columns, values)],
            F.col("support"),
        )

    averages = sums.select(
        *group,
        F.inline(
            F.array(
                row("accuracy", [F.col("accuracy")] * 3),
                row("macro avg", [F.col(f"macro_{c}") for c in columns]),
                row("weighted avg", [F.col(f"weighted_{c}") for c in columns]),
            )
        ),
    )
    per_class = classes.select(*group, F.col("class").cast("string").alias("class"), *columns, "support")
    return per_class.unionByName(averages)


def score_points(df: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """Predictions as counts: one row for each score and prediction of a group, with its positive and negative rows. Written once, as
    curves need the range of the scores first, and far smaller than the predictions where scores repeat."""
    return materialize(
        df.groupBy(*group, "probability", "prediction").agg(
            F.count(F.when(F.col("label") == 1, 1)).alias("pos"), F.count(F.when(F.col("label") == 0, 1)).alias("neg")
        ),
        "score-points",
    )


def _by_score(points: DataFrame, group: list[str]) -> DataFrame:
    return points.groupBy(*group, "probability").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def _cumulative(points: DataFrame, group: list[str], buckets: int | None = None) -> DataFrame:
    """One row per distinct score with the running counts from the highest score down. Ties (even a third of all rows on one
    score) are one point. The points are dealt by ranges of the score, so no model's scores are sorted in one task."""
    rows = running(_by_score(points, group), group, [F.desc("probability")], ["pos", "neg"], ["pos", "neg"], buckets)
    return rows.select(
        *group, "probability", "pos", "neg", F.col("run_pos").alias("tp"), F.col("run_neg").alias("fp"),
        F.when(F.col("next_pos").isNotNull(), F.struct(F.col("next_pos").alias("pos"), F.col("next_neg").alias("neg"))).alias("next"),
        F.col("all_pos").alias("positives"), F.col("all_neg").alias("negatives"),
    )


def _curve(points: DataFrame, group: list[str], drop_intermediate: bool) -> DataFrame:
    first = (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))
    last = F.col("next").isNull()
    if drop_intermediate:
        bend = (F.col("next.pos") != F.col("pos")) | (F.col("next.neg") != F.col("neg"))
        points = points.filter(first | last | bend)

    def share(part: Column, whole: str) -> Column:
        return F.when(F.col(whole) > 0, part / F.col(whole))

    def point(threshold: Column, fp: Column, tp: Column) -> Column:
        return F.struct(
            threshold.alias("threshold"),
            share(fp, "negatives").alias("fpr"),
            share(tp, "positives").alias("tpr"),
        )

    zero = F.lit(0).cast("long")
    here = point(F.col("probability"), F.col("fp"), F.col("tp"))
    start = point(F.lit(float("inf")), zero, zero)
    # the row of the highest score also brings the starting point (0, 0)
    return points.select(*group, F.inline(F.when(first, F.array(start, here)).otherwise(F.array(here))))


def _area(points: DataFrame, group: list[str], buckets: int | None = None) -> DataFrame:
    """Trapezoids between neighbouring points: the last step is known from the row's own counts. Each part of the scores gives its own
    area; what lies before a part lifts it by as many positives."""
    local = within_parts(_by_score(points, group), group, [F.desc("probability")], ["pos", "neg"], (), buckets)
    trapezoid = F.col("neg").cast("double") * (2 * F.col("run_pos") - F.col("pos")) / 2
    parts = local.groupBy(*group, PART).agg(F.sum(trapezoid).alias("area"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    along = Window.partitionBy(*(group or [F.lit(0)])).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    lifted = parts.withColumn("area", F.col("area") + F.coalesce(F.sum("pos").over(along), F.lit(0)) * F.col("neg"))
    whole = F.sum("pos").cast("double") * F.sum("neg")
    return lifted.groupBy(*group).agg(F.when(whole > 0, F.sum("area") / whole).alias("auc"))


def roc_curve(
    df: DataFrame, group: list[str] = GROUP, drop_intermediate: bool = True, buckets: int | None = None
) -> DataFrame:
    """``(threshold, fpr, tpr)`` from the highest score down, starting at (0, 0). By default points
    on a straight line between their neighbours are left out. The scores are dealt into ``buckets`` ranges (by default as many as
    shuffles have partitions)."""
    return _curve(_cumulative(score_points(df, group), group, buckets), group, drop_intermediate)


def auc(df: DataFrame, group: list[str] = GROUP, buckets: int | None = None) -> DataFrame:
    return _area(score_points(df, group), group, buckets)


def evaluate(df: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """Accuracy, macro F1, F1 of both classes and AUC per group, all from one pass over the predictions."""
    points = score_points(df, group)
    classes = F.array(
        F.struct(F.lit(1).alias("label"), F.col("pos").alias("rows")), F.struct(F.lit(0).alias("label"), F.col("neg").alias("rows"))
    )
    counts = points.select(*group, "prediction", F.inline(classes)).where("rows > 0")
    counts = counts.groupBy(*group, "label", "prediction").agg(F.sum("rows").alias("rows"))
    return _accuracy_f1(counts, group).join(_area(points, group), group, "left")


def roc_table(df: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """The curves with an "name (AUC=…)" label, and the chance diagonal. Both parts come from one
    set of points."""
    points = score_points(df, group)
    name = F.concat_ws(" ", *group)
    label = F.format_string("%s (AUC=%.4f)", name, F.col("auc"))
    curves = _curve(_cumulative(points, group), group, True).join(_area(points, group), group)
    chance = df.sparkSession.createDataFrame(
        [("Random", "Random", None, 0.0, 0.0), ("Random", "Random", None, 1.0, 1.0)],
        "model string, label string, threshold double, fpr double, tpr double",
    )
    return curves.select(
        name.alias("model"), label.alias("label"), "threshold", "fpr", "tpr"
    ).unionByName(chance)


def batch_loss(df: DataFrame, group: list[str]) -> DataFrame:
    """Mean cross-entropy of the true class per group (one batch, say)."""
    p = F.when(F.col("label") == 1, F.col("probability")).otherwise(1 - F.col("probability"))
    return df.groupBy(*group).agg(F.avg(-F.log(F.greatest(p, F.lit(1e-12)))).alias("loss"))


def epoch_loss(losses: DataFrame, group: list[str]) -> DataFrame:
    """Mean of the batch losses per epoch."""
    return losses.groupBy(*group).agg(F.avg("loss").alias("train_loss"))
