import math
import random

import pytest
from pyspark.sql import functions as F

from reviewlens.config import MULTI_TASK, SINGLE_TASK
from reviewlens.functions import argmax, softmax_probability, t_p_value
from reviewlens.operators import metrics, report, statistics


def predictions(spark, rows):
    return spark.createDataFrame(rows, "model string, label int, prediction int, probability double")


def noisy(n, seed, digits):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        y = int(rng.random() < 0.3)
        p = round(min(0.999999, max(0.0, rng.gauss(0.4 + 0.2 * y, 0.2))), digits)
        out.append(("m", y, int(p >= 0.5), p))
    return out


@pytest.mark.parametrize("digits", [1, 6])
def test_auc_is_the_rank_statistic(spark, digits):
    data = noisy(400, 1, digits)
    pos = [p for _, y, _, p in data if y]
    neg = [p for _, y, _, p in data if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    for buckets in (2, 7, 1024):
        got = metrics.auc(predictions(spark, data), buckets=buckets).first()["auc"]
        assert got == pytest.approx(want, abs=1e-12)


def test_roc_by_hand(spark):
    data = [("m", 1, 1, 0.9), ("m", 1, 1, 0.8), ("m", 0, 1, 0.8), ("m", 0, 0, 0.3), ("m", 0, 0, 0.2)]
    full = metrics.roc_curve(predictions(spark, data), drop_intermediate=False, buckets=3).collect()
    got = sorted((r["fpr"], r["tpr"]) for r in full)
    third = 1 / 3
    assert [x for x, _ in got] == pytest.approx([0, 0, third, 2 * third, 1])
    assert [y for _, y in got] == pytest.approx([0, 0.5, 1, 1, 1])
    reduced = metrics.roc_curve(predictions(spark, data), buckets=3).collect()
    assert len(reduced) == 4 and all(r["fpr"] != 2 * third for r in reduced)
    assert max(r["threshold"] for r in reduced) == math.inf


def test_roc_with_saturated_scores(spark):
    rng = random.Random(2)
    data = [("m", int(rng.random() < 0.5), 0, rng.random() * 1e-30 if rng.random() < 0.5 else 1.0) for _ in range(300)]
    small = metrics.auc(predictions(spark, data), buckets=2).first()["auc"]
    assert small == pytest.approx(metrics.auc(predictions(spark, data), buckets=64).first()["auc"], abs=1e-12)


def test_one_class_only_has_no_auc(spark):
    assert metrics.auc(predictions(spark, [("m", 1, 1, 0.9), ("m", 1, 0, 0.1)])).first()["auc"] is None


def test_class_never_predicted(spark):
    row = metrics.accuracy_f1(predictions(spark, [("m", 1, 1, 0.9), ("m", 1, 1, 0.8), ("m", 0, 1, 0.7)])).first()
    assert row["f1_neg"] == 0 and row["f1_pos"] == pytest.approx(0.8)
    assert row["macro_f1"] == pytest.approx(0.4) and row["accuracy"] == pytest.approx(2 / 3)


def test_macro_f1_is_the_same_with_classes_swapped(spark):
    df = predictions(spark, noisy(200, 3, 2))
    swapped = df.withColumn("label", 1 - F.col("label")).withColumn("prediction", 1 - F.col("prediction"))
    a, b = (metrics.accuracy_f1(x).first() for x in (df, swapped))
    assert a["macro_f1"] == pytest.approx(b["macro_f1"]) and a["f1_pos"] == pytest.approx(b["f1_neg"])


def test_softmax_and_argmax(spark):
    df = spark.createDataFrame([([1.0, 3.0],), ([800.0, 800.0],), ([-900.0, 0.0, 0.0],)], "l array<double>")
    rows = df.select(softmax_probability(F.col("l")), argmax(F.col("l"))).collect()
    assert [r[1] for r in rows] == [1, 0, 1]
    assert [r[0] for r in rows] == pytest.approx([1 / (1 + math.exp(-2)), 0.5, 0.5])


def _t_tail(t, nu, steps=200_000):
    """Two-sided tail by the trapezoid rule on [0, |t|]."""
    c = math.exp(math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2)) / math.sqrt(nu * math.pi)
    h = abs(t) / steps
    f = [c * (1 + (i * h) ** 2 / nu) ** (-(nu + 1) / 2) for i in range(steps + 1)]
    return 1 - 2 * h * (sum(f) - (f[0] + f[-1]) / 2)


@pytest.mark.parametrize("t, nu", [(4.06, 4), (0.5, 1), (2.0, 2), (-1.7, 3), (2.5, 9), (1.96, 200), (0.0, 5)])
def test_t_p_value(spark, t, nu):
    got = spark.range(1).select(t_p_value(F.lit(t), F.lit(nu))).first()[0]
    assert got == pytest.approx(_t_tail(t, nu), abs=1e-8)


def test_t_p_value_far_and_published(spark):
    far = spark.range(1).select(t_p_value(F.lit(1.959964), F.lit(10**6))).first()[0]
    assert far == pytest.approx(0.05, abs=1e-5)
    assert round(spark.range(1).select(t_p_value(F.lit(4.06), F.lit(4))).first()[0], 4) == 0.0153


def test_t_p_value_has_no_switch(spark):
    p = lambda t, nu: spark.range(1).select(t_p_value(F.lit(t), F.lit(nu))).first()[0]
    assert p(1.5, 19_999) == pytest.approx(p(1.5, 20_001), abs=1e-8)
    assert p(1.5, 3_000_000_000) == pytest.approx(math.erfc(1.5 / math.sqrt(2)), abs=1e-8)
    assert 0 < p(15.0, 50) < p(12.0, 50) < 1e-15
    assert p(15.0, 1) == pytest.approx(1 - 2 / math.pi * math.atan(15), rel=1e-8)
    assert p(0.0, 3_000_000_000) == pytest.approx(1)


def test_ttest_needs_three_values_and_variance(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 1.0), ("b", 1.0), ("b", 1.0)], "g string, v double")
    assert all(r["t"] is None and r["p_value"] is None for r in statistics.ttest_1samp(df, "v", ["g"]).collect())


def test_deviations_differ_on_purpose(spark):
    gains = spark.createDataFrame([(1, 0.1), (2, 0.3)], "seed int, gain double")
    assert statistics.gain_summary(gains).first()["std"] == pytest.approx(0.1)
    rows = [(SINGLE_TASK, s, v, v, v, v, v) for s, v in ((1, 0.1), (2, 0.3))]
    df = spark.createDataFrame(rows, "model string, seed int, accuracy double, macro_f1 double, f1_pos double, f1_neg double, auc double")
    assert statistics.seed_summary(df).first()["accuracy"] == "0.2000 ± 0.1414"
    assert statistics.seed_summary(df.limit(1)).first()["auc"] == "0.1000 ± nan"


def test_best_epoch(spark):
    rows = [("m", 1, 1, 0.5), ("m", 1, 2, 0.7), ("m", 1, 3, 0.7), ("m", 2, 1, 0.0), ("m", 2, 2, 0.0)]
    df = spark.createDataFrame(rows, "model string, seed int, epoch int, val_f1 double")
    assert [(r["seed"], r["epoch"]) for r in statistics.best_epoch(df).collect()] == [(1, 2)]


def test_f1_table_order(spark):
    df = spark.createDataFrame([("Naive Bayes", 0.5), (MULTI_TASK, 0.9), ("Random Forest", 0.5)], "model string, macro_f1 double")
    rows = report.f1_table(df).collect()
    assert [r["model"] for r in rows] == [MULTI_TASK, "Naive Bayes", "Random Forest"]
    assert [r["family"] for r in rows] == ["Multi-Task", "Classical", "Tree-Based"]


def test_plans_have_no_python_and_no_single_partition_sort(spark):
    df = predictions(spark, noisy(50, 5, 2)).cache()
    plan = metrics.roc_curve(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan.split("InMemoryRelation")[0] and "SinglePartition" not in plan
