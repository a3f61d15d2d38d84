from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlens.config import MULTI_TASK, SINGLE_TASK, Config
from reviewlens.models import baselines, net
from reviewlens.models.calibrated_svm import fit_calibrated_svm
from reviewlens.models.naive_bayes import fit_naive_bayes
from reviewlens.operators import features, metrics
from reviewlens.plans.experiment import features_of, run_experiment, run_multi_seed
from reviewlens.storage import materialize

SMALL = baselines.BaselineSettings(
    logistic_iterations=30, svm_iterations=5, forest_trees=10, forest_depth=5, boosting_rounds=3, boosting_depth=3
)
GOOD = ["great", "lovely", "sturdy", "excellent", "perfect", "helpful"]
BAD = ["broken", "awful", "refund", "cheap", "slow", "useless"]


@pytest.fixture(scope="module")
def reviews(spark):
    """Reviews whose words follow the rating, with noise."""
    rng = np.random.default_rng(0)
    rows = []
    for i in range(400):
        rating = float(rng.integers(1, 6))
        lean = {1.0: 0.1, 2.0: 0.2, 3.0: 0.5, 4.0: 0.8, 5.0: 0.9}[rating]
        words = [str(rng.choice(GOOD if rng.random() < lean else BAD)) for _ in range(12)]
        sentiment = 0 if rating <= 2 else 1 if rating == 3 else 2
        rows.append((i, " ".join(words), rating, int(rating >= 4), sentiment))
    df = spark.createDataFrame(rows, "row_id long, review_text string, rating double, label int, sentiment int")
    return materialize(df.repartition(4), "test-reviews")


CONFIG = Config(max_rows=None, batch_size=32, epochs=3, hidden_dim=32, seeds=(1, 2), learning_rate=1e-2)


@pytest.fixture(scope="module")
def data(reviews):
    return features_of(reviews, CONFIG)


def macro_f1(scored):
    return metrics.accuracy_f1(scored.withColumn("model", F.lit("m"))).first()["macro_f1"]


def test_vocabulary_is_train_only(spark):
    train = spark.createDataFrame([(1, "alpha beta"), (2, "alpha beta"), (3, "rare alpha")], "row_id long, review_text string")
    model = features.TfidfModel.fit(train)
    assert model.terms == ["alpha", "alpha beta", "beta"]
    test = spark.createDataFrame([(9, "gamma alpha alpha"), (10, "")], "row_id long, review_text string")
    rows = {r["row_id"]: r for r in model.transform(test).collect()}
    assert rows[9]["indices"] == [0] and rows[9]["values"] == pytest.approx([1.0])
    assert rows[10]["indices"] == [] and rows[10]["values"] == []


def test_term_counts_match_a_plain_count(spark, reviews):
    got = features.term_counts(reviews).groupBy("term").agg(F.sum("tf").alias("n")).collect()
    want: dict[str, int] = {}
    for r in reviews.collect():
        words = r["review_text"].split()
        for t in [*words, *[f"{a} {b}" for a, b in zip(words, words[1:])]]:
            want[t] = want.get(t, 0) + 1
    assert {r["term"]: r["n"] for r in got} == want


def test_features_need_no_shuffle(reviews):
    model = features.TfidfModel(["great", "broken"], [1.0, 1.0], 10)
    plan = features.append_aspects(model.transform(reviews), 2)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_encoding(spark):
    df = spark.createDataFrame([(1, "aa bb aa zz"), (2, ""), (3, "bb " * 50)], "row_id long, review_text string")
    rows = {r["row_id"]: r for r in features.encode_fixed(df, ["aa", "bb"], 8).collect()}
    assert rows[1]["input_ids"] == [2, 4, 5, 4, 1, 3, 0, 0]
    assert rows[1]["attention_mask"] == [1] * 6 + [0, 0]
    assert rows[2]["input_ids"] == [2, 3] + [0] * 6
    assert rows[3]["input_ids"] == [2, 5, 5, 5, 5, 5, 5, 3]


def test_packed_vectors(data):
    d, _, _ = data
    r = d.train.select("indices", "values", "features").first()
    assert list(r["features"].indices) == r["indices"] and list(r["features"].values) == r["values"]
    assert r["features"].size == d.size


def test_linear_models_learn(data):
    d, _, _ = data
    logistic = baselines.fit_logistic(d.train, 50)
    assert macro_f1(logistic.transform(d.train).withColumn("prediction", F.col("prediction").cast("int"))) > 0.7
    assert macro_f1(fit_naive_bayes(d.train, d.size).transform(d.train)) > 0.7
    scored = fit_calibrated_svm(d.train, 3, 10).transform(d.test)
    assert macro_f1(scored) > 0.6
    low, high = scored.agg(F.min("probability"), F.max("probability")).first()
    assert 0 < low < high < 1


def test_attributions_sum_up(data):
    d, _, _ = data
    means = baselines.feature_means(d.train)
    coef = [float(i % 7) - 3 for i in range(d.size)]
    names = [f"f{i}" for i in range(d.size)]
    rows = baselines.linear_attributions(d.test, coef, means, names, 10_000).groupBy("row_id").agg(F.sum("contribution").alias("s"))
    got = {r["row_id"]: r["s"] for r in rows.collect()}
    for r in d.test.collect():
        assert got[r["row_id"]] == pytest.approx(sum(coef[i] * (x - means[i]) for i, x in zip(r["indices"], r["values"])))


def test_gradients_match_finite_differences():
    spec = net.NetSpec(7, (net.SENTIMENT, net.RECOMMEND), (0.5, 1.0), hidden=6)
    rng = np.random.default_rng(1)
    w = {n: x.astype("float64") for n, x in spec.initial(3).items()}
    x = rng.normal(size=(9, 7))
    y = {net.SENTIMENT: rng.integers(0, 3, 9), net.RECOMMEND: rng.integers(0, 2, 9)}
    cw = np.array([2.0, 0.7])
    _, grads = net.loss_and_gradients(spec, w, x, y, cw)
    for name in w:
        flat = w[name].ravel()
        for i in rng.choice(len(flat), min(3, len(flat)), replace=False):
            kept, h = flat[i], 1e-4
            flat[i] = kept + h
            up, _ = net.loss_and_gradients(spec, w, x, y, cw)
            flat[i] = kept - h
            down, _ = net.loss_and_gradients(spec, w, x, y, cw)
            flat[i] = kept
            assert grads[name].ravel()[i] == pytest.approx((up - down) / (2 * h), abs=1e-4)


def test_learning_rate_schedule():
    rates = [net.learning_rate(s, 100, 15, 1.0) for s in range(101)]
    assert rates[0] == 0 and rates[15] == 1 and rates[100] == 0
    assert all(a < b for a, b in zip(rates[:15], rates[1:16])) and all(a > b for a, b in zip(rates[15:], rates[16:]))


def test_the_last_batch_may_be_smaller():
    import pandas as pd

    parts = [pd.DataFrame({"x": range(a, b)}) for a, b in ((0, 5), (5, 6), (6, 23))]
    got = [list(b["x"]) for b in net._batches(iter(parts), 4)]
    assert got == [list(range(i, min(i + 4, 23))) for i in range(0, 23, 4)]
    assert list(net._batches(iter([]), 4)) == []


def test_workers_follow_from_the_row_ids(spark, data):
    d, _, _ = data
    per_row = lambda rows: {r["row_id"]: r["worker"] for r in net.dealt_to_workers(rows, 3).collect()}
    got = per_row(d.train)
    assert got == per_row(d.train.repartition(7)) and set(got.values()) == {0, 1, 2}
    dealt = net.dealt_to_workers(d.train, 3).withColumn("part", F.spark_partition_id())
    assert dealt.select("worker", "part").distinct().count() == 3


def test_same_model_on_any_layout_and_with_few_rows(data):
    d, val, _ = data
    config = replace(CONFIG, epochs=1)
    a, b = (net.train_multi_task(x, val, d.size, 5, config) for x in (d.train, d.train.repartition(7)))
    assert all(np.allclose(a.weights[n], b.weights[n], atol=1e-5) for n in a.weights)
    few = net.train_single_task(d.train.filter("row_id < 20"), val, d.size, 5, config)
    assert len(few.history) == 1


def test_large_weights_are_refused(data):
    d, val, _ = data
    with pytest.raises(ValueError, match="not broadcast"):
        net.train_net(d.train, val, 1_000_000, hidden=256)


def test_net_learns_and_repeats(data):
    # one worker is plain sequential training
    d, val, _ = data
    runs = [net.train_multi_task(d.train, val, d.size, 5, replace(CONFIG, workers=1)) for _ in range(2)]
    assert runs[0].best is not None and macro_f1(runs[0].transform(d.train)) > 0.7
    assert runs[0].history[-1][1] < runs[0].history[0][1]
    a, b = ({r["row_id"]: r["probability"] for r in m.transform(d.test).collect()} for m in runs)
    assert a == pytest.approx(b)


def test_averaged_workers_learn(data):
    # a third of the rows per worker: three to four times the epochs give as many steps as one worker
    d, val, _ = data
    model = net.train_multi_task(d.train, val, d.size, 5, replace(CONFIG, epochs=12, workers=3))
    assert model.best is not None and macro_f1(model.transform(d.train)) > 0.7


def test_average_of_workers_is_weighted_by_rows(spark):
    """Two workers with nothing to learn from but their row counts: the mean loss is weighted, and no row is left out."""
    spec = net.NetSpec(3, (net.RECOMMEND,), (1.0,), hidden=4, dropout=0.0)
    rows = [(i, int(i < 35), 0, [0], [1.0], int(i >= 35)) for i in range(50)]
    schema = "row_id long, label int, sentiment int, indices array<int>, values array<double>, worker int"
    df = spark.createDataFrame(rows, schema)
    state = spec.initial(1)
    state |= {f"{n}/{s}": np.zeros_like(x) for n, x in list(state.items()) for s in "mv"}
    policy = net.Policy(epochs=1, batch_size=8, learning_rate=0.0)
    losses = {}
    for name, part in (("both", df), ("first", df.filter("worker = 0")), ("second", df.filter("worker = 1"))):
        dealt = part.repartitionById(2, F.col("worker"))
        after, losses[name] = net._run_epoch(dealt, state, spec, policy, np.ones(2), 1, 1, {0: 5, 1: 2})
        assert all(np.allclose(after[n], state[n], atol=1e-6) for n in state if "/" not in n)
    assert losses["both"] == pytest.approx((35 * losses["first"] + 15 * losses["second"]) / 50)
    assert losses["first"] != pytest.approx(losses["second"])


def test_net_round_trip(spark, data, tmp_path):
    d, val, _ = data
    model = net.train_single_task(d.train, val, d.size, 5, CONFIG)
    model.save(spark, str(tmp_path / "net"))
    again = net.NetModel.load(spark, str(tmp_path / "net"))
    assert again.spec == model.spec and again.best == model.best
    assert all(np.array_equal(model.weights[n], again.weights[n]) for n in model.weights)


def test_no_rows_to_train(data):
    d, val, _ = data
    with pytest.raises(ValueError, match="no training rows"):
        net.train_single_task(d.train.limit(0), val, d.size, 5, CONFIG)


def test_failed_model_is_reported(data, reviews, monkeypatch):
    d, _, _ = data

    def broken(*_):
        raise RuntimeError("no luck")

    monkeypatch.setattr(baselines, "fit_logistic", broken)
    monkeypatch.setattr(baselines, "fit_calibrated_svm", broken)
    results, roc = baselines.train_and_evaluate(reviews, reviews, settings=SMALL, data=d)
    status = {r["model"]: (r["status"], r["macro_f1"]) for r in results.collect()}
    assert status["Logistic Regression"] == ("failed: no luck", None)
    assert status["Naive Bayes"][0] == "ok" and status["Naive Bayes"][1] > 0.5
    assert {r["model"] for r in roc.select("model").distinct().collect()} == {"Naive Bayes"}


def test_whole_experiment(spark, reviews, tmp_path):
    tables = run_experiment(reviews, CONFIG, str(tmp_path), include_trees=True, settings=SMALL)
    assert tables["baselines"].filter("status = 'ok'").count() == 5
    assert tables["seed_metrics"].count() == 4
    assert {r["model"] for r in tables["summary"].collect()} == {SINGLE_TASK, MULTI_TASK}
    assert tables["gains"].count() == 2 and tables["ttest"].first()["t"] is None
    assert tables["f1_table"].count() == 7 and len(tables["metric_matrix"].columns) == 8
    doc = spark.read.json(str(tmp_path / "multi_seed_results.json")).first()
    assert [r["seed"] for r in doc["single_task_per_seed"]] == [1, 2]
    assert len(doc["multi_task_per_seed"]) == 2 and len(doc["summary"]) == 2
    csv = spark.read.csv(str(tmp_path / "multi_task_per_seed.csv"), header=True)
    assert csv.columns == ["seed", "accuracy", "macro_f1", "f1_pos", "f1_neg", "auc"] and csv.count() == 2
    assert (tmp_path / "models" / "best_multi_task_seed2" / "weights").exists()


def test_weights_are_updated_as_by_plain_formulas():
    """The update in blocks gives the bits of the update of whole tensors."""
    rng = np.random.default_rng(3)
    policy = net.Policy()
    shapes = {"a.w": (net.STEP_BLOCK // 64 + 5, 80), "a.b": (7,)}
    w, m, v = ({n: rng.normal(size=s).astype("float32") for n, s in shapes.items()} for _ in range(3))
    v = {n: np.abs(x) for n, x in v.items()}
    plain = [{n: x.copy() for n, x in part.items()} for part in (w, m, v)]
    for step in range(3):
        g = {n: rng.normal(size=s).astype("float32") for n, s in shapes.items()}
        scale = min(1.0, policy.clip_norm / (np.sqrt(sum(float((x * x).sum()) for x in g.values())) + 1e-6))
        for n in shapes:
            grad = g[n] * float(scale)
            plain[1][n] += 0.1 * (grad - plain[1][n])
            plain[2][n] += 0.001 * (grad * grad - plain[2][n])
            plain[0][n] *= 1 - 1e-3 * policy.weight_decay
            plain[0][n] -= 1e-3 * (plain[1][n] / (1 - 0.9 ** (step + 1))) / (np.sqrt(plain[2][n] / (1 - 0.999 ** (step + 1))) + 1e-8)
        net.adamw_step(w, m, v, g, step, 1e-3, policy)
    assert all(np.array_equal(x[n], y[n]) for x, y in zip((w, m, v), plain) for n in shapes)


def test_networks_train_side_by_side(data, monkeypatch):
    """Several seeds at once, on rows dealt once, give what each gives alone."""
    d, val, _ = data
    dealt, at_work, most = [], [], []
    deal, epoch = net.dealt_to_workers, net._run_epoch

    def watched(*args):
        at_work.append(1)
        most.append(len(at_work))
        try:
            return epoch(*args)
        finally:
            at_work.pop()

    monkeypatch.setattr(net, "_run_epoch", watched)
    monkeypatch.setattr("reviewlens.plans.experiment.dealt_to_workers", lambda *a: dealt.append(1) or deal(*a))
    config = replace(CONFIG, seeds=(5, 6), epochs=1)
    found = run_multi_seed(d, val, config)
    assert len(dealt) == 1 and max(most) > 1
    alone = net.train_multi_task(d.train, val, d.size, 6, config).transform(d.test).select("row_id", "probability")
    both = found.predictions.where(f"model = '{MULTI_TASK}' AND seed = 6").select("row_id", "probability")
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, alone.collect()))
    assert found.seed_metrics.count() == 4
