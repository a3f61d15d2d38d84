"""Running sums over ranges against plain ones."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from reviewlens.operators import metrics, sampling, scan


@pytest.fixture(params=["16", "3"])
def parts(spark, request):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_running_sums_within_groups(spark, parts):
    rng = random.Random(1)
    rows = [(rng.choice("abc"), i % 2, i * 8 % 1001, rng.randint(0, 4)) for i in range(900)] + [("one", 0, 5, 3)]
    df = spark.createDataFrame(rows, "g string, h int, x long, n int").repartition(5)
    got = scan.running(df, ["g", "h"], [F.desc("x")], ["n"], ["x", "n"]).collect()
    assert len(got) == len(rows)
    by_group = {(r.g, r.h, r["rank"]): r for r in got}
    for key, part in itertools.groupby(sorted(rows, key=lambda r: (r[0], r[1], -r[2])), key=lambda r: r[:2]):
        part, total = list(part), 0
        for i, (_, _, x, n) in enumerate(part):
            r = by_group[(*key, i + 1)]
            total += n
            assert (r.x, r.n, r["rows"], r.run_n, r.all_n) == (x, n, len(part), total, sum(p[3] for p in part))
            assert (r.next_x, r.next_n) == (tuple(part[i + 1][2:]) if i + 1 < len(part) else (None, None))


def test_equal_rows_and_an_empty_table(spark, parts):
    df = spark.range(100).selectExpr("id", "1L AS n", "7L AS x")
    rows = scan.running(df, [], [F.col("x")], ["n"]).collect()
    assert sorted(r["rank"] for r in rows) == sorted(r.run_n for r in rows) == list(range(1, 101))
    assert scan.running(df.limit(0), [], [F.col("x")], ["n"]).collect() == []
    assert [r.row_index for r in sampling.row_index(df, "id").orderBy("id").collect()] == list(range(100))


def test_area_over_many_parts(spark, parts):
    rng = random.Random(2)
    rows = [("m", i % 2, int(p > 0.5), p) for i in range(600) for p in [round(rng.random() * (0.6 + 0.4 * (i % 2)), 2)]]
    df = spark.createDataFrame(rows, "model string, label int, prediction int, probability double")
    pos, neg = [[r[3] for r in rows if r[1] == y] for y in (1, 0)]
    wins = sum((a > b) + (a == b) / 2 for a in pos for b in neg)
    assert metrics.auc(df).first()["auc"] == pytest.approx(wins / len(pos) / len(neg))
    found, plain = metrics.evaluate(df).first(), metrics.accuracy_f1(df).first()
    assert all(found[x] == pytest.approx(plain[x]) for x in plain.asDict())
    curve = metrics.roc_curve(df, drop_intermediate=False).orderBy(F.desc("threshold")).collect()
    assert len(curve) == 1 + len({r[3] for r in rows})
    for r in curve:
        assert r.tpr == pytest.approx(sum(p >= r.threshold for p in pos) / len(pos))
        assert r.fpr == pytest.approx(sum(p >= r.threshold for p in neg) / len(neg))
