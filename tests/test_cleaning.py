import pytest
from pyspark.sql import functions as F

from reviewlens.functions import binary_label, parse_rating, sentiment_class, strip_column, strip_text
from reviewlens.operators import clean
from reviewlens.plans.experiment import load_reviews
from reviewlens.sources import canonicalize, normalize_headers, read_reviews_csv, write_table_csv


def one(df):
    return [r[0] for r in df.collect()]


def test_rating(spark):
    df = spark.createDataFrame([("5.0",), ("4 stars",), ("10",), ("-1",), ("five",), (None,)], "r string")
    assert one(df.select(parse_rating(F.col("r")))) == [5.0, 4.0, 10.0, 1.0, None, None]


def test_label_and_sentiment(spark):
    df = spark.createDataFrame([(0.0,), (2.0,), (3.0,), (4.0,), (None,)], "r double")
    assert one(df.select(binary_label(F.col("r")))) == [0, 0, 0, 1, 0]
    assert one(df.select(sentiment_class(F.col("r")))) == [0, 0, 1, 2, 1]


def test_label_is_sentiment_two(spark, sf):
    from reviewlens.plans.queries import reviews

    rows = reviews(spark, sf).groupBy("label", "sentiment").count().collect()
    assert {(r["label"], r["sentiment"]) for r in rows} <= {(0, 0), (0, 1), (1, 2)}


def test_strip(spark):
    df = spark.createDataFrame([("\t\x1c a b 　\n",), ("a",), ("  ",), (None,)], "t string")
    assert one(df.select(strip_text(F.col("t")))) == ["a b", "a", "", None]
    assert one(df.select(strip_column("t"))) == ["a b", "a", "", None]


@pytest.mark.parametrize(
    "summary, text, strict, loose",
    [
        ("Great", " ok ", "Great. ok", "Great. ok"),
        ("NaN", "ok", "ok", "ok"),
        ("", "ok", "ok", "ok"),
        (None, "ok", "ok", "ok"),
        (" none ", "ok", "ok", "ok"),
        ("Great value", None, None, "Great value. nan"),
        (None, None, None, "nan"),
    ],
)
def test_combine(spark, summary, text, strict, loose):
    df = spark.createDataFrame([(summary, text)], "summary string, review_text string")
    assert one(clean.combine_summary(df).select("review_text")) == [strict]
    assert one(clean.combine_summary(df, strict_nulls=False).select("review_text")) == [loose]


def test_length_counts_code_points(spark):
    texts = [("a" * 10,), ("b" * 11,), ("😀" * 11,), (" " + "c" * 10 + " ",)]
    df = spark.createDataFrame(texts, "review_text string")
    assert one(clean.strip_and_filter_length(df)) == ["b" * 11, "😀" * 11]


@pytest.mark.parametrize("extra", [False, True])  # numeric columns only, and with a string column
def test_first_copy_wins(spark, extra):
    df = spark.createDataFrame([(3, "x", 1.0), (1, "x", None), (2, "x", 2.0), (9, "y", 5.0)], "row_id long, t string, v double")
    if extra:
        df = df.withColumn("s", F.col("row_id").cast("string"))
    rows = clean.dedupe_first(df, ["t"], "row_id").select("row_id", "v").collect()
    assert sorted((r["row_id"], r["v"]) for r in rows) == [(1, None), (9, 5.0)]


def test_hot_text_is_reduced_before_the_shuffle(spark):
    plan = clean.dedupe_first(
        spark.range(10).select(F.col("id").alias("row_id"), F.lit("x").alias("t")), ["t"], "row_id"
    )._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan and plan.count("Exchange") == 1


def test_outer_whitespace_copies_both_stay_without_summary(spark):
    df = spark.createDataFrame(
        [(1, "twelve chars", "5"), (2, " twelve chars", "1")], "row_id long, review_text string, rating string"
    )
    assert clean.clean_reviews(df).count() == 2


def test_alias_collision_and_missing(spark):
    df = spark.createDataFrame(
        [("t", "5", None, "q"), ("u", "4", "p", "q")], "` Text ` string, Stars string, ASIN string, parent_asin string"
    )
    rows = canonicalize(normalize_headers(df)).select("review_text", "rating", "product_id").collect()
    assert [tuple(r) for r in rows] == [("t", "5", "q"), ("u", "4", "p")]
    with pytest.raises(ValueError, match="rating"):
        canonicalize(spark.createDataFrame([("t",)], "review_text string"))


def test_csv_lines(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text(
        'Review Text,overall,Summary,asin\n'
        '"first, with ""quotes""\nand a break",5,nice,A\n'
        "too,many,fields,on,this line\n"
        "short line here,3\n"
        "NA,2,n/a,B\n"
    )
    df = normalize_headers(read_reviews_csv(spark, str(path)))
    rows = [tuple(r) for r in df.collect()]
    assert rows == [
        ('first, with "quotes"\nand a break', "5", "nice", "A"),
        ("short line here", "3", None, None),
        (None, "2", None, "B"),
    ]


def test_load_reviews(spark, tmp_path):
    path = tmp_path / "r.csv"
    lines = [f"this is review number {i},{i % 5 + 1}" for i in range(40)]
    path.write_text("text,stars\n" + "\n".join(lines + lines[:5]) + "\n")
    assert load_reviews(spark, str(path)).count() == 40
    assert load_reviews(spark, str(path), max_rows=7).count() == 7
    assert load_reviews(spark, str(path), max_rows=100).count() == 40


def test_empty_table_is_not_written(spark, tmp_path):
    assert write_table_csv(spark.createDataFrame([], "a int"), str(tmp_path / "t")) is False


def test_row_local_steps_run_on_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, " good text here ", "5", "Nice")], "row_id long, review_text string, rating string, summary string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    out = clean.with_rating_and_label(clean.combine_summary(stream))
    query = out.writeStream.format("memory").queryName("cleaned").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("cleaned").select("review_text", "label").collect() == [("Nice. good text here", 1)]


def test_csv_folder_of_several_layouts(spark, tmp_path):
    """Each file by its own header, in the order of file names whatever their sizes."""
    folder = tmp_path / "with space"
    folder.mkdir()
    (folder / "a.csv").write_text("text,rating\naaa,5\n\"a\nb\",4\n")
    (folder / "b.csv").write_text("\ufeffrating,text,extra\n" + "1,bbb,x\n" * 500, encoding="utf-8")
    (folder / "c.csv").write_text("")
    rows = read_reviews_csv(spark, str(folder), row_id=True).orderBy("row_id").collect()
    assert len(rows) == 502 and len({r["row_id"] for r in rows}) == 502
    assert [(r["text"], r["rating"], r["extra"]) for r in rows[:3]] == [("aaa", "5", None), ("a\nb", "4", None), ("bbb", "1", "x")]
    split = read_reviews_csv(spark, str(folder / "b.csv"), multi_line=False)
    assert split.count() == 500 and split.columns == ["rating", "text", "extra"]


def test_csv_lines_with_too_many_cells(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text('text,rating\na,4,\nb,4,,\n"c,""c""",4\n"d,d",4,\ne\n5" tv,3\n,\nf,1,x\n"g\n,",2\n')
    rows = read_reviews_csv(spark, str(path)).collect()
    assert [tuple(r) for r in rows] == [('c,"c"', "4"), ("e", None), ('5" tv', "3"), (None, None), ("g\n,", "2")]
