"""From raw reviews to the clean, labelled frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlens.config import BLANK_SUMMARIES
from reviewlens.functions import binary_label, parse_rating, sentiment_class, strip_column, strip_text

MIN_LENGTH = 10

# Types that Spark can update in place in a hash-aggregation buffer.
_FIXED_WIDTH = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType)


def combine_summary(df: DataFrame, strict_nulls: bool = True) -> DataFrame:
    """Prefix the text with its summary, both stripped. Blank and "nan" summaries are ignored.

    A missing text stays null by default. With ``strict_nulls=False`` it becomes the text "nan",
    as when missing values are turned into strings before joining.
    """
    if "summary" not in df.columns:
        return df
    text = strip_column("review_text")
    if not strict_nulls:
        text = F.coalesce(text, F.lit("nan"))
    summary = strip_text(F.col("summary"))
    useful = ~F.lower(summary).isin(*BLANK_SUMMARIES)
    prefix = F.coalesce(F.when(useful, F.concat(summary, F.lit(". "))), F.lit(""))
    return df.withColumn("review_text", F.concat(prefix, text))


def with_rating_and_label(df: DataFrame) -> DataFrame:
    return df.withColumn("rating", parse_rating(F.col("rating"))).withColumn(
        "label", binary_label(F.col("rating"))
    )


def drop_null_text(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["review_text"])


def dedupe_first(df: DataFrame, keys: list[str], order_col: str) -> DataFrame:
    """Keep the first row, by ``order_col``, of every distinct key.

    One shuffle, and each task first reduces its copies to one row, so a text that fills a third
    of the input sends one row per task. Numeric columns are carried one by one, which lets Spark
    hash-aggregate; only string columns need the sorted form with one packed struct.
    """
    rest = [c for c in df.columns if c not in keys]
    fixed = all(isinstance(df.schema[c].dataType, _FIXED_WIDTH) for c in rest)
    if fixed:
        carried = [
            (F.min(c) if c == order_col else F.min_by(c, order_col)).alias(c) for c in rest
        ]
        return df.groupBy(*keys).agg(*carried).select(*df.columns)
    first = F.min_by(F.struct(*[F.col(c) for c in rest]), order_col).alias("_first")
    return df.groupBy(*keys).agg(first).select(*keys, "_first.*").select(*df.columns)


def strip_and_filter_length(df: DataFrame) -> DataFrame:
    """Strip the text and keep texts of more than ten characters (code points)."""
    return df.withColumn("review_text", strip_text(F.col("review_text"))).filter(
        F.length("review_text") > MIN_LENGTH
    )


def clean_reviews(df: DataFrame, strict_nulls: bool = True) -> DataFrame:
    """The whole chain on a canonical frame with ``row_id``. Order matters: the label comes before
    the null drop, and duplicates are found before the final strip. Only the columns used later
    are carried, so the scan is pruned to them and the shuffle stays narrow."""
    present = [c for c in ("row_id", "review_text", "rating", "summary") if c in df.columns]
    rows = df.select(*present)
    if strict_nulls:
        # a null text, and no other, is null when combined: tested first, the filter reaches the scan
        rows = combine_summary(drop_null_text(rows))
    else:
        rows = drop_null_text(combine_summary(rows, strict_nulls=False))
    # The length is carried through the aggregation. A filter on the text itself would be pushed down
    # to the scan, where it would repeat the whole text expression in one oversized method.
    rows = with_rating_and_label(rows).withColumn("_length", F.length(strip_text(F.col("review_text"))))
    rows = dedupe_first(
        rows.select("row_id", "review_text", "rating", "label", "_length"), ["review_text"], "row_id"
    )
    return rows.filter(F.col("_length") > MIN_LENGTH).select(
        "row_id",
        strip_text(F.col("review_text")).alias("review_text"),
        "rating",
        "label",
        sentiment_class(F.col("rating")).alias("sentiment"),
    )


def fill_defaults(df: DataFrame) -> DataFrame:
    return df.fillna({"review_text": "", "rating": 3.0})


def profile(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """Row counts at load and after cleaning, with the share of positive and negative labels."""
    count = F.count(F.lit(1)).alias("rows")
    none = F.lit(None).cast("double")
    loaded = raw.agg(count).select(
        F.lit("loaded").alias("stage"), "rows", none.alias("positive"), none.alias("negative")
    )
    cleaned = clean.agg(count, F.avg("label").alias("positive")).select(
        F.lit("clean").alias("stage"), "rows", "positive", (1 - F.col("positive")).alias("negative")
    )
    return loaded.unionByName(cleaned)
