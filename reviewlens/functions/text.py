"""Word tokens and n-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Runs of two or more letters, digits or underscores. Java's bare \w is ASCII only.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"


def tokenize(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))


def ngrams(tokens: Column) -> Column:
    """Single tokens followed by pairs of neighbours."""
    pairs = F.greatest(F.size(tokens) - 1, F.lit(0))
    bigrams = F.zip_with(
        F.slice(tokens, F.lit(1), pairs),
        F.slice(tokens, F.lit(2), pairs),
        lambda a, b: F.concat_ws(" ", a, b),
    )
    return F.concat(tokens, bigrams)


def with_terms(df: DataFrame, text: str = "review_text", out: str = "terms") -> DataFrame:
    """Add the unigrams and bigrams of the text. Tokens are a column of their own so that the
    regular expression runs once per row."""
    return (
        df.withColumn("_tokens", tokenize(F.coalesce(F.col(text), F.lit(""))))
        .withColumn(out, ngrams(F.col("_tokens")))
        .drop("_tokens")
    )
