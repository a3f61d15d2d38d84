"""Row-local column expressions. All are native, so they stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewlens.config import WHITESPACE


def strip_text(text: Column) -> Column:
    """Remove outer whitespace of any kind (plain ``trim`` removes spaces only). The input is named
    once, so the expression stays small when Catalyst pushes a filter on it through other steps."""
    return F.trim(text, F.lit(WHITESPACE))


def strip_column(name: str) -> Column:
    """The same for a stored column. Trimming a set of characters walks the whole text, so it is
    left to the texts that start or end with one of them."""
    text = F.col(name)
    outer = F.substring(text, 1, 1).isin(*WHITESPACE) | F.substring(text, -1, 1).isin(*WHITESPACE)
    return F.when(outer, strip_text(text)).otherwise(text)


def parse_rating(raw: Column) -> Column:
    """First run of digits as a number; null when there is none. ``4.5`` gives 4."""
    return F.regexp_extract(raw.cast("string"), "([0-9]+)", 1).try_cast("double")


def binary_label(rating: Column, threshold: float = 4.0) -> Column:
    """1 for ratings at or over the threshold, else 0; a missing rating is 0."""
    return F.coalesce(rating >= threshold, F.lit(False)).cast("int")


def sentiment_class(rating: Column) -> Column:
    """0 up to two stars, 1 at three (and when missing), 2 above."""
    filled = F.coalesce(rating, F.lit(3.0))
    return F.when(filled <= 2, 0).when(filled == 3, 1).otherwise(2).cast("int")


def fmt_mean_std(mean: Column, std: Column) -> Column:
    return F.format_string("%.4f ± %.4f", mean, std)


def fmt_gain(gain: Column) -> Column:
    """Signed gain, absolute and in percent."""
    return F.format_string("%+.4f (%+.2f%%)", gain, gain * 100)


def model_family(model: Column) -> Column:
    """Family of a model by its name; the first match wins."""
    return (
        F.when(model.contains("Multi-Task"), "Multi-Task")
        .when(model.contains("Single-Task"), "Single-Task")
        .when(model.contains("Random Forest") | model.contains("Gradient Boosting"), "Tree-Based")
        .otherwise("Classical")
    )


def softmax_probability(logits: Column, index: int = 1) -> Column:
    """Softmax value of one class, shifted by the maximum so that large logits do not overflow."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    return F.exp(F.get(logits, F.lit(index)) - top) / total


def argmax(logits: Column) -> Column:
    """Position of the largest value; the lowest position wins ties."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")
