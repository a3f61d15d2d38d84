"""Settings and fixed values shared by all modules."""

from __future__ import annotations

from dataclasses import dataclass

# ---- fixed values: header aliases (after strip + lower) -> canonical column ----
ALIASES: dict[str, str] = {
    "reviewtext": "review_text",
    "review_text": "review_text",
    "text": "review_text",
    "body": "review_text",
    "overall": "rating",
    "rating": "rating",
    "stars": "rating",
    "summary": "summary",
    "verified": "verified_purchase",
    "verified_purchase": "verified_purchase",
    "vote": "helpful_votes",
    "helpful_votes": "helpful_votes",
    "helpful_vote": "helpful_votes",
    "asin": "product_id",
    "parent_asin": "product_id",
    "reviewerid": "reviewer_id",
    "review text": "review_text",
    "review title": "summary",
}
REQUIRED_COLUMNS = ("review_text", "rating")

# ---- fixed values: aspect lexicon, matched as substrings of the lowered text ----
LEXICON: dict[str, list[str]] = {
    "quality": ["quality", "build", "material", "defect", "broken", "damage", "excellent"],
    "price": ["price", "cost", "value", "worth", "expensive", "cheap", "deal"],
    "shipping": ["shipping", "delivery", "arrived", "packaging", "late", "fast"],
    "durability": ["durable", "durability", "last", "sturdy", "wear", "tear"],
    "design": ["design", "look", "style", "color", "size", "fit", "aesthetic"],
    "service": ["service", "support", "customer", "refund", "return", "helpful"],
}

# ---- fixed values: CSV cells that pandas reads as missing ----
CSV_NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# ---- fixed values: summaries that count as blank (lowered) ----
BLANK_SUMMARIES = ("nan", "none", "")

# ---- fixed values: the characters removed by a Python ``str.strip()`` ----
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

SINGLE_TASK = "Single-Task Net"
MULTI_TASK = "Multi-Task Net"


@dataclass(frozen=True)
class Config:
    """One experiment. Defaults are the reference values; the learning rate is the exception:
    the networks here start from random weights, so they need a larger step."""

    max_rows: int | None = None
    test_size: float = 0.20
    val_size: float = 0.10
    max_features: int = 5_000
    min_df: int = 2
    epochs: int = 5
    batch_size: int = 128
    max_length: int = 256
    max_tokens: int = 50_000  # of the vocabulary for fixed-length encoding
    learning_rate: float = 1e-3
    weight_decay: float = 0.01
    warmup_ratio: float = 0.15
    clip_norm: float = 1.0
    dropout: float = 0.4
    workers: int = 4  # shards of a network's training rows, each trained by one task: raise it with the data, not with the cluster
    hidden_dim: int = 256
    sentiment_weight: float = 0.5
    recommend_weight: float = 1.0
    seeds: tuple[int, ...] = (42, 123, 456, 789, 1024)
