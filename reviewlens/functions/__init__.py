from reviewlens.functions.columns import (
    argmax,
    binary_label,
    fmt_gain,
    fmt_mean_std,
    model_family,
    parse_rating,
    sentiment_class,
    softmax_probability,
    strip_column,
    strip_text,
)
from reviewlens.functions.student_t import t_p_value
from reviewlens.functions.text import ngrams, tokenize, with_terms

__all__ = [
    "argmax", "binary_label", "fmt_gain", "fmt_mean_std", "model_family", "ngrams", "parse_rating",
    "sentiment_class", "softmax_probability", "strip_column", "strip_text", "t_p_value", "tokenize", "with_terms",
]
