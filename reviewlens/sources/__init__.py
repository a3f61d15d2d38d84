from reviewlens.sources.reviews import (
    canonicalize,
    normalize_headers,
    read_reviews_csv,
    reviews_from_fixture,
)
from reviewlens.sources.sinks import results_document, write_results_json, write_table_csv

__all__ = [
    "canonicalize", "normalize_headers", "read_reviews_csv", "results_document",
    "reviews_from_fixture", "write_results_json", "write_table_csv",
]
