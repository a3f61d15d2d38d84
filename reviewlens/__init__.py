"""Review analytics as Spark jobs: cleaning, sampling, features, models and reports."""

from reviewlens.config import Config

__all__ = ["Config"]
