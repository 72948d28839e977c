"""All queries of the text operators."""

from . import decontaminate, discriminant, language, lm, merkle, mixing, pii, quality, repeats, runs, simhash, token_counts, token_files  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
