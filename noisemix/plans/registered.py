"""Importing this module registers every query."""

from noisemix.plans import (  # noqa: F401
    io_queries,
    metric_queries,
    mixing_queries,
    noise_queries,
    subword_queries,
    text_queries,
)
from noisemix.plans.catalog import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
