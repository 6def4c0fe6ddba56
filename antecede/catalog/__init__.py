"""All registered queries. Importing the modules fills the registry."""

from antecede.catalog import event_queries, history_queries, market_queries, model_queries, probability_queries, quality_queries, scoring_queries, source_queries  # noqa: F401
from antecede.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
