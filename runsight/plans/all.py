"""Imports every query module, which registers its queries."""

from runsight.plans import (  # noqa: F401
    feature_queries, impact_queries, log_queries, model_queries, rootcause_queries, schedule_queries,
    selection_queries,
    stability_queries, suite_queries,
)
