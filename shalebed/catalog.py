"""The registered queries outside the training-data subpackage."""

from __future__ import annotations

from .plans import corpus_queries, detector_queries, inventory_queries, metric_queries, model_queries, report_queries, review_queries, text_queries

FLAGSHIP = "q_detector_counts"

_PLANS = (text_queries, detector_queries, inventory_queries, corpus_queries, metric_queries, model_queries, report_queries, review_queries)

QUERIES = {name: query for plan in _PLANS for name, query in plan.QUERIES.items()}
SQL = {name: sql for plan in _PLANS for name, sql in plan.SQL.items()}
