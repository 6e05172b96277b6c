"""All registered queries."""

from docketflow.plans import queries_alerts, queries_classifier, queries_corpus, queries_feed, queries_files, queries_state, queries_streaming  # noqa: F401
from docketflow.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
