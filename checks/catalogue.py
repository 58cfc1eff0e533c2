"""All registered queries."""

from checks import alert_queries, feature_queries, model_queries, packet_queries, rule_queries, stream_queries  # noqa: F401
from checks.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
