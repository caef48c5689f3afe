"""All registered queries."""

from flowloom.plans import flow_queries, log_queries, rule_queries, source_queries, stream_queries, table_queries  # noqa: F401
from flowloom.plans.registry import ORACLES, QUERIES  # noqa: F401
