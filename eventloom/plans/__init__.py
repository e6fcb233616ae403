"""All registered queries: import this package and read QUERIES and ORACLES."""

from eventloom.plans import event_queries, experiment_queries, model_queries, patch_queries, signal_queries, stream_queries, synthetic_queries  # noqa: F401
from eventloom.plans.registry import ORACLES, QUERIES  # noqa: F401
