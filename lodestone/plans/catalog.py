"""All registered queries; importing the modules fills the tables."""

from lodestone.plans import (  # noqa: F401
    graph_queries,
    ingest_queries,
    learning_queries,
    metric_queries,
    policy_queries,
    retrieval_queries,
    statistic_queries,
    text_queries,
)
from lodestone.plans.registry import ORACLE, QUERIES  # noqa: F401
