"""All registered queries."""

from passagework.plans import (  # noqa: F401
    context_queries,
    corpus_queries,
    evalset_queries,
    flow_queries,
    index_queries,
    model_queries,
    scoring_queries,
    selection_queries,
)
from passagework.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
