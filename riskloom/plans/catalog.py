"""Loads every query module and exposes the registry."""

from riskloom.plans import (  # noqa: F401
    eval_queries,
    feature_queries,
    label_queries,
    model_queries,
    source_queries,
    stat_queries,
)
from riskloom.plans.registry import CHECKS, QUERIES  # noqa: F401
