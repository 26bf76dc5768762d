"""Imports every query module, so that the registry is complete."""

from cryoframe.plans import (  # noqa: F401
    base,
    q_fields,
    q_models,
    q_predicates,
    q_products,
    q_scalars,
    q_sources,
    q_spatial,
    q_stats,
)

QUERIES = base.QUERIES
ORACLE = base.ORACLE
