"""Named queries: the operators applied to the shared Parquet tables, each with its SQL twin."""

from fieldledger.plans import files, models, papers, policy, prices, rollups, survey, survey_tables  # noqa: F401  (registration)
from fieldledger.plans.registry import REGISTRY, Query

__all__ = ["REGISTRY", "Query"]
