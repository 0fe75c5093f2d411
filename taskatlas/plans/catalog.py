"""All queries; importing this module fills the registry."""

from taskatlas.plans import (  # noqa: F401
    catalog_ensemble,
    catalog_exposure,
    catalog_runs,
    catalog_sources,
    catalog_streaming,
    catalog_text,
    catalog_vectors,
)
from taskatlas.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
