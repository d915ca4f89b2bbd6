"""All registered queries and their SQL."""

from corrgrid.plans import chain, imaging, queries, tiled  # noqa: F401  (all register)
from corrgrid.plans.registry import ORACLES as REFERENCE_SQL
from corrgrid.plans.registry import QUERIES as REFERENCE

__all__ = ["REFERENCE", "REFERENCE_SQL"]
