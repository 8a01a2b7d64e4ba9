"""Every query of the library, by name, and the SQL that gives the same rows."""

from tallywright.plans import extraction, finance, records, reconciliation, run_results, values  # noqa: F401  (they register their queries)
from tallywright.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
