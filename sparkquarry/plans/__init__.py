"""The query catalogue: every query by name, with its SQL (None where SQL can't express it)."""

from sparkquarry.plans import company, context, leads, outreach, tables, web  # noqa: F401  (they add their queries)
from sparkquarry.plans.catalogue import QUERIES

__all__ = ["QUERIES"]
