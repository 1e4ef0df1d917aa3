"""The registered queries and their SQL."""

from postlode.plans import extended, further  # noqa: F401  (register their queries)
from postlode.plans.queries import QUERIES, SQL

FLAGSHIP = "dedup_cross_source"

__all__ = ["FLAGSHIP", "QUERIES", "SQL"]
