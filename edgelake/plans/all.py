"""Every registered query."""

from edgelake.plans import domain, relational, windows  # noqa: F401  they register on import
from edgelake.plans.registry import QUERIES, SQL  # noqa: F401
