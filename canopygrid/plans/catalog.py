"""All registered queries."""

from canopygrid.plans import pixel_queries, table_queries, vector_queries  # noqa: F401
from canopygrid.plans.registry import ORACLES, QUERIES  # noqa: F401
