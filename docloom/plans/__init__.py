"""Named queries over the operators, and the SQL they are checked against."""

from docloom.plans import fixtures  # noqa: F401  derived tables come before the queries that name them
from docloom.plans import convert_queries, document_queries, matching_queries, misc_queries, scalar_queries, schema_queries, sequence_queries  # noqa: F401, I001
from docloom.plans.registry import ORACLES, QUERIES  # noqa: F401
