"""All route queries by name, and their SQL; importing the modules registers them."""

from pelorus.plans import queries_files, queries_masks  # noqa: F401
from pelorus.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
