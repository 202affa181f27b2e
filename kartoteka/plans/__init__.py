"""Registered queries of the catalog engine and the SQL that checks them."""

from kartoteka.plans import audits, cards, consistency, coverage, forests, labels, parsing, values  # noqa: F401  register their queries
from kartoteka.plans.catalog import FLAGSHIP, ORACLE_SQL, QUERIES

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
