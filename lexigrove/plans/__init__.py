"""Registered queries over the driver's tables, and the SQL that checks them."""

from lexigrove.plans.oracles import ORACLE_SQL
from lexigrove.plans.queries import QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
