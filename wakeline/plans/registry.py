"""All queries of the track engine and the SQL that checks them."""

from __future__ import annotations

from wakeline.plans.queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
