"""Queries over the test tables, each with equivalent SQL where there is any."""

from checks import analytics_checks, model_checks, portfolio_checks  # noqa: F401
from checks.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
