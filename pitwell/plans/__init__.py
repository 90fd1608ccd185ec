"""Registered queries: each family of operators applied to the given tables, with its DuckDB SQL."""

from pitwell.plans import allocation, features, learning, portfolio, pricing, sources, structure  # noqa: F401  they register
from pitwell.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
