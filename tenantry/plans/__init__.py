"""Whole plans: state-changing commands and the registered queries."""

from . import lifecycle, queries, writes  # noqa: F401  all register their queries
