"""Transformations over the domain tables: relations, set reconciliation, integrity rules and referential actions."""
