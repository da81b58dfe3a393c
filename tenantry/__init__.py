"""Tenantry: tenant-scoped relational queries, integrity rules and state changes on Spark."""
