"""Queries over the driver tables, one module a family; each has QUERIES and ORACLES."""
