"""Queries over the given tables, each with the SQL its result must equal."""
