"""Queries over the given tables, each registered with the SQL it is held against."""
