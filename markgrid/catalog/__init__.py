"""Registered queries: each reads the given tables, or tables derived from them by SQL."""
