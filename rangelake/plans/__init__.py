"""Registered queries, their SQL equivalents, and composed recipes."""
