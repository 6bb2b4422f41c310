"""Operators that prepare training text: scoring, rendering, archiving, filtering, joining, packing and scanning.

Nothing outside this package imports it. ``queries`` holds the registered queries and their SQL.
"""
