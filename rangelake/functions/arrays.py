"""Array expression helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    An outer expression used inside a lambda is evaluated again for every element; bound
    this way it is a lambda variable.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
