"""Bind an expression to a name inside a larger expression."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    A column that is mentioned several times is copied into the plan each time, and nested
    mentions multiply; a lambda variable stands for it instead.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
