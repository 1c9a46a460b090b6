"""Evaluate an expression once and use it several times inside another."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row.

    A column defined by ``withColumn`` and used inside a lambda is inlined by the
    optimizer and then recomputed for every array element. A lambda variable is not.
    """
    return F.transform(F.array(value), body)[0]
