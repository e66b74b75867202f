"""Helpers for array expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body``.

    The optimizer may inline an upstream expression into a lambda that mentions it
    once, and the lambda would then compute it again for every element. A lambda
    variable cannot be inlined.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def positions(n: int) -> Column:
    return F.sequence(F.lit(0), F.lit(n - 1))
