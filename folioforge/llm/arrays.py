"""Column helpers for arrays cut out of long texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    The optimiser would copy an expression into every place, and every turn of a
    lambda, that names it; a lambda's own argument is not copied.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
