"""Naming an intermediate value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(c: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, however often and in whatever branch ``body`` names it."""
    return F.get(F.transform(F.array(c), body), F.lit(0))
