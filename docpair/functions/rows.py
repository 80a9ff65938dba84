"""Values that are made once in a row and read more than once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once for a row."""
    return F.transform(F.array(value), body)[0]


def held(value: Column) -> Column:
    """A generated column of value. Spark neither copies it into the expressions that read it (within a lambda it would be made
    anew for each entry) nor pushes filters on it below."""
    return F.explode_outer(F.array(value))
