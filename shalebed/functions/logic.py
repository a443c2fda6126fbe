"""Three-valued logic over arrays of nullable booleans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value evaluated once: a lambda's variable stands for
    it, so nested rules don't repeat their parts.
    """
    return F.get(F.transform(F.array(value), use), 0)


def unknown() -> Column:
    return F.lit(None).cast("boolean")


def _any(results: Column, value: bool) -> Column:
    return F.exists(results, lambda x: F.coalesce(x == F.lit(value), F.lit(False)))


def all_of(results: Column) -> Column:
    """False if any is false, else unknown if any is or none is given, else true."""
    unsure = (F.size(results) == 0) | F.exists(results, lambda x: x.isNull())
    return F.when(_any(results, False), F.lit(False)).when(unsure, unknown()).otherwise(F.lit(True))


def any_of(results: Column) -> Column:
    """True if any is true, else unknown if any is or none is given, else false."""
    unsure = (F.size(results) == 0) | F.exists(results, lambda x: x.isNull())
    return F.when(_any(results, True), F.lit(True)).when(unsure, unknown()).otherwise(F.lit(False))


def combine(results: Column, operator: Column) -> Column:
    return let(results, lambda r: F.when(operator == "AND", all_of(r)).otherwise(any_of(r)))
