"""Array helpers and small scalar forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def has_any(items: Column) -> Column:
    return F.coalesce(F.size(items), F.lit(0)) > 0


def select_many(items: Column, member: Callable[[Column], Column]) -> Column:
    return F.flatten(F.transform(items, member))


def guarded(x: Column, n: Column) -> Column:
    """x / max(1, n)."""
    return x / F.greatest(F.lit(1.0), n.cast("double"))


def either(cond: Column, yes: Column, no: Column) -> Column:
    return F.when(cond, yes).otherwise(no)


def chunks(items: Column, n: int) -> Column:
    """Consecutive arrays of ``n`` items; the last may be shorter."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), F.lit(n))
    return F.when(F.size(items) == 0, F.array()).otherwise(F.transform(starts, lambda i: F.slice(items, i, F.lit(n))))

