"""The axis of a series: what it is partitioned and ordered by, and the windows over it.

Operators skip missing observations. Rows whose value is missing stand in a partition of their own (`valid`), so frames,
lag and row numbers over the rest count observations only; results of such rows are null again. All operators over one
value and axis share one exchange and sort.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

FIRST, LAST = -sys.maxsize, sys.maxsize


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean(x: str | Column) -> Column:
    """As double, NaN as null: the one kind of missing value that operators know."""
    x = col(x).cast("double")
    return F.when(~F.isnan(x), x)


@dataclass(frozen=True)
class Axis:
    by: tuple[str, ...]
    order: tuple[str, ...]

    def __init__(self, by: str | list[str] | tuple, order: str | list[str] | tuple) -> None:
        object.__setattr__(self, "by", (by,) if isinstance(by, str) else tuple(by))
        object.__setattr__(self, "order", (order,) if isinstance(order, str) else tuple(order))

    def rows(self, backward: bool = False) -> WindowSpec:
        """All rows of a series."""
        return Window.partitionBy(*self.by).orderBy(*(F.desc(o) if backward else F.asc(o) for o in self.order))

    def valid(self, v: str | Column, backward: bool = False) -> WindowSpec:
        """Rows of a series that have a value (and, apart, those that have none)."""
        return Window.partitionBy(*self.by, col(v).isNull()).orderBy(*(F.desc(o) if backward else F.asc(o) for o in self.order))

    def upto(self, v: str | Column) -> WindowSpec:
        return self.valid(v).rowsBetween(FIRST, 0)

    def last(self, v: str | Column, n: int) -> WindowSpec:
        return self.valid(v).rowsBetween(-(n - 1), 0)


def where_valid(v: str | Column, result: Column) -> Column:
    return F.when(col(v).isNotNull(), result)


def over_valid(v: str | Column, axis: Axis, n: int, result: Column) -> Column:
    """A result over the last n observations, null until there are n."""
    return F.when(col(v).isNotNull() & (F.row_number().over(axis.valid(v)) >= n), result)


def positive(n: int) -> int:
    if n < 1:
        raise ValueError("n must be 1 or more")
    return n
