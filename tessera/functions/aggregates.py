"""COUNT, SUM, AVG, MIN and MAX over 64-bit integers.

A sum is exact: it is added up as a decimal, so only a result beyond 64 bits is
an error, whatever the order of rows and whether ANSI mode is on.  AVG truncates
toward zero.  Of no rows, or of nulls alone, COUNT is 0 and the rest null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import INT_MAX, INT_MIN, Type
from ..status import InvalidArgument

OVERFLOW = "SUM overflow"


def _sum(column: Column) -> Column:
    """Long sums, widened: partial sums of 2**63 long values fit 38 digits."""
    total = F.sum(column.cast("decimal(20,0)"))
    fits = total.between(F.lit(INT_MIN).cast("decimal(20,0)"), F.lit(INT_MAX).cast("decimal(20,0)"))
    return F.when(fits | total.isNull(), total.cast("long")).otherwise(F.raise_error(F.lit(OVERFLOW)).cast("long"))


def aggregate(func: str, column: Column | None, kind: Type = Type.INT) -> Column:
    """column is None for COUNT(*)."""
    if func == "COUNT":
        return F.count(F.lit(1) if column is None else column)
    if kind is not Type.INT:
        raise InvalidArgument("aggregate argument must be Int64")
    match func:
        case "SUM":
            return _sum(column)
        case "AVG":
            return F.when(F.count(column) > 0, _divided(_sum(column), F.count(column)))
        case "MIN":
            return F.min(column)
        case "MAX":
            return F.max(column)
    raise InvalidArgument(f"unknown aggregate: {func}")


def _divided(a: Column, b: Column) -> Column:
    """The whole quotient, toward zero: exact on decimals of 64-bit values."""
    return F.call_function("div", a, F.when(b > 0, b).otherwise(F.lit(1).cast("long")))
