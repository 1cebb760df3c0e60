"""Typed expressions: comparison and three-valued logic.

Types are checked when a statement is bound, on empty tables too: both sides of
a comparison must have one type, and only Booleans have a logic.  Null is of
every type.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import Type, type_of
from ..sql import nodes as N
from ..status import InvalidArgument

#: A column of the input and its type, by the name in the statement.
Resolve = Callable[[str], tuple[Column, Type]]

_COMPARE = {
    "=": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}


def literal(value, kind: Type = Type.NULL) -> Column:
    own = type_of(value)
    kind = kind if own is Type.NULL else own
    return F.lit(value) if kind in (Type.NULL, Type.OPAQUE) else F.lit(value).cast(kind.spark)


def compiled(e: N.Expr, resolve: Resolve) -> tuple[Column, Type]:
    """e as a Column and its type."""
    match e:
        case N.Literal(value):
            return literal(value), type_of(value)
        case N.Ref(name):
            return resolve(name)
        case N.Aggregate():
            return resolve(str(e))
        case N.Compare(op, left, right):
            (a, ta), (b, tb) = compiled(left, resolve), compiled(right, resolve)
            if Type.OPAQUE in (ta, tb):
                raise InvalidArgument("compare type not supported")
            if Type.NULL in (ta, tb):
                return F.lit(None).cast("boolean"), Type.BOOL
            if ta is not tb:
                raise InvalidArgument("compare type mismatch")
            return _COMPARE[op](a, b), Type.BOOL
        case N.Logic(op, parts):
            sides = [condition(p, resolve) for p in parts]
            if op == "not":
                return ~sides[0], Type.BOOL
            return reduce(lambda a, b: a & b if op == "and" else a | b, sides), Type.BOOL
    raise InvalidArgument(f"unsupported expression: {e}")


def condition(e: N.Expr, resolve: Resolve) -> Column:
    """e as a Boolean Column; null counts as unknown."""
    column, kind = compiled(e, resolve)
    if kind is Type.NULL:
        return F.lit(None).cast("boolean")
    if kind is not Type.BOOL:
        raise InvalidArgument("expected boolean expression")
    return column
