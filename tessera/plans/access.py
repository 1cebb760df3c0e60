"""Access paths: which of point get, range scan and full scan a predicate is.

Catalyst pushes any of them down to the files; the path names the plan and
decides whether a filter is seen above the scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from ..schema import Column, Type, Value, type_of
from ..sql import nodes as N
from .binding import Binding

_TURNED = {"=": "=", "<": ">", ">": "<", "<=": ">=", ">=": "<="}


@dataclass(frozen=True)
class Access:
    tag: str
    equal: Value = None
    start: Value = None
    end: Value = None


def access(where: N.Expr | None, key: Column | None, binding: Binding) -> Access:
    """A sole comparison of the key with a literal of its type is a path: = a
    point get; >= and < (as seen from the key) a range scan."""
    full = Access("SeqScan")
    if key is None or not isinstance(where, N.Compare) or where.op not in _TURNED:
        return full
    left, op, right = where.left, where.op, where.right
    if isinstance(left, N.Literal) and isinstance(right, N.Ref):
        left, op, right = right, _TURNED[op], left
    if not (isinstance(left, N.Ref) and isinstance(right, N.Literal)) or right.value is None:
        return full
    if not binding.resolve(left.name).column.primary_key or type_of(right.value) is not key.type or key.type is Type.OPAQUE:
        return full
    match op:
        case "=":
            return Access("PkPointGet", equal=right.value)
        case ">=":
            return Access("PkRangeScan", start=right.value)
        case "<":
            return Access("PkRangeScan", end=right.value)
    return full
