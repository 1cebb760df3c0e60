"""Column types, columns and table schemas."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum
from typing import Any

from pyspark.sql import types as T

from .status import InvalidArgument

Value = int | str | bool | None

INT_MIN, INT_MAX = -(1 << 63), (1 << 63) - 1


class Type(Enum):
    INT = "INT"
    TEXT = "TEXT"
    BOOL = "BOOL"
    NULL = "NULL"
    #: A column of an external table that can be passed on, grouped by and counted, no more.
    OPAQUE = "OPAQUE"

    @property
    def spark(self) -> T.DataType:
        return {Type.INT: T.LongType(), Type.TEXT: T.StringType(), Type.BOOL: T.BooleanType()}[self]


def type_of(value: Value) -> Type:
    if value is None:
        return Type.NULL
    if isinstance(value, bool):
        return Type.BOOL
    if isinstance(value, int):
        return Type.INT
    if isinstance(value, str):
        return Type.TEXT
    raise InvalidArgument(f"unsupported value: {value!r}")


def from_spark(kind: T.DataType) -> Type:
    """Integers are read as 64-bit; types without a counterpart are opaque."""
    if isinstance(kind, T.ByteType | T.ShortType | T.IntegerType | T.LongType):
        return Type.INT
    return {T.StringType: Type.TEXT, T.BooleanType: Type.BOOL}.get(type(kind), Type.OPAQUE)


def show(value: Value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    return str(value)


@dataclass(frozen=True)
class Column:
    """id names the column in files, whatever happens to its neighbours;
    default stands for it in files written before it was added."""

    name: str
    type: Type
    primary_key: bool = False
    id: int = -1
    default: Value = None


@dataclass(frozen=True)
class TableSchema:
    name: str
    columns: tuple[Column, ...] = field(default_factory=tuple)

    def validate(self) -> TableSchema:
        if not self.name:
            raise InvalidArgument("table name is empty")
        if not self.columns:
            raise InvalidArgument("table has no columns")
        seen: set[str] = set()
        for c in self.columns:
            if not c.name:
                raise InvalidArgument("column name is empty")
            if c.name in seen:
                raise InvalidArgument(f"duplicate column: {c.name}")
            if c.type is Type.NULL:
                raise InvalidArgument(f"column type cannot be Null: {c.name}")
            seen.add(c.name)
        if sum(c.primary_key for c in self.columns) != 1:
            raise InvalidArgument("table must have exactly one primary key")
        return self

    def index(self, name: str) -> int:
        return next((k for k, c in enumerate(self.columns) if c.name == name), -1)

    @property
    def key(self) -> Column | None:
        return next((c for c in self.columns if c.primary_key), None)

    @property
    def key_index(self) -> int:
        return next((k for k, c in enumerate(self.columns) if c.primary_key), -1)

    def check_row(self, row: tuple[Value, ...] | list[Value]) -> None:
        if len(row) != len(self.columns):
            raise InvalidArgument("row column count mismatch")
        for value, c in zip(row, self.columns, strict=True):
            if value is None:
                raise InvalidArgument(f"null not allowed in column: {c.name}")
            if type_of(value) is not c.type:
                raise InvalidArgument(f"type mismatch in column: {c.name}")
            if c.type is Type.INT and not INT_MIN <= value <= INT_MAX:
                raise InvalidArgument(f"integer out of range in column: {c.name}")

    def to_json(self) -> dict[str, Any]:
        return {"name": self.name, "columns": [[c.name, c.type.value, c.primary_key, c.id, c.default] for c in self.columns]}

    @classmethod
    def from_json(cls, d: dict[str, Any]) -> TableSchema:
        return cls(d["name"], tuple(Column(n, Type(t), p, i, v) for n, t, p, i, v in d["columns"]))
