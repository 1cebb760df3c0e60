"""Names of tables and columns in a statement."""

from __future__ import annotations

from dataclasses import dataclass

from ..schema import Column, TableSchema, Type
from ..sql import nodes as N
from ..status import InvalidArgument


@dataclass(frozen=True)
class Bound:
    """A column of a statement: internal name, and where it comes from."""

    internal: str
    column: Column
    table: str

    @property
    def type(self) -> Type:
        return self.column.type


class Binding:
    """The tables of FROM, in order.  Identifiers are case-sensitive."""

    def __init__(self) -> None:
        self.tables: list[tuple[N.TableRef, TableSchema]] = []
        self._names: dict[str, int] = {}

    def add(self, ref: N.TableRef, schema: TableSchema) -> list[str]:
        """Registers a table by name and by alias; its columns' internal names."""
        if not ref.name:
            raise InvalidArgument("empty table name in FROM")
        at = len(self.tables)
        for name in dict.fromkeys(n for n in (ref.name, ref.alias) if n):
            if name in self._names:
                raise InvalidArgument(f"duplicate table name or alias: {name}")
            self._names[name] = at
        self.tables.append((ref, schema))
        return [f"t{at}c{k}" for k in range(len(schema.columns))]

    def _bound(self, table: int, k: int) -> Bound:
        ref, schema = self.tables[table]
        return Bound(f"t{table}c{k}", schema.columns[k], ref.alias or ref.name)

    def resolve(self, name: str) -> Bound:
        table, dot, column = name.partition(".")
        if dot:
            if table not in self._names:
                raise InvalidArgument(f"unknown table: {table}")
            at = self._names[table]
            k = self.tables[at][1].index(column)
            if k < 0:
                raise InvalidArgument(f"unknown column: {name}")
            return self._bound(at, k)
        found = [(t, k) for t, (_, schema) in enumerate(self.tables) if (k := schema.index(name)) >= 0]
        if not found:
            raise InvalidArgument(f"unknown column: {name}")
        if len(found) > 1:
            raise InvalidArgument(f"ambiguous column: {name}")
        return self._bound(*found[0])

    def columns(self) -> list[Bound]:
        return [self._bound(t, k) for t, (_, schema) in enumerate(self.tables) for k in range(len(schema.columns))]

    def label(self, bound: Bound) -> str:
        """The output name of a column: bare, with a table's in front where there are several."""
        return f"{bound.table}.{bound.column.name}" if len(self.tables) > 1 else bound.column.name
