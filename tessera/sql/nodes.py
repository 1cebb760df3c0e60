"""Statements and expressions as parsed.  str() of an expression is its
default output name."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..schema import Column as ColumnDef
from ..schema import Value, show


@dataclass(frozen=True)
class Literal:
    value: Value

    def __str__(self) -> str:
        text = "'" + self.value.replace("'", "''") + "'" if isinstance(self.value, str) else show(self.value)
        return f"Literal({text})"


@dataclass(frozen=True)
class Ref:
    """A column, bare or with a table's name or alias in front."""

    name: str

    def __str__(self) -> str:
        return f"Column({self.name})"


@dataclass(frozen=True)
class Compare:
    op: str
    left: Expr
    right: Expr

    # Operator names in output labels.
    NAMES = {"=": "Eq", "!=": "Ne", "<": "Lt", "<=": "Le", ">": "Gt", ">=": "Ge"}

    def __str__(self) -> str:
        return f"Compare({self.NAMES[self.op]}, {self.left}, {self.right})"


@dataclass(frozen=True)
class Logic:
    op: str
    parts: tuple[Expr, ...]

    def __str__(self) -> str:
        return f"{self.op.capitalize()}({', '.join(map(str, self.parts))})"


@dataclass(frozen=True)
class Aggregate:
    """column is None for COUNT(*)."""

    func: str
    column: str | None

    def __str__(self) -> str:
        return f"{self.func}({self.column or '*'})"


Expr = Literal | Ref | Compare | Logic | Aggregate


def children(e: Expr) -> tuple[Expr, ...]:
    if isinstance(e, Compare):
        return e.left, e.right
    return e.parts if isinstance(e, Logic) else ()


@dataclass(frozen=True)
class TableRef:
    name: str
    alias: str = ""


@dataclass(frozen=True)
class Join:
    table: TableRef
    on: Expr


@dataclass(frozen=True)
class Item:
    expr: Expr
    alias: str = ""


@dataclass(frozen=True)
class Order:
    name: str
    ascending: bool = True


@dataclass(frozen=True)
class Select:
    table: TableRef
    star: bool = False
    items: tuple[Item, ...] = ()
    joins: tuple[Join, ...] = ()
    where: Expr | None = None
    group_by: tuple[str, ...] = ()
    having: Expr | None = None
    order_by: tuple[Order, ...] = ()
    limit: int | None = None


@dataclass(frozen=True)
class Insert:
    table: str
    columns: tuple[str, ...]
    values: tuple[Value, ...]


@dataclass(frozen=True)
class Update:
    table: str
    sets: tuple[tuple[str, Expr], ...]
    where: Expr | None = None


@dataclass(frozen=True)
class Delete:
    table: str
    where: Expr | None = None


@dataclass(frozen=True)
class CreateTable:
    name: str
    columns: tuple[ColumnDef, ...] = field(default_factory=tuple)


@dataclass(frozen=True)
class DropTable:
    name: str
    if_exists: bool = False


@dataclass(frozen=True)
class AddColumn:
    table: str
    column: ColumnDef
    default: Value


@dataclass(frozen=True)
class DropColumn:
    table: str
    column: str


@dataclass(frozen=True)
class Begin:
    pass


@dataclass(frozen=True)
class Commit:
    pass


@dataclass(frozen=True)
class Abort:
    pass


Statement = Select | Insert | Update | Delete | CreateTable | DropTable | AddColumn | DropColumn | Begin | Commit | Abort
