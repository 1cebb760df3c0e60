"""What a statement gives back, and its text form."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from .functions.aggregates import OVERFLOW
from .schema import Value, show
from .status import InvalidArgument


@dataclass
class QueryResult:
    column_names: list[str] = field(default_factory=list)
    rows: list[tuple[Value, ...]] = field(default_factory=list)
    rows_affected: int = 0
    plan_tag: str = ""


def collected(df: DataFrame) -> list[tuple[Value, ...]]:
    """All rows; a sum beyond 64 bits is the statement's error."""
    try:
        return [tuple(r) for r in df.collect()]
    except Exception as e:
        if OVERFLOW in str(e):
            raise InvalidArgument(OVERFLOW) from None
        raise


def text_of(r: QueryResult) -> str:
    """A boxed table with its plan and row count, or what happened."""
    out = [f"plan: {r.plan_tag}"] if r.plan_tag else []
    if r.rows_affected and not r.rows:
        return "\n".join([*out, f"rows_affected: {r.rows_affected}"]) + "\n"
    if not r.column_names and not r.rows:
        return "\n".join([*out, "ok"]) + "\n"
    cells = [[show(v) for v in row] for row in r.rows]
    widths = [max(len(line[k].encode()) for line in [r.column_names, *cells]) for k in range(len(r.column_names))]
    rule = "+" + "".join("-" * (w + 2) + "+" for w in widths)

    def line(values: list[str]) -> str:
        return "|" + "".join(f" {v}{' ' * (w - len(v.encode()))} |" for v, w in zip(values, widths, strict=True))

    out += [rule, line(r.column_names), rule, *map(line, cells), rule, f"({len(cells)} row{'' if len(cells) == 1 else 's'})"]
    if r.rows_affected:
        out.append(f"rows_affected: {r.rows_affected}")
    return "\n".join(out) + "\n"
