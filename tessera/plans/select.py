"""SELECT as a DataFrame.

Order of operators: access, joins and filter; aggregate, HAVING; projection;
sort; limit.  Where rows come out in an order that the statement doesn't fix,
that of the key is taken if it matters: for LIMIT without ORDER BY, for ties of
a sort, and for whole results where the caller asks for it.  Groups then come in
the order of their least key.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import aggregate
from ..functions.predicates import compiled, condition
from ..operators import relational as R
from ..schema import TableSchema, Type
from ..sql import nodes as N
from ..status import InvalidArgument
from .access import access
from .binding import Binding

#: A table's schema and its rows, columns in schema order.
Tables = Callable[[str], tuple[TableSchema, DataFrame]]


@dataclass
class Plan:
    """df has internal names o0, o1, ... for the labels, in order."""

    df: DataFrame
    labels: list[str]
    tag: str

    def labelled(self) -> DataFrame:
        return self.df.toDF(*self.labels)


@dataclass
class _Output:
    label: str
    column: SparkColumn
    #: internal name of the column that this output is, if it has no alias;
    #: ORDER BY may then mean it by any of the column's names
    origin: str = ""


def plan_select(s: N.Select, tables: Tables, ordered: bool = False, joins: bool = True) -> Plan:
    """joins=False rejects joins, as a strict single-table dialect does."""
    if s.joins and not joins:
        raise InvalidArgument("joins are not supported")
    binding = Binding()
    has_agg = any(isinstance(i.expr, N.Aggregate) for i in s.items)
    grouped = has_agg or bool(s.group_by)
    schema, rows = tables(s.table.name)
    df = R.seq_scan(rows, binding.add(s.table, schema))
    if s.star and grouped:
        raise InvalidArgument("SELECT * cannot be combined with aggregates or GROUP BY")
    if s.having is not None and not grouped:
        raise InvalidArgument("HAVING requires aggregates or GROUP BY")

    def resolve(name: str) -> tuple[SparkColumn, Type]:
        bound = binding.resolve(name)
        return F.col(bound.internal), bound.type

    for join in s.joins:
        other, rows = tables(join.table.name)
        right = R.seq_scan(rows, binding.add(join.table, other))
        df = R.inner_join(df, right, condition(join.on, resolve))
    keys = [f"t{t}c{schema.key_index}" for t, (_, schema) in enumerate(binding.tables) if schema.key]
    keys = keys if len(keys) == len(binding.tables) else []

    path = access(s.where, binding.tables[0][1].key, binding) if not s.joins else None
    tag = path.tag if path else "Join<-SeqScan"
    if s.where is not None:
        # The comparison of a path is the same filter; Catalyst pushes it down.
        df = R.filtered(df, condition(s.where, resolve))
        if tag in ("SeqScan", "Join<-SeqScan"):
            tag = f"Filter<-{tag}"

    if grouped:
        df, outputs, tag, hidden = _grouped(s, df, binding, resolve, keys if ordered or s.limit is not None else [], tag)
    else:
        outputs, hidden = _plain(s, binding, resolve), keys
        tag = tag if s.star else f"Project<-{tag}"

    sort = [(_ordering(o, outputs, binding), o.ascending) for o in s.order_by]
    wanted = [(f"o{k}", up) for k, up in sort]
    ties = hidden if sort or s.limit is not None or ordered else []
    columns = [(f"o{k}", o.column) for k, o in enumerate(outputs)] + [(f"h{k}", F.col(n)) for k, n in enumerate(ties)]
    df = R.projected(df, columns)
    if wanted or ties:
        df = R.ordered(df, wanted + [(f"h{k}", True) for k in range(len(ties))])
    if sort:
        tag = f"Sort<-{tag}"
    if s.limit is not None:
        df, tag = R.limited(df, s.limit), f"Limit<-{tag}"
    return Plan(df.select(*(f"o{k}" for k in range(len(outputs)))), [o.label for o in outputs], tag)


def _plain(s: N.Select, binding: Binding, resolve) -> list[_Output]:
    if s.star:
        return [_Output(binding.label(b), F.col(b.internal), b.internal) for b in binding.columns()]
    out = []
    for item in s.items:
        column, _ = compiled(item.expr, resolve)
        if item.alias:
            out.append(_Output(item.alias, column))
        elif isinstance(item.expr, N.Ref):
            bound = binding.resolve(item.expr.name)
            out.append(_Output(bound.column.name, column, bound.internal))
        else:
            out.append(_Output(str(item.expr), column))
    return out


def _grouped(s: N.Select, df: DataFrame, binding: Binding, resolve, keys: list[str], tag: str):
    """df after aggregation and HAVING, outputs, tag and hidden order columns."""
    group = [binding.resolve(name) for name in s.group_by]
    internals = [b.internal for b in group]
    for k, b in enumerate(group):
        if b.internal in internals[:k]:
            raise InvalidArgument(f"duplicate column: {b.column.name}")
    aggregates: dict[str, SparkColumn] = {}

    def named(a: N.Aggregate) -> tuple[str, str]:
        """Internal name and label; SUM(u.x) and SUM(x) are one accumulator."""
        if a.column is None:
            internal, label, column, kind = "a:*", "COUNT(*)", None, Type.INT
        else:
            bound = binding.resolve(a.column)
            internal, label = f"a:{a.func}:{bound.internal}", f"{a.func}({bound.column.name})"
            column, kind = F.col(bound.internal), bound.type
        if internal not in aggregates:
            aggregates[internal] = aggregate(a.func, column, kind)
        return internal, label

    outputs = []
    for item in s.items:
        if isinstance(item.expr, N.Aggregate):
            internal, label = named(item.expr)
            outputs.append(_Output(item.alias or label, F.col(f"`{internal}`")))
            continue
        if not isinstance(item.expr, N.Ref):
            raise InvalidArgument("SELECT with aggregates requires GROUP BY columns or aggregates")
        bound = binding.resolve(item.expr.name)
        if bound.internal not in internals:
            raise InvalidArgument(f"column must appear in GROUP BY: {item.expr.name}")
        outputs.append(_Output(item.alias or bound.column.name, F.col(bound.internal), "" if item.alias else bound.internal))

    def after(name: str) -> tuple[SparkColumn, Type]:
        """A name in HAVING: a group column."""
        try:
            bound = binding.resolve(name)
        except InvalidArgument:
            bound = None
        if bound is None or bound.internal not in internals:
            raise InvalidArgument(f"HAVING column must be a GROUP BY column or aggregate (use COUNT(*)/SUM(col), not SELECT aliases): {name}")
        return F.col(bound.internal), bound.type

    def after_any(e: N.Expr):
        """Registers the aggregates that HAVING adds."""
        if isinstance(e, N.Aggregate):
            named(e)
        for part in N.children(e):
            after_any(part)

    by_text: dict[str, str] = {}
    if s.having is not None:
        after_any(s.having)

        def texts(e: N.Expr) -> None:
            if isinstance(e, N.Aggregate):
                by_text[str(e)] = named(e)[0]
            for part in N.children(e):
                texts(part)

        texts(s.having)
    hidden = [f"m{k}" for k in range(len(keys))] if internals else []
    outs = list(aggregates.items()) + [(h, F.min(n)) for h, n in zip(hidden, keys, strict=False)]
    df, tag = R.hash_aggregate(df, internals, outs), f"HashAggregate<-{tag}"
    if s.having is not None:
        found = lambda name: (F.col(f"`{by_text[name]}`"), Type.INT) if name in by_text else after(name)
        df, tag = R.filtered(df, condition(s.having, found)), f"Filter<-{tag}"
    return df, outputs, f"Project<-{tag}", hidden


def _ordering(o: N.Order, outputs: list[_Output], binding: Binding) -> int:
    """The output that an ORDER BY name means: by label; else, for columns
    without alias, by the column."""
    for k, out in enumerate(outputs):
        if out.label == o.name:
            return k
    try:
        origin = binding.resolve(o.name).internal
    except InvalidArgument:
        origin = None
    for k, out in enumerate(outputs):
        if out.origin == origin:
            return k
    raise InvalidArgument(f"unknown ORDER BY column: {o.name}")
