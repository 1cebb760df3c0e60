"""A session: statements in, results out, one transaction at a time.

Outside BEGIN ... COMMIT each statement is a transaction.  A failed statement
leaves an open transaction open, without any of the statement's writes.  A
script stops at its first error; what it committed before stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.predicates import compiled, condition
from .plans.access import access
from .plans.binding import Binding
from .plans.select import Plan, plan_select
from .result import QueryResult, collected
from .schema import TableSchema, Type
from .sql import nodes as N
from .sql.parser import parse_script, parse_statement
from .status import InvalidArgument, NotFound
from .store import Database, Transaction


class Session:
    def __init__(self, db: Database, joins: bool = True):
        """joins=False is the strict dialect: INNER JOIN parses and is rejected."""
        self.db, self.joins = db, joins
        self.txn: Transaction | None = None

    def in_transaction(self) -> bool:
        return self.txn is not None

    def execute(self, sql: str) -> QueryResult:
        """Runs a script; the result is that of its last statement."""
        result = QueryResult()
        for statement in parse_script(sql):
            result = self.run(statement)
        return result

    def dataframe(self, sql: str) -> DataFrame:
        """A SELECT as a lazy DataFrame with the output names as columns, for
        results of any size.  Outside a transaction it sees the last commit."""
        statement = parse_statement(sql)
        if not isinstance(statement, N.Select):
            raise InvalidArgument("only SELECT gives a DataFrame")
        return self._plan(statement, self.txn, ordered=False).labelled()

    def run(self, s: N.Statement) -> QueryResult:
        match s:
            case N.Begin():
                if self.txn:
                    raise InvalidArgument("already in a transaction")
                self.txn = self.db.begin()
            case N.Commit() | N.Abort():
                if not self.txn:
                    raise InvalidArgument("not in a transaction")
                txn, self.txn = self.txn, None
                txn.commit() if isinstance(s, N.Commit) else txn.abort()
            case N.CreateTable(name, columns):
                self._outside()
                self.db.create_table(TableSchema(name, columns))
            case N.DropTable(name, if_exists):
                self._outside()
                try:
                    self.db.drop_table(name)
                except NotFound:
                    if not if_exists:
                        raise
            case N.AddColumn(table, column, default):
                self._outside()
                self.db.add_column(table, column, default)
            case N.DropColumn(table, column):
                self._outside()
                self.db.drop_column(table, column)
            case N.Insert():
                return self._within(lambda txn: self._insert(s, txn))
            case N.Update():
                return self._within(lambda txn: self._update(s, txn))
            case N.Delete():
                return self._within(lambda txn: self._delete(s, txn))
            case N.Select():
                return self._within(lambda txn: self._select(s, txn))
        return QueryResult()

    def _outside(self) -> None:
        if self.txn:
            raise InvalidArgument("DDL is not allowed inside a transaction")

    def _within(self, work: Callable[[Transaction], QueryResult]) -> QueryResult:
        if self.txn:
            return work(self.txn)
        txn = self.db.begin()
        try:
            result = work(txn)
            txn.commit()
            return result
        finally:
            if not txn.finished:
                txn.abort()

    # Statements

    def _plan(self, s: N.Select, txn: Transaction | None, ordered: bool) -> Plan:
        read = txn.table if txn else self.db.rows_at
        return plan_select(s, lambda name: (self.db.get_table(name), read(name)), ordered, self.joins)

    def _select(self, s: N.Select, txn: Transaction) -> QueryResult:
        plan = self._plan(s, txn, ordered=True)
        return QueryResult(plan.labels, collected(plan.df), 0, plan.tag)

    def _insert(self, s: N.Insert, txn: Transaction) -> QueryResult:
        schema = self.db.get_table(s.table)
        if not s.columns:
            if len(s.values) != len(schema.columns):
                raise InvalidArgument("INSERT value count does not match table width")
            row = s.values
        else:
            given: dict[str, object] = {}
            for name, value in zip(s.columns, s.values, strict=True):
                if schema.index(name) < 0:
                    raise InvalidArgument(f"unknown column: {name}")
                if name in given:
                    raise InvalidArgument(f"duplicate column in INSERT: {name}")
                given[name] = value
            if missing := [c.name for c in schema.columns if c.name not in given]:
                raise InvalidArgument(f"missing column in INSERT: {missing[0]}")
            row = tuple(given[c.name] for c in schema.columns)
        schema.check_row(row)
        txn.insert(s.table, row)
        return QueryResult(rows_affected=1, plan_tag="Insert")

    def _targets(self, table: str, where: N.Expr | None, txn: Transaction) -> tuple[TableSchema, DataFrame, Callable, str]:
        """The rows that UPDATE or DELETE means; names are bare here."""
        schema, binding = self.db.get_table(table), Binding()
        names = binding.add(N.TableRef(table), schema)

        def resolve(name: str):
            if "." in name:
                raise InvalidArgument(f"unknown column: {name}")
            bound = binding.resolve(name)
            return F.col(bound.internal), bound.type

        df = txn.table(table).toDF(*names)
        tag = access(where, schema.key, binding).tag
        if where is not None:
            df = df.where(condition(where, resolve))
            tag = f"Filter<-{tag}" if tag == "SeqScan" else tag
        return schema, df, resolve, tag

    def _update(self, s: N.Update, txn: Transaction) -> QueryResult:
        schema, df, resolve, tag = self._targets(s.table, s.where, txn)
        columns = {c: F.col(c) for c in df.columns}
        for name, expr in s.sets:
            k = schema.index(name)
            if k < 0:
                raise InvalidArgument(f"unknown column: {name}")
            column, kind = compiled(expr, resolve)
            target = schema.columns[k]
            if kind is Type.NULL:
                raise InvalidArgument(f"null not allowed in column: {name}")
            if kind is not target.type:
                raise InvalidArgument(f"type mismatch in column: {name}")
            columns[df.columns[k]] = column
        key = df.columns[schema.key_index]
        changed = df.select(*(columns[c].alias(c) for c in df.columns), F.col(key).alias("old"))
        if any(schema.columns[schema.index(n)].primary_key for n, _ in s.sets) and changed.where(F.col("old") != F.col(key)).limit(1).count():
            raise InvalidArgument("cannot update primary key")
        for name in (n for n, e in s.sets if _may_be_null(e)):
            if changed.where(F.col(df.columns[schema.index(name)]).isNull()).limit(1).count():
                raise InvalidArgument(f"null not allowed in column: {name}")
        n = txn.write_frame(s.table, changed.drop("old"), tomb=False)
        return QueryResult(rows_affected=n, plan_tag=f"Update<-{tag}")

    def _delete(self, s: N.Delete, txn: Transaction) -> QueryResult:
        _, df, _, tag = self._targets(s.table, s.where, txn)
        n = txn.write_frame(s.table, df, tomb=True)
        return QueryResult(rows_affected=n, plan_tag=f"Delete<-{tag}")


def _may_be_null(e: N.Expr) -> bool:
    """Columns hold no nulls, so only a null literal makes one."""
    return (isinstance(e, N.Literal) and e.value is None) or any(map(_may_be_null, N.children(e)))
