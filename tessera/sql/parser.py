"""From text to statements: a regular-expression scanner and a recursive parser.

Keywords are reserved and of any case; identifiers keep their case.  A
character that starts no token is an error wherever it stands.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..schema import INT_MAX, INT_MIN, Column, Type, Value
from ..status import InvalidArgument
from . import nodes as N

# The reserved words of the dialect.
KEYWORDS = frozenset(
    """ABORT ADD ALTER AND AS ASC AVG BEGIN BOOL BOOLEAN BY COLUMN COMMIT COUNT CREATE CROSS DEFAULT DELETE DESC
    DISTINCT DROP EXCEPT EXISTS FALSE FROM FULL GROUP HAVING IF INNER INSERT INT INTEGER INTERSECT INTO JOIN KEY LEFT
    LIMIT MAX MIN NOT NULL ON OR ORDER OUTER PRIMARY RIGHT ROLLBACK SELECT SET STRING SUM TABLE TEXT TRANSACTION TRUE
    UNION UPDATE VALUES WHERE""".split()
)
TYPES = {"INT": Type.INT, "INTEGER": Type.INT, "TEXT": Type.TEXT, "STRING": Type.TEXT, "BOOL": Type.BOOL, "BOOLEAN": Type.BOOL}
AGGREGATES = ("COUNT", "SUM", "AVG", "MIN", "MAX")
SET_OPERATIONS = ("UNION", "INTERSECT", "EXCEPT")

_TOKEN = re.compile(
    r"(?P<space>[ \t\r\n\f\v]+)|(?P<word>[A-Za-z_][A-Za-z0-9_]*)|(?P<number>-?[0-9]+)"
    r"|(?P<string>'(?:[^']|'')*')|(?P<symbol><=|>=|<>|!=|[=<>(),;.*])"
)


@dataclass(frozen=True)
class Token:
    """kind: a keyword, a symbol, or one of identifier, integer, string, end."""

    kind: str
    at: int
    value: Value = None

    def __str__(self) -> str:
        return "end of input" if self.kind == "end" else str(self.value)


def scan(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            said = "unterminated string literal" if text[at] == "'" else "unexpected '!'" if text[at] == "!" else f"unexpected character '{text[at]}'"
            raise _error(at, said)
        word = m.group()
        if m.lastgroup == "word":
            upper = word.upper()
            out.append(Token(upper, at, word) if upper in KEYWORDS else Token("identifier", at, word))
        elif m.lastgroup == "number":
            if not INT_MIN <= int(word) <= INT_MAX:
                raise _error(at, "integer out of range")
            out.append(Token("integer", at, int(word)))
        elif m.lastgroup == "string":
            out.append(Token("string", at, word[1:-1].replace("''", "'")))
        elif m.lastgroup == "symbol":
            out.append(Token("!=" if word == "<>" else word, at, word))
        at = m.end()
    return [*out, Token("end", len(text))]


def _error(at: int, message: str) -> InvalidArgument:
    return InvalidArgument(f"SQL parse error at offset {at}: {message}")


class Parser:
    def __init__(self, text: str):
        self.tokens, self.k = scan(text), 0

    @property
    def now(self) -> Token:
        return self.tokens[self.k]

    def fail(self, message: str) -> InvalidArgument:
        return _error(self.now.at, message)

    def take(self, *kinds: str) -> Token | None:
        if self.now.kind in kinds:
            self.k += 1
            return self.tokens[self.k - 1]
        return None

    def need(self, kind: str, said: str = "") -> Token:
        if token := self.take(kind):
            return token
        raise self.fail(f"expected {said or kind}, got {self.now}")

    def name(self) -> str:
        return self.need("identifier").value

    def listed(self, one) -> tuple:
        out = [one()]
        while self.take(","):
            out.append(one())
        return tuple(out)

    # Scripts and statements

    def script(self) -> list[N.Statement]:
        out = []
        while True:
            while self.take(";"):
                pass
            if self.now.kind == "end":
                return out
            out.append(self.statement())
            if self.now.kind not in (";", "end"):
                raise self.fail(f"expected ';' between statements, got {self.now}")

    def statement(self) -> N.Statement:
        start = self.take("SELECT", "INSERT", "UPDATE", "DELETE", "CREATE", "DROP", "ALTER", "BEGIN", "COMMIT", "ABORT", "ROLLBACK")
        if not start:
            if self.now.kind in SET_OPERATIONS:
                raise self.fail("set operations are not supported")
            raise self.fail(f"unexpected token {self.now} at start of statement")
        match start.kind:
            case "SELECT":
                return self.select()
            case "INSERT":
                return self.insert()
            case "UPDATE":
                return self.update()
            case "DELETE":
                self.need("FROM")
                return N.Delete(self.name(), self.where())
            case "CREATE":
                return self.create()
            case "DROP":
                self.need("TABLE")
                exists = bool(self.take("IF") and self.need("EXISTS"))
                return N.DropTable(self.name(), exists)
            case "ALTER":
                return self.alter()
        self.take("TRANSACTION")
        return {"BEGIN": N.Begin, "COMMIT": N.Commit}.get(start.kind, N.Abort)()

    def create(self) -> N.CreateTable:
        self.need("TABLE")
        name = self.name()
        self.need("(")
        columns = self.listed(self.column)
        self.need(")")
        if sum(c.primary_key for c in columns) != 1:
            raise self.fail("CREATE TABLE requires exactly one PRIMARY KEY column")
        return N.CreateTable(name, columns)

    def column(self) -> Column:
        name, kind = self.name(), self.type()
        return Column(name, kind, bool(self.take("PRIMARY") and self.need("KEY")))

    def type(self) -> Type:
        if token := self.take(*TYPES):
            return TYPES[token.kind]
        raise self.fail(f"expected column type (INT, TEXT, BOOL, …), got {self.now}")

    def alter(self) -> N.AddColumn | N.DropColumn:
        self.need("TABLE")
        table = self.name()
        if self.take("ADD"):
            self.need("COLUMN")
            column = self.column()
            if column.primary_key:
                raise self.fail("ALTER ADD COLUMN cannot add a PRIMARY KEY")
            self.need("DEFAULT")
            return N.AddColumn(table, column, self.literal())
        if self.take("DROP"):
            self.need("COLUMN")
            return N.DropColumn(table, self.name())
        raise self.fail(f"expected ADD or DROP after ALTER TABLE, got {self.now}")

    def insert(self) -> N.Insert:
        self.need("INTO")
        table, columns = self.name(), ()
        if self.take("("):
            columns = self.listed(self.name)
            self.need(")")
        self.need("VALUES")
        self.need("(")
        values = self.listed(self.literal)
        self.need(")")
        if self.now.kind == ",":
            raise self.fail("multi-row INSERT is not supported")
        if columns and len(columns) != len(values):
            raise self.fail("INSERT column count does not match VALUES count")
        return N.Insert(table, columns, values)

    def update(self) -> N.Update:
        table = self.name()
        self.need("SET")
        if self.now.kind != "identifier":
            raise self.fail("UPDATE requires at least one assignment")

        def one():
            column = self.name()
            self.need("=")
            return column, self.expr()

        return N.Update(table, self.listed(one), self.where())

    def where(self) -> N.Expr | None:
        return self.expr() if self.take("WHERE") else None

    # SELECT

    def select(self) -> N.Select:
        if self.now.kind == "DISTINCT":
            raise self.fail("SELECT DISTINCT is not supported")
        star, items = bool(self.take("*")), ()
        if not star:
            if self.now.kind == "FROM":
                raise self.fail("empty SELECT list")
            items = self.listed(self.item)
        elif self.now.kind == ",":
            raise self.fail("cannot mix * with other select items")
        self.need("FROM")
        table, joins = self.table(), []
        while join := self.join():
            joins.append(join)
        where, group, having, order, limit = self.where(), (), None, (), None
        if self.take("GROUP"):
            self.need("BY")
            if self.now.kind != "identifier":
                raise self.fail("empty GROUP BY list")
            group = self.listed(self.ref)
        if self.take("HAVING"):
            having = self.expr(aggregates=True)
        if self.take("ORDER"):
            self.need("BY")
            order = self.listed(lambda: N.Order(self.ref(), not self.take("DESC") and (self.take("ASC"), True)[1]))
        if self.take("LIMIT"):
            if self.now.kind != "integer":
                raise self.fail("LIMIT requires an integer")
            limit = self.take("integer").value
            if limit < 0:
                raise self.fail("LIMIT must be non-negative")
        if self.now.kind in SET_OPERATIONS:
            raise self.fail("set operations are not supported")
        return N.Select(table, star, items, tuple(joins), where, group, having, order, limit)

    def item(self) -> N.Item:
        if self.now.kind == "*":
            raise self.fail("cannot mix * with other select items")
        expr = self.aggregate() if self.now.kind in AGGREGATES else self.expr()
        return N.Item(expr, self.name() if self.take("AS") else "")

    def aggregate(self) -> N.Aggregate:
        func = self.take(*AGGREGATES).kind
        self.need("(")
        if self.now.kind == "*":
            if func != "COUNT":
                raise self.fail("only COUNT(*) is allowed; use a column for other aggregates")
            self.take("*")
            column = None
        elif self.now.kind == "DISTINCT":
            raise self.fail("DISTINCT is not supported")
        else:
            column = self.ref()
        self.need(")")
        return N.Aggregate(func, column)

    def table(self) -> N.TableRef:
        if self.now.kind == "(":
            raise self.fail("subqueries are not supported")
        name = self.name()
        alias = self.name() if self.take("AS") else ""
        if not alias and self.now.kind == "identifier":
            alias = self.name()
        return N.TableRef(name, alias)

    def join(self) -> N.Join | None:
        match self.now.kind:
            case ",":
                raise self.fail("comma joins are not supported; use INNER JOIN")
            case "LEFT" | "RIGHT" | "FULL" | "OUTER" | "CROSS":
                raise self.fail("only INNER JOIN is supported")
            case "JOIN":
                raise self.fail("use INNER JOIN … ON …")
        if not self.take("INNER"):
            return None
        self.need("JOIN")
        table = self.table()
        if not self.take("ON"):
            raise self.fail("INNER JOIN requires ON (USING/NATURAL not supported)")
        return N.Join(table, self.expr())

    # Expressions: OR below AND below NOT below one comparison

    def expr(self, aggregates: bool = False) -> N.Expr:
        left = self.conjunction(aggregates)
        while self.take("OR"):
            left = N.Logic("or", (left, self.conjunction(aggregates)))
        return left

    def conjunction(self, aggregates: bool) -> N.Expr:
        left = self.negation(aggregates)
        while self.take("AND"):
            left = N.Logic("and", (left, self.negation(aggregates)))
        return left

    def negation(self, aggregates: bool) -> N.Expr:
        if self.take("NOT"):
            return N.Logic("not", (self.negation(aggregates),))
        left = self.primary(aggregates)
        if op := self.take(*N.Compare.NAMES):
            return N.Compare(op.kind, left, self.primary(aggregates))
        return left

    def primary(self, aggregates: bool) -> N.Expr:
        if self.take("("):
            inner = self.expr(aggregates)
            self.need(")")
            return inner
        if self.now.kind in ("integer", "string", "TRUE", "FALSE", "NULL"):
            return N.Literal(self.literal())
        if self.now.kind == "identifier":
            return N.Ref(self.ref())
        if aggregates and self.now.kind in AGGREGATES:
            return self.aggregate()
        raise self.fail(f"expected expression, got {self.now}")

    def literal(self) -> Value:
        token = self.take("integer", "string", "TRUE", "FALSE", "NULL")
        if not token:
            raise self.fail(f"expected literal, got {self.now}")
        return {"TRUE": True, "FALSE": False, "NULL": None}.get(token.kind, token.value)

    def ref(self) -> str:
        first = self.name()
        return f"{first}.{self.name()}" if self.take(".") else first


def parse_script(text: str) -> list[N.Statement]:
    return Parser(text).script()


def parse_statement(text: str) -> N.Statement:
    """Exactly one statement, with or without its semicolon."""
    parser = Parser(text)
    if parser.now.kind == "end":
        raise parser.fail("empty statement")
    out = parser.statement()
    parser.take(";")
    if parser.now.kind != "end":
        raise parser.fail(f"unexpected trailing token {parser.now}")
    return out
