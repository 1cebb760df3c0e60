import pytest

from tessera.plans.access import access
from tessera.plans.binding import Binding
from tessera.schema import Column, TableSchema, Type
from tessera.sql import nodes as N
from tessera.sql.parser import parse_statement
from tessera.status import InvalidArgument

USERS = TableSchema("users", (Column("id", Type.INT, True), Column("name", Type.TEXT), Column("Name", Type.TEXT)))
ORDERS = TableSchema("orders", (Column("id", Type.INT, True), Column("uid", Type.INT), Column("amount", Type.INT)))


def two():
    b = Binding()
    b.add(N.TableRef("users", "u"), USERS)
    b.add(N.TableRef("orders"), ORDERS)
    return b


def test_resolve():
    b = two()
    assert b.resolve("u.id").internal == b.resolve("users.id").internal == "t0c0"
    assert b.resolve("uid").internal == "t1c1" and b.resolve("Name").internal == "t0c2"
    assert [b.label(c) for c in b.columns()] == ["u.id", "u.name", "u.Name", "orders.id", "orders.uid", "orders.amount"]


@pytest.mark.parametrize(("name", "part"), [("id", "ambiguous column: id"), ("x.id", "unknown table: x"), ("u.x", "unknown column: u.x"), ("NAME", "unknown column: NAME")])
def test_bad_names(name, part):
    with pytest.raises(InvalidArgument, match=part):
        two().resolve(name)


def test_a_table_joins_once():
    b = two()
    with pytest.raises(InvalidArgument, match="duplicate table name or alias: users"):
        b.add(N.TableRef("users", "other"), USERS)
    with pytest.raises(InvalidArgument, match="duplicate table name or alias: u"):
        b.add(N.TableRef("more", "u"), USERS)


@pytest.mark.parametrize(
    ("where", "tag"),
    [
        ("id = 1", "PkPointGet"), ("1 = id", "PkPointGet"), ("users.id = 1", "PkPointGet"), ("id >= 1", "PkRangeScan"), ("1 > id", "PkRangeScan"),
        ("id > 1", "SeqScan"), ("id <= 1", "SeqScan"), ("id >= 1 AND id < 5", "SeqScan"), ("name = 'x'", "SeqScan"), ("id = NULL", "SeqScan"), ("id != 1", "SeqScan"),
    ],
)
def test_access(where, tag):
    b = Binding()
    b.add(N.TableRef("users"), USERS)
    assert access(parse_statement(f"SELECT * FROM users WHERE {where}").where, USERS.key, b).tag == tag


def test_schema_rules():
    column = Column("id", Type.INT, True)
    for schema, part in (
        (TableSchema("", (column,)), "table name is empty"),
        (TableSchema("t"), "no columns"),
        (TableSchema("t", (Column("", Type.INT, True),)), "column name is empty"),
        (TableSchema("t", (column, Column("id", Type.TEXT))), "duplicate column: id"),
        (TableSchema("t", (column, Column("n", Type.NULL))), "cannot be Null: n"),
        (TableSchema("t", (Column("id", Type.INT),)), "exactly one primary key"),
        (TableSchema("t", (column, Column("b", Type.INT, True))), "exactly one primary key"),
    ):
        with pytest.raises(InvalidArgument, match=part):
            schema.validate()
    with pytest.raises(InvalidArgument, match="type mismatch"):
        USERS.check_row((True, "a", "b"))
    with pytest.raises(InvalidArgument, match="null not allowed"):
        USERS.check_row((1, None, "b"))
