import pytest

from tessera.schema import Type
from tessera.sql import nodes as N
from tessera.sql.parser import parse_script, parse_statement, scan
from tessera.status import InvalidArgument


def bad(sql, part):
    with pytest.raises(InvalidArgument) as e:
        parse_script(sql)
    assert part in str(e.value)
    assert str(e.value).startswith("InvalidArgument: SQL parse error at offset ")


def test_tokens():
    assert [t.kind for t in scan("SELECT a.b <> -5 'it''s'")] == ["SELECT", "identifier", ".", "identifier", "!=", "integer", "string", "end"]
    assert scan("'it''s'")[0].value == "it's"
    assert scan("-9223372036854775808")[0].value == -(1 << 63)


@pytest.mark.parametrize(
    ("sql", "part"),
    [
        ("SELECT 'open", "unterminated string literal"),
        ("SELECT a FROM t WHERE a ! b", "unexpected '!'"),
        ("SELECT a FROM t WHERE id = 1 + 1", "unexpected character '+'"),
        ("SELECT a FROM t -- note", "unexpected character '-'"),
        ("SELECT a FROM t WHERE id = 9223372036854775808", "integer out of range"),
        ("SELECT DISTINCT a FROM t", "SELECT DISTINCT is not supported"),
        ("SELECT FROM t", "empty SELECT list"),
        ("SELECT *, a FROM t", "cannot mix *"),
        ("SELECT a, * FROM t", "cannot mix *"),
        ("SELECT 1", "expected FROM"),
        ("SELECT SUM(*) FROM t", "only COUNT(*) is allowed"),
        ("SELECT COUNT(DISTINCT a) FROM t", "DISTINCT is not supported"),
        ("SELECT a FROM (SELECT 1)", "subqueries are not supported"),
        ("SELECT a FROM t, u", "comma joins are not supported"),
        ("SELECT a FROM t LEFT JOIN u ON a = b", "only INNER JOIN is supported"),
        ("SELECT a FROM t CROSS JOIN u", "only INNER JOIN is supported"),
        ("SELECT a FROM t JOIN u ON a = b", "use INNER JOIN"),
        ("SELECT a FROM t INNER JOIN u", "INNER JOIN requires ON"),
        ("SELECT a FROM t UNION SELECT b FROM u", "set operations are not supported"),
        ("SELECT a FROM t GROUP BY", "empty GROUP BY list"),
        ("SELECT a FROM t LIMIT -1", "LIMIT must be non-negative"),
        ("SELECT a FROM t LIMIT x", "LIMIT requires an integer"),
        ("SELECT a FROM t WHERE a < b < c", "expected ';'"),
        ("SELECT count FROM t", "expected ("),
        ("INSERT INTO t VALUES (1), (2)", "multi-row INSERT is not supported"),
        ("INSERT INTO t (a, b) VALUES (1)", "INSERT column count"),
        ("INSERT INTO t VALUES (a)", "expected literal"),
        ("UPDATE t SET", "at least one assignment"),
        ("CREATE TABLE t (a INT)", "exactly one PRIMARY KEY"),
        ("CREATE TABLE t (a INT PRIMARY KEY, b INT PRIMARY KEY)", "exactly one PRIMARY KEY"),
        ("CREATE TABLE t (a FLOAT PRIMARY KEY)", "expected column type"),
        ("ALTER TABLE t RENAME a", "expected ADD or DROP"),
        ("ALTER TABLE t ADD COLUMN a INT PRIMARY KEY DEFAULT 1", "cannot add a PRIMARY KEY"),
        ("ALTER TABLE t ADD COLUMN a INT", "expected DEFAULT"),
        ("EXPLAIN SELECT a FROM t", "at start of statement"),
        ("SELECT a FROM t SELECT b FROM t", "expected ';' between statements"),
    ],
)
def test_rejects(sql, part):
    bad(sql, part)


def test_select_in_full():
    s = parse_statement("select u.a AS x, COUNT(*) from t AS u inner join v w on u.a = w.b where not a = 1 or b < 'x' and c group by u.a, b having SUM(c) >= 2 order by x desc, b asc limit 3;")
    assert s.table == N.TableRef("t", "u") and s.joins[0].table == N.TableRef("v", "w")
    assert s.items[0] == N.Item(N.Ref("u.a"), "x") and s.items[1].expr == N.Aggregate("COUNT", None)
    assert str(s.where) == "Or(Not(Compare(Eq, Column(a), Literal(1))), And(Compare(Lt, Column(b), Literal('x')), Column(c)))"
    assert s.group_by == ("u.a", "b") and s.having == N.Compare(">=", N.Aggregate("SUM", "c"), N.Literal(2))
    assert s.order_by == (N.Order("x", False), N.Order("b")) and s.limit == 3


def test_names():
    assert str(N.Aggregate("SUM", "u.x")) == "SUM(u.x)" and str(N.Aggregate("COUNT", None)) == "COUNT(*)"
    assert str(N.Literal("it's")) == "Literal('it''s')" and str(N.Literal(None)) == "Literal(NULL)" and str(N.Literal(True)) == "Literal(true)"


def test_other_statements():
    assert parse_script("BEGIN; BEGIN TRANSACTION; COMMIT; ABORT; ROLLBACK TRANSACTION") == [N.Begin(), N.Begin(), N.Commit(), N.Abort(), N.Abort()]
    create = parse_statement("CREATE TABLE T1 (Id integer PRIMARY KEY, n string, b boolean)")
    assert create.name == "T1" and [c.type for c in create.columns] == [Type.INT, Type.TEXT, Type.BOOL] and create.columns[0].primary_key
    assert parse_statement("DROP TABLE IF EXISTS t") == N.DropTable("t", True)
    assert parse_statement("DELETE FROM t WHERE TRUE") == N.Delete("t", N.Literal(True))
    assert parse_statement("UPDATE t SET a = 1, b = c WHERE d = NULL").sets == (("a", N.Literal(1)), ("b", N.Ref("c")))
    assert parse_script(" ; ;") == []


def test_one_statement_only():
    with pytest.raises(InvalidArgument, match="empty statement"):
        parse_statement("  ")
    with pytest.raises(InvalidArgument, match="unexpected trailing token"):
        parse_statement("COMMIT; COMMIT")
