"""What statements mean, end to end."""

import pytest

from tessera.result import QueryResult, text_of
from tessera.session import Session
from tessera.status import Conflict, InvalidArgument, NotFound, StatusError
from tessera.store import Database


@pytest.fixture
def db(spark, tmp_path):
    with Database(spark, f"file://{tmp_path}/db") as db:
        yield db


@pytest.fixture
def s(db):
    return Session(db)


@pytest.fixture
def users(s):
    s.execute("CREATE TABLE users (id INT PRIMARY KEY, name TEXT, score INT); BEGIN; INSERT INTO users VALUES (1,'ada',10); INSERT INTO users VALUES (2,'ada',30); INSERT INTO users VALUES (3,'bob',20); COMMIT")
    return s


def fails(s, sql, part, kind=InvalidArgument):
    with pytest.raises(kind) as e:
        s.execute(sql)
    assert part in str(e.value)


def test_selects(users):
    r = users.execute("SELECT * FROM users WHERE id = 2")
    assert (r.column_names, r.rows, r.plan_tag) == (["id", "name", "score"], [(2, "ada", 30)], "PkPointGet")
    r = users.execute("SELECT name FROM users WHERE score >= 20 ORDER BY name DESC LIMIT 1")
    assert r.rows == [("bob",)] and r.plan_tag == "Limit<-Sort<-Project<-Filter<-SeqScan"
    assert users.execute("SELECT id FROM users WHERE id >= 2").plan_tag == "Project<-PkRangeScan"
    assert users.execute("SELECT id FROM users LIMIT 2").rows == [(1,), (2,)]
    r = users.execute("SELECT id = 1, 'x', NULL FROM users WHERE id = 1")
    assert users.execute("SELECT u.id, name FROM users u ORDER BY users.name, id DESC").rows == [(2, "ada"), (1, "ada"), (3, "bob")]
    assert r.column_names == ["Compare(Eq, Column(id), Literal(1))", "Literal('x')", "Literal(NULL)"] and r.rows == [(True, "x", None)]


def test_aggregates(users):
    r = users.execute("SELECT name, COUNT(*), SUM(score), AVG(score), MIN(score), MAX(score) FROM users GROUP BY name")
    assert r.rows == [("ada", 2, 40, 20, 10, 30), ("bob", 1, 20, 20, 20, 20)]
    assert r.column_names == ["name", "COUNT(*)", "SUM(score)", "AVG(score)", "MIN(score)", "MAX(score)"] and r.plan_tag == "Project<-HashAggregate<-SeqScan"
    assert users.execute("SELECT COUNT(*), SUM(score), AVG(score) FROM users WHERE id > 99").rows == [(0, None, None)]
    assert users.execute("SELECT name, COUNT(*) FROM users WHERE id > 99 GROUP BY name").rows == []
    assert users.execute("SELECT name FROM users GROUP BY name").rows == [("ada",), ("bob",)]
    r = users.execute("SELECT name AS n FROM users u GROUP BY u.name HAVING SUM(u.score) > 10 AND COUNT(*) >= 2 AND users.name = 'ada'")
    assert r.rows == [("ada",)] and r.plan_tag == "Project<-Filter<-HashAggregate<-SeqScan"
    assert users.execute("SELECT COUNT(*) AS n FROM users HAVING COUNT(*) > 5").rows == []
    users.execute("UPDATE users SET score = -27 WHERE id = 1; UPDATE users SET score = 0 WHERE id = 2; DELETE FROM users WHERE id = 3")
    assert users.execute("SELECT AVG(score) FROM users").rows == [(-13,)]


def test_sum_overflow_is_of_the_result(users):
    users.execute("UPDATE users SET score = 9223372036854775807 WHERE id = 1; UPDATE users SET score = 1 WHERE id = 2; UPDATE users SET score = -1 WHERE id = 3")
    assert users.execute("SELECT SUM(score) FROM users").rows == [((1 << 63) - 1,)]
    fails(users, "SELECT SUM(score) FROM users WHERE id < 3", "SUM overflow")
    fails(users, "SELECT AVG(score) FROM users WHERE id < 3", "SUM overflow")


@pytest.mark.parametrize(
    ("sql", "part"),
    [
        ("SELECT x FROM users", "unknown column: x"),
        ("SELECT ID FROM users", "unknown column: ID"),
        ("SELECT id FROM users WHERE id = 'x'", "compare type mismatch"),
        ("SELECT id FROM users WHERE name = TRUE", "compare type mismatch"),
        ("SELECT id FROM users WHERE id", "expected boolean"),
        ("SELECT id FROM users WHERE NOT name", "expected boolean"),
        ("SELECT SUM(name) FROM users", "aggregate argument must be Int64"),
        ("SELECT MIN(name) FROM users", "aggregate argument must be Int64"),
        ("SELECT * FROM users GROUP BY id", "SELECT * cannot be combined"),
        ("SELECT id FROM users HAVING id = 1", "HAVING requires"),
        ("SELECT name, COUNT(*) FROM users", "column must appear in GROUP BY: name"),
        ("SELECT 1, COUNT(*) FROM users", "requires GROUP BY columns or aggregates"),
        ("SELECT COUNT(*) AS n FROM users HAVING n > 1", "not SELECT aliases): n"),
        ("SELECT name FROM users GROUP BY name, users.name", "duplicate column: name"),
        ("SELECT id FROM users ORDER BY name", "unknown ORDER BY column: name"),
        ("SELECT name AS id FROM users u ORDER BY u.id", "unknown ORDER BY column: u.id"),
        ("INSERT INTO users VALUES (1, 'x')", "value count"),
        ("INSERT INTO users (id, name) VALUES (5, 'x')", "missing column in INSERT: score"),
        ("INSERT INTO users (id, id, name) VALUES (5, 5, 'x')", "duplicate column in INSERT: id"),
        ("INSERT INTO users (id, nope, name) VALUES (5, 5, 'x')", "unknown column: nope"),
        ("INSERT INTO users VALUES (5, NULL, 1)", "null not allowed in column: name"),
        ("INSERT INTO users VALUES ('5', 'x', 1)", "type mismatch in column: id"),
        ("INSERT INTO users VALUES (1, 'x', 1)", "duplicate primary key"),
        ("UPDATE users SET id = 9 WHERE id = 1", "cannot update primary key"),
        ("UPDATE users SET score = 'x'", "type mismatch in column: score"),
        ("UPDATE users SET score = NULL", "null not allowed in column: score"),
        ("UPDATE users SET users.score = 1", "expected"),
        ("DELETE FROM users WHERE users.id = 1", "unknown column: users.id"),
        ("CREATE TABLE users (id INT PRIMARY KEY)", "table already exists: users"),
        ("ALTER TABLE users ADD COLUMN name TEXT DEFAULT 'x'", "duplicate column: name"),
        ("ALTER TABLE users ADD COLUMN n INT DEFAULT 'x'", "DEFAULT type"),
        ("ALTER TABLE users ADD COLUMN n INT DEFAULT NULL", "must not be NULL"),
        ("ALTER TABLE users DROP COLUMN id", "cannot drop PRIMARY KEY"),
        ("ALTER TABLE users DROP COLUMN x", "unknown column: x"),
        ("COMMIT", "not in a transaction"),
        ("ROLLBACK", "not in a transaction"),
        ("BEGIN; BEGIN", "already in a transaction"),
        ("BEGIN; CREATE TABLE x (id INT PRIMARY KEY)", "DDL is not allowed inside a transaction"),
    ],
)
def test_errors(users, sql, part):
    fails(users, sql, part)


def test_missing_tables(s):
    fails(s, "SELECT * FROM nope", "table not found: nope", NotFound)
    fails(s, "DROP TABLE nope", "table not found: nope", NotFound)
    s.execute("DROP TABLE IF EXISTS nope")


def test_joins(users, db):
    users.execute("CREATE TABLE orders (id INT PRIMARY KEY, uid INT); INSERT INTO orders VALUES (7, 1); INSERT INTO orders VALUES (8, 3)")
    r = users.execute("SELECT * FROM users u INNER JOIN orders o ON u.id = o.uid")
    assert r.column_names == ["u.id", "u.name", "u.score", "o.id", "o.uid"] and r.rows == [(1, "ada", 10, 7, 1), (3, "bob", 20, 8, 3)]
    assert users.execute("SELECT * FROM users u INNER JOIN orders o ON u.id = o.uid ORDER BY uid DESC, users.id").rows[0][0] == 3
    fails(users, "SELECT id FROM users INNER JOIN orders ON uid = score", "ambiguous column: id")
    fails(Session(db, joins=False), "SELECT name FROM users INNER JOIN orders ON uid = score", "joins are not supported")


def test_writes_report_rows(users):
    r = users.execute("UPDATE users SET score = 1 WHERE name = 'ada'")
    assert (r.rows_affected, r.plan_tag) == (2, "Update<-Filter<-SeqScan")
    assert users.execute("DELETE FROM users WHERE id = 1").plan_tag == "Delete<-PkPointGet"
    assert text_of(users.execute("DELETE FROM users WHERE id = 1")) == "plan: Delete<-PkPointGet\nok\n"
    assert users.execute("UPDATE users SET score = id, name = 'z'").rows_affected == 2
    assert users.execute("SELECT * FROM users").rows == [(2, "z", 2), (3, "z", 3)]


def test_isolation(users, db):
    two = Session(db)
    two.execute("BEGIN")
    assert len(two.execute("SELECT * FROM users").rows) == 3
    users.execute("DELETE FROM users WHERE id = 1")
    assert len(two.execute("SELECT * FROM users").rows) == 3
    fails(two, "UPDATE users SET score = 0 WHERE id = 1", "key committed after snapshot", Conflict)
    assert two.in_transaction()
    two.execute("UPDATE users SET score = 0 WHERE id = 2")
    assert two.execute("SELECT score FROM users WHERE id = 2").rows == [(0,)]
    fails(users, "UPDATE users SET score = 5 WHERE id = 2", "key held by open txn", Conflict)
    fails(users, "CREATE TABLE x (id INT PRIMARY KEY)", "DDL requires no open transactions")
    two.execute("ROLLBACK")
    assert users.execute("SELECT * FROM users").rows == [(2, "ada", 30), (3, "bob", 20)]


def test_failed_statement_leaves_nothing(users):
    users.execute("BEGIN; INSERT INTO users VALUES (4, 'd', 4)")
    fails(users, "INSERT INTO users VALUES (4, 'e', 5)", "duplicate primary key in transaction")
    users.execute("DELETE FROM users WHERE id = 4; INSERT INTO users VALUES (4, 'f', 6); COMMIT")
    assert users.execute("SELECT name FROM users WHERE id = 4").rows == [("f",)]


def test_script_stops_at_error(users):
    with pytest.raises(StatusError):
        users.execute("DELETE FROM users WHERE id = 1; SELECT nope FROM users; DELETE FROM users")
    assert len(users.execute("SELECT * FROM users").rows) == 2


def test_schema_changes(users):
    users.execute("ALTER TABLE users ADD COLUMN age INT DEFAULT 42; INSERT INTO users VALUES (4, 'd', 4, 7); ALTER TABLE users DROP COLUMN score")
    assert users.execute("SELECT * FROM users").rows == [(1, "ada", 42), (2, "ada", 42), (3, "bob", 42), (4, "d", 7)]
    users.execute("UPDATE users SET age = 1 WHERE id = 1; ALTER TABLE users ADD COLUMN score INT DEFAULT 0")
    assert users.execute("SELECT id, score, age FROM users WHERE id < 3").rows == [(1, 0, 1), (2, 0, 42)]


def test_opaque_columns(spark, db):
    db.register_parquet("lineitem", "/root/testdata/sf0.001/lineitem.parquet")
    s = Session(db)
    assert len(s.execute("SELECT l_quantity, l_shipdate FROM lineitem LIMIT 3").rows) == 3
    assert s.execute("SELECT COUNT(l_quantity) FROM lineitem").rows == [(6000,)]
    fails(s, "SELECT l_orderkey FROM lineitem WHERE l_quantity = 1", "compare type not supported")
    fails(s, "SELECT SUM(l_quantity) FROM lineitem", "aggregate argument must be Int64")
    fails(s, "DELETE FROM lineitem", "read-only")


def test_text_form():
    r = QueryResult(["id", "name"], [(1, "ada"), (2, None)], 0, "SeqScan")
    assert text_of(r) == "plan: SeqScan\n+----+------+\n| id | name |\n+----+------+\n| 1  | ada  |\n| 2  | NULL |\n+----+------+\n(2 rows)\n"
    assert text_of(QueryResult()) == "ok\n" and text_of(QueryResult(rows_affected=3)) == "rows_affected: 3\n"
