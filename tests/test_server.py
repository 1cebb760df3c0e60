import io
import socket
import threading

import pytest

from tessera import cli
from tessera.result import QueryResult
from tessera.server import protocol as P
from tessera.server.kv_server import KvServer, answer
from tessera.server.sql_server import Connection, SqlServer
from tessera.session import Session
from tessera.sources.kv import KvStore
from tessera.status import InvalidArgument, NotFound
from tessera.store import Database


@pytest.fixture
def db(spark, tmp_path):
    with Database(spark, f"file://{tmp_path}/db") as db:
        yield db


@pytest.mark.parametrize("value", [None, True, False, 0, -5, (1 << 63) - 1, "", "NULL", "a\\b\n\r\t\x01\x7f é$I:1"])
def test_cells(value):
    assert P.decode_cell(P.encode_cell(value)) == value and type(P.decode_cell(P.encode_cell(value))) is type(value)


@pytest.mark.parametrize("line", ["", "$X", "$I:", "$I:1x", "$I:9223372036854775808", "$B:2", "$S:\\q", "$S:\\"])
def test_bad_cells(line):
    with pytest.raises(InvalidArgument):
        P.decode_cell(line)


def test_replies():
    assert P.encode_cell("\x01\n") == "$S:\\x01\\n"
    assert P.encode_result(QueryResult()) == "+OK\n" and P.encode_result(QueryResult(rows_affected=2)) == "+OK rows_affected=2\n"
    text = P.encode_result(QueryResult(["id", "n"], [(1, "ada")], 0, "SeqScan"))
    assert text == "*PLAN SeqScan\n*RESULT 1 2\n*COLS 2\nid\nn\n*ROW\n$I:1\n$S:ada\n*END\n"
    assert P.decode_reply(text).result == QueryResult(["id", "n"], [(1, "ada")], 0, "SeqScan")
    assert P.encode_error(NotFound("table not found: t")) == "-ERR NotFound: table not found: t\n"
    assert P.decode_reply("+OK in_txn=1\n").in_txn is True and P.decode_reply("-ERR X: y\n").message == "X: y"
    for bad in ("", "?", "*RESULT 1 1\n*COLS 1\nid\n*ROW\n", "*RESULT 1 1\n*COLS 2\n", "*RESULT x 1\n"):
        with pytest.raises(InvalidArgument):
            P.decode_reply(bad)


def test_terminators():
    assert P.is_terminated("SELECT 1;") and P.is_terminated("a 'x;y' ; \n") and P.is_terminated("a; b;")
    assert not P.is_terminated("SELECT ';") and not P.is_terminated("SELECT ';'") and not P.is_terminated("a") and not P.is_terminated("'it''s;")
    assert P.statements("a; b 'x;y';\n c ;;") == ["a;", "b 'x;y';", "c ;"]


def test_lines(db):
    c = Connection(Session(db))
    assert c.line("ping") == ("+PONG\n", True) and c.line("  ") == ("", True) and c.line("STATUS") == ("+OK in_txn=0\n", True)
    assert c.line("CREATE TABLE t (id INT") == ("", True)
    assert c.line("PING") == ("", True)  # inside a statement it is no command
    assert c.line(";")[0].startswith("-ERR InvalidArgument: SQL parse error")
    assert c.line("CREATE TABLE t (id INT PRIMARY KEY);") == ("+OK\n", True)
    assert c.line("INSERT INTO t VALUES (1);") == ("+OK rows_affected=1\n", True)
    assert c.line("BEGIN;") == ("+OK\n", True) and c.line("STATUS") == ("+OK in_txn=1\n", True)
    assert c.line("RESET") == ("+OK\n", True) and c.line("STATUS") == ("+OK in_txn=0\n", True)
    assert c.line("x" * (P.MAX_STATEMENT + 1)) == ("-ERR InvalidArgument: statement too large\n", True)
    assert c.line("QUIT") == ("+OK\n", False)


def test_tcp(db):
    server = SqlServer(db, port=0, max_clients=2)
    server.start()
    try:
        a, b = cli.Client("127.0.0.1", server.port), cli.Client("127.0.0.1", server.port)
        a.send("CREATE TABLE t (id INT PRIMARY KEY, name TEXT);")
        assert a.send("PING").kind == b.send("PING").kind == "pong"
        with socket.create_connection(("127.0.0.1", server.port)) as third:
            assert b"too many connections" in third.recv(1000)
        b.send("BEGIN;")
        b.send("INSERT INTO t VALUES (7, 'b');")
        assert b.in_txn()
        b.close()  # a lost connection rolls back
        errors = []

        def insert(client, k):
            try:
                for i in range(3):
                    assert client.send(f"INSERT INTO t VALUES ({k * 1000 + i}, 'x');").rows_affected == 1
            except AssertionError as e:
                errors.append(e)

        for _ in range(50):
            if db.open_txn_count == 0:
                break
            threading.Event().wait(0.1)
        c = cli.Client("127.0.0.1", server.port)
        threads = [threading.Thread(target=insert, args=(client, k)) for k, client in enumerate((a, c))]
        [t.start() for t in threads]
        [t.join() for t in threads]
        assert not errors
        assert a.send("SELECT COUNT(*) FROM t;").result.rows == [(6,)]
        assert "NotFound" in a.run("SELECT * FROM nope;")
        a.close()
        c.close()
    finally:
        server.stop()


def test_shell(db):
    session, out = Session(db), io.StringIO()
    cli.shell(cli.local(session), session.in_transaction, io.StringIO("CREATE TABLE t (id INT PRIMARY KEY);\n.history\nINSERT INTO\n t VALUES (1);\nSELECT * FROM t;\n.quit\nDROP TABLE t;\n"), out, False)
    assert "CREATE TABLE t (id INT PRIMARY KEY);\n" in out.getvalue() and "(1 row)" in out.getvalue() and db.has_table("t")
    assert [cli.prompt("", False), cli.prompt("", True), cli.prompt("SELECT 'a", False)] == ["sql> ", "sql*> ", "sql'> "]
    out = io.StringIO()
    cli.run_script(cli.local(session), "DELETE FROM t; SELECT x FROM t; SELECT * FROM t", out)
    assert "unknown column: x" in out.getvalue() and out.getvalue().endswith("(0 rows)\n")


def test_kv(spark, tmp_path):
    root = f"file://{tmp_path}/kv"
    kv = KvStore(spark, root)
    kv.put(b"a", b"1")
    kv.put(b"\xff", b"\x00")
    then = kv.snapshot()
    kv.write([(b"a", b"2"), (b"b", b"3"), (b"\xff", None)], sync=True)
    assert kv.get(b"a") == b"2" and kv.get(b"a", then) == b"1" and kv.get(b"\xff") is None
    assert list(kv.iterate()) == [(b"a", b"2"), (b"b", b"3")] and list(kv.iterate(at=then)) == [(b"a", b"1"), (b"\xff", b"\x00")]
    assert list(kv.iterate(b"aa")) == [(b"b", b"3")]
    kv = KvStore(spark, root)  # what was synced survives
    assert kv.get(b"b") == b"3"
    for k in range(4):
        kv.put(b"k%d" % k, b"v")
        kv.flush()
    assert len(kv.runs) == 1
    kv.delete(b"k1")
    kv.close()
    kv = KvStore(spark, root)
    assert [k for k, _ in kv.iterate()] == [b"a", b"b", b"k0", b"k2", b"k3"] and kv.get(b"k1") is None
    with pytest.raises(InvalidArgument):
        KvStore(spark, root, error_if_exists=True)
    with pytest.raises(NotFound):
        KvStore(spark, f"{root}-none", create_if_missing=False)


def test_kv_server(spark, tmp_path):
    kv = KvStore(spark, f"file://{tmp_path}/kv")
    assert answer(kv, b"SET a b c\n") == (b"OK\n", True) and answer(kv, b"GET a\n") == (b"$3\nb c\n", True)
    assert answer(kv, b"DEL a\n") == (b"OK\n", True) and answer(kv, b"GET a\n") == (b"NOT_FOUND\n", True)
    assert answer(kv, b"SET a\n")[0].startswith(b"ERR") and answer(kv, b"nope\n")[0].startswith(b"ERR") and answer(kv, b"QUIT\n") == (b"BYE\n", False)
    server = KvServer(kv, "127.0.0.1", 0)
    server.start()
    with socket.create_connection(("127.0.0.1", server.port)) as s:
        s.sendall(b"PING\r\n")
        assert s.recv(100) == b"PONG\n"
    server.stop()
