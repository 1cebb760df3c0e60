"""Versions, transactions, recovery; random histories against a dictionary."""

import random

import pytest

from tessera.schema import Column, TableSchema, Type
from tessera.session import Session
from tessera.status import Conflict, InvalidArgument, IOErr, NotFound
from tessera.store import Database

SCHEMA = TableSchema("t", (Column("id", Type.INT, True), Column("v", Type.TEXT)))


def opened(spark, tmp_path, **kw):
    return Database(spark, f"file://{tmp_path}/db", **kw)


def rows(df):
    return {r[0]: r[1] for r in df.collect()}


@pytest.fixture
def db(spark, tmp_path):
    with opened(spark, tmp_path) as db:
        db.create_table(SCHEMA)
        yield db


def test_open_flags(spark, tmp_path):
    with pytest.raises(NotFound):
        opened(spark, tmp_path, create_if_missing=False)
    opened(spark, tmp_path).close()
    with pytest.raises(InvalidArgument):
        opened(spark, tmp_path, error_if_exists=True)
    with opened(spark, tmp_path), pytest.raises(IOErr):
        opened(spark, tmp_path)


def test_transaction_rules(db):
    one = db.begin()
    one.insert("t", (1, "a"))
    one.update("t", (1, "b"))
    assert one.get("t", 1) == (1, "b") and one.get("t", 2) is None
    with pytest.raises(InvalidArgument, match="duplicate primary key in transaction"):
        one.insert("t", (1, "c"))
    two = db.begin()
    with pytest.raises(Conflict, match="key held by open txn"):
        two.insert("t", (1, "x"))
    two.insert("t", (2, "x"))
    one.commit()
    two.commit()
    with pytest.raises(InvalidArgument, match="already finished"):
        one.commit()
    with pytest.raises(InvalidArgument, match="transaction finished"):
        one.insert("t", (9, "x"))
    three = db.begin()
    three.delete("t", 1)
    with pytest.raises(NotFound, match="already deleted"):
        three.delete("t", 1)
    with pytest.raises(NotFound, match="row not found"):
        three.update("t", (5, "x"))
    three.insert("t", (1, "new"))
    three.commit()
    assert rows(db.rows_at("t")) == {1: "new", 2: "x"}
    assert (db.txn_state(one.id), db.txn_state(three.id)) == ("Committed", "Committed")
    with pytest.raises(NotFound):
        db.txn_state(999)


def test_many_rows_at_once(db, spark):
    df = spark.range(5000).selectExpr("id", "concat('v', id) AS v")
    assert db.load("t", df) == 5000
    with pytest.raises(InvalidArgument, match="duplicate primary key"):
        db.load("t", df)
    with pytest.raises(InvalidArgument, match="null not allowed"):
        db.load("t", spark.sql("SELECT 9000L AS id, CAST(NULL AS STRING) AS v"))
    s = Session(db)
    other = db.begin()
    assert s.execute("UPDATE t SET v = 'w' WHERE id >= 10").rows_affected == 4990
    with pytest.raises(Conflict):
        other.delete("t", 4000)
    other.abort()
    assert s.execute("BEGIN; DELETE FROM t WHERE id = 3; DELETE FROM t WHERE id >= 100; INSERT INTO t VALUES (3, 'x'); SELECT COUNT(*) FROM t").rows == [(100,)]
    s.execute("COMMIT")
    assert rows(db.rows_at("t")) == {k: "x" if k == 3 else "w" if k >= 10 else f"v{k}" for k in range(100)}


def test_plans(db, spark):
    """Inserts alone are a plain scan; a key predicate reaches the files; columns are pruned."""
    db.load("t", spark.range(100).selectExpr("id", "'a' AS v"))
    db.load("t", spark.range(100, 200).selectExpr("id", "'b' AS v"))
    plan = lambda df: df._jdf.queryExecution().toString()
    scan = plan(db.rows_at("t").where("id = 7").select("id"))
    assert "Window" not in scan and "Join" not in scan and "EqualTo(c0,7)" in scan
    Session(db).execute("UPDATE t SET v = 'c' WHERE id < 5")
    both = plan(db.rows_at("t").where("id = 7").select("id"))
    assert both.count("EqualTo(c0,7)") >= 2 and "LeftAnti" in both
    assert "c1" not in both.split("== Physical Plan ==")[1].split("ReadSchema:")[1].split(">")[0]


def test_recovery(spark, tmp_path):
    db = opened(spark, tmp_path)
    db.create_table(SCHEMA)
    txn = db.begin()
    txn.insert("t", (1, "a"))
    txn.commit()
    open_ = db.begin()
    open_.insert("t", (2, "lost"))
    open_.insert_frame("t", spark.range(5, 9).selectExpr("id", "'lost' AS v"))
    db.files.delete("LOCK")
    last = 0
    for k in range(3):
        with opened(spark, tmp_path, create_if_missing=False) as db:
            assert rows(db.rows_at("t")) == {1: "a"} | {10 + j: "n" for j in range(k)}
            assert db.next_ts > last
            last = db.next_ts
            txn = db.begin()
            txn.insert("t", (10 + k, "n"))
            txn.commit()


def test_dropped_data_stays_gone(db, spark):
    db.load("t", spark.range(10).selectExpr("id", "'a' AS v"))
    db.create_table(TableSchema("tt", SCHEMA.columns))
    db.load("tt", spark.range(3).selectExpr("id", "'b' AS v"))
    db.drop_table("t")
    db.create_table(SCHEMA)
    assert rows(db.rows_at("t")) == {} and len(rows(db.rows_at("tt"))) == 3


@pytest.mark.parametrize("seed", [1, 2])
def test_random_history(spark, tmp_path, seed):
    """Every snapshot of a random history is what a dictionary says."""
    rng, model, history = random.Random(seed), {}, {}
    db = opened(spark, tmp_path)
    db.create_table(SCHEMA)
    history[db.next_ts - 1] = {}
    for step in range(12):
        txn, now = db.begin(), dict(model)
        for _ in range(rng.randint(1, 4)):
            key, value = rng.randint(1, 6), f"{step}.{rng.random():.3f}"
            if key not in now:
                txn.insert("t", (key, value))
                now[key] = value
            elif rng.random() < 0.5:
                txn.update("t", (key, value))
                now[key] = value
            else:
                txn.delete("t", key)
                del now[key]
        if step == 5:
            assert rows(txn.table("t")) == now
        if rng.random() < 0.2:
            txn.abort()
        else:
            txn.commit()
            model = now
            history[db.next_ts - 1] = dict(model)
        if step == 7:
            db.compact("t")
            history[db.next_ts - 1] = dict(model)
            db.close()
            db = opened(spark, tmp_path)
    for ts, want in history.items():
        assert rows(db.rows_at("t", ts)) == want
    txn = db.begin()
    assert list(txn.scan("t", 2, 5)) == sorted((k, v) for k, v in model.items() if 2 <= k < 5)
    db.close()


def test_commits_compact(db, spark, monkeypatch):
    """A commit that makes too many files of changes writes a new base; rows and older views stay."""
    from tessera import store

    monkeypatch.setattr(store, "COMPACT_AFTER", 3)
    Session(db).execute("CREATE TABLE much (id INT PRIMARY KEY, v INT)")
    session, then = Session(db), None
    for k in range(6):
        session.execute(f"INSERT INTO much VALUES ({k}, 0)" if k < 3 else f"UPDATE much SET v = {k}")
        then = then or (db.next_ts - 1 if k == 2 else None)
    files = db._own("much").files
    assert any(f.base for f in files) and not files[0].base
    assert sorted(session.execute("SELECT * FROM much").rows) == [(0, 5), (1, 5), (2, 5)]
    assert sorted(tuple(r) for r in db.rows_at("much", then).collect()) == [(0, 0), (1, 0), (2, 0)]
