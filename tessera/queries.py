"""Queries of the engine, by name, and the same in SQL.

Those over the given tables are statements of the dialect, planned as they would
be in a session.  Those that write do so in a store of their own, seeded from
the given tables, and give what a reader sees in the end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import relational as R
from .plans.select import plan_select
from .session import Session
from .sources import kv
from .sources.external import external
from .sources.scratch import scratch_folder
from .sql.parser import parse_statement
from .status import Conflict
from .store import Database

Query = Callable[[SparkSession, str], DataFrame]

#: Tables and their keys; those without a unique column have none.
KEYS = {
    "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey",
    "orders": "o_orderkey", "lineitem": None, "events": "event_id", "documents": "doc_id", "embeddings": "vec_id",
    "pages": "page_id", "benchmark": "item_id", "labels": "doc_id", "conversations": None,
}

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def select(statement: str) -> Query:
    """A SELECT over the given tables."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables = lambda name: external(spark, name, f"{sf_dir}/{name}.parquet", KEYS[name])
        return plan_select(parse_statement(statement), tables).labelled()

    return run


def _add(name: str, query: Query | str, oracle: str | None) -> None:
    QUERIES[name] = select(query) if isinstance(query, str) else query
    if oracle:
        ORACLES[name] = oracle


# Scans, filters, projections

_ORDERS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"

_add(
    "flagship",
    "SELECT o_orderpriority, COUNT(*) AS n, SUM(o_custkey) AS total, AVG(o_custkey) AS mean FROM orders WHERE o_orderstatus != 'P' GROUP BY o_orderpriority HAVING COUNT(*) > 1 ORDER BY o_orderpriority",
    "SELECT o_orderpriority, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS total, CAST(sum(o_custkey) // count(*) AS BIGINT) AS mean FROM orders WHERE o_orderstatus != 'P' GROUP BY o_orderpriority HAVING count(*) > 1",
)
_add("seq_scan", "SELECT * FROM customer", "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
_add("pk_point_get", "SELECT * FROM orders WHERE o_orderkey = 7", f"SELECT {_ORDERS} FROM orders WHERE o_orderkey = 7")
_add("pk_range_ge", "SELECT * FROM orders WHERE o_orderkey >= 1000", f"SELECT {_ORDERS} FROM orders WHERE o_orderkey >= 1000")
_add("pk_range_lt", "SELECT * FROM orders WHERE 500 > o_orderkey", f"SELECT {_ORDERS} FROM orders WHERE o_orderkey < 500")
_add("pk_range_scan", lambda spark, d: R.range_scan(external(spark, "orders", f"{d}/orders.parquet", "o_orderkey")[1], "o_orderkey", 100, 200), f"SELECT {_ORDERS} FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 200")
_add("filter_residual", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 100 AND o_custkey < 50", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 100 AND o_custkey < 50")
for _name, _op in (("eq", "="), ("ne", "!="), ("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">=")):
    _text = f"SELECT p_partkey, p_size, p_brand FROM part WHERE p_size {_op} 25"
    _add(f"cmp_{_name}", _text, _text.replace("p_size,", "CAST(p_size AS BIGINT) AS p_size,"))
for _name, _where in (
    ("cmp_text", "o_orderpriority >= '3' AND o_orderstatus <> 'F'"),
    ("cmp_columns", "o_orderkey < o_custkey"),
    ("logic_and", "o_orderstatus = 'O' AND o_custkey < 40"),
    ("logic_or", "o_orderstatus = 'P' OR o_custkey < 10"),
    ("logic_not", "NOT o_orderstatus = 'O'"),
    ("logic_precedence", "o_custkey < 5 OR o_custkey > 90 AND NOT o_orderstatus = 'F' AND (o_orderkey < 300 OR o_orderkey > 600)"),
    ("null_predicate", "o_custkey = NULL"),
    ("null_three_valued", "o_custkey < 20 OR o_custkey = NULL"),
    ("literals", "o_custkey > -5 AND TRUE AND NOT FALSE AND o_orderstatus != 'it''s'"),
):
    _text = f"SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE {_where}"
    _add(_name, _text, _text)
_add("project_columns", "SELECT c_name, c_custkey FROM customer", "SELECT c_name, c_custkey FROM customer")
_add("project_alias", "SELECT c_custkey AS id, c_name AS name FROM customer", "SELECT c_custkey AS id, c_name AS name FROM customer")
_add("project_bool_expr", "SELECT c_custkey, c_custkey = 1, c_mktsegment = 'BUILDING' AS b, 'x', TRUE AS t, 5 AS five FROM customer", """SELECT c_custkey, c_custkey = 1 AS "Compare(Eq, Column(c_custkey), Literal(1))", c_mktsegment = 'BUILDING' AS b, 'x' AS "Literal('x')", TRUE AS t, CAST(5 AS BIGINT) AS five FROM customer""")
_add("alias_qualified", "SELECT c.c_name, customer.c_custkey AS id FROM customer AS c WHERE c.c_custkey < 20", "SELECT c_name, c_custkey AS id FROM customer WHERE c_custkey < 20")

# Joins

_add("inner_join", "SELECT o_orderkey, c_name, c_mktsegment FROM customer c INNER JOIN orders o ON c.c_custkey = o.o_custkey", "SELECT o_orderkey, c_name, c_mktsegment FROM customer JOIN orders ON c_custkey = o_custkey")
_add("inner_join_3way", "SELECT n_name, COUNT(*) AS n, MAX(o_orderkey) AS last FROM orders INNER JOIN customer ON o_custkey = c_custkey INNER JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name", "SELECT n_name, count(*) AS n, max(o_orderkey) AS last FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
_add("join_where", "SELECT o.o_orderkey, c.c_name FROM orders o INNER JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_mktsegment = 'BUILDING' AND o.o_orderstatus = 'O'", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderstatus = 'O'")
_add("theta_join", "SELECT n_name, r_name FROM nation INNER JOIN region ON n_regionkey < r_regionkey", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey < r_regionkey")
_add("join_star_labels", "SELECT * FROM nation n INNER JOIN region ON n.n_regionkey = region.r_regionkey", """SELECT CAST(n_nationkey AS BIGINT) AS "n.n_nationkey", n_name AS "n.n_name", CAST(n_regionkey AS BIGINT) AS "n.n_regionkey", CAST(r_regionkey AS BIGINT) AS "region.r_regionkey", r_name AS "region.r_name" FROM nation JOIN region ON n_regionkey = r_regionkey""")

# Aggregates

_add("agg_count_star", "SELECT COUNT(*) FROM lineitem", 'SELECT count(*) AS "COUNT(*)" FROM lineitem')
_add("agg_count_col", "SELECT COUNT(l_shipdate) AS n FROM lineitem", "SELECT count(l_shipdate) AS n FROM lineitem")
_add("agg_sum", "SELECT SUM(l_partkey) FROM lineitem", 'SELECT CAST(sum(l_partkey) AS BIGINT) AS "SUM(l_partkey)" FROM lineitem')
_add("agg_avg_trunc", "SELECT l_returnflag, AVG(l_partkey) AS a FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, CAST(sum(l_partkey) // count(l_partkey) AS BIGINT) AS a FROM lineitem GROUP BY l_returnflag")
_add("agg_min", "SELECT MIN(l_suppkey) AS low FROM lineitem", "SELECT min(l_suppkey) AS low FROM lineitem")
_add("agg_max", "SELECT MAX(l_linenumber) AS high FROM lineitem", "SELECT CAST(max(l_linenumber) AS BIGINT) AS high FROM lineitem")
_add("agg_scalar", "SELECT COUNT(*) AS n, SUM(o_custkey) AS s, AVG(o_custkey) AS a, MIN(o_custkey) AS low, MAX(o_custkey) AS high FROM orders WHERE o_orderstatus = 'O'", "SELECT count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS s, CAST(sum(o_custkey) // count(*) AS BIGINT) AS a, min(o_custkey) AS low, max(o_custkey) AS high FROM orders WHERE o_orderstatus = 'O'")
_add("agg_empty_scalar", "SELECT COUNT(*) AS n, SUM(o_custkey) AS s, AVG(o_custkey) AS a, MIN(o_custkey) AS low FROM orders WHERE o_orderkey < 0", "SELECT count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS s, CAST(sum(o_custkey) AS BIGINT) AS a, min(o_custkey) AS low FROM orders WHERE o_orderkey < 0")
_add("agg_empty_group", "SELECT o_orderstatus, COUNT(*) AS n FROM orders WHERE o_orderkey < 0 GROUP BY o_orderstatus", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderkey < 0 GROUP BY o_orderstatus")
_add("group_by", "SELECT l_returnflag, COUNT(*) AS n, SUM(l_suppkey) AS s FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, count(*) AS n, CAST(sum(l_suppkey) AS BIGINT) AS s FROM lineitem GROUP BY l_returnflag")
_add("group_by_multi", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, MIN(l_orderkey) AS low FROM lineitem GROUP BY l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, count(*) AS n, min(l_orderkey) AS low FROM lineitem GROUP BY l_returnflag, l_linestatus")
_add("group_by_no_agg", "SELECT l_linestatus, l_returnflag FROM lineitem GROUP BY l_returnflag, l_linestatus", "SELECT DISTINCT l_linestatus, l_returnflag FROM lineitem")
_add("group_key_not_selected", "SELECT COUNT(*) AS n FROM orders GROUP BY o_orderpriority", "SELECT count(*) AS n FROM orders GROUP BY o_orderpriority")
_add("agg_dual_alias", "SELECT o_orderstatus, SUM(o_custkey) AS a, SUM(orders.o_custkey) AS b FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, CAST(sum(o_custkey) AS BIGINT) AS a, CAST(sum(o_custkey) AS BIGINT) AS b FROM orders GROUP BY o_orderstatus")
_add("having_count", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
_add("having_group_col", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING o_custkey < 30", "SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey < 30 GROUP BY o_custkey")
_add("having_hidden_agg", "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING MAX(o_orderkey) > 900 AND MIN(o_orderkey) < 100", "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING max(o_orderkey) > 900 AND min(o_orderkey) < 100")
_add("having_scalar", "SELECT COUNT(*) AS n FROM orders HAVING SUM(o_custkey) > 10", "SELECT count(*) AS n FROM orders HAVING sum(o_custkey) > 10")

# Order and limit

for _name, _text in (
    ("order_by_asc", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 100"),
    ("order_by_desc", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey DESC LIMIT 100"),
    ("order_by_multi", "SELECT o_orderstatus, o_custkey, o_orderkey FROM orders ORDER BY o_orderstatus DESC, o_custkey ASC, o_orderkey LIMIT 100"),
    ("order_by_alias", "SELECT o_orderkey AS k, o_custkey AS c FROM orders ORDER BY c, k LIMIT 100"),
    ("top_k", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey >= 10 ORDER BY o_orderkey LIMIT 20"),
    ("limit_zero", "SELECT o_orderkey FROM orders LIMIT 0"),
):
    _add(_name, _text, _text)
_add("order_by_agg_alias", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 20", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 20")
_add("order_by_ties", "SELECT o_orderstatus, o_orderkey FROM orders ORDER BY o_orderstatus LIMIT 30", "SELECT o_orderstatus, o_orderkey FROM orders ORDER BY o_orderstatus, o_orderkey LIMIT 30")
_add("limit", "SELECT o_orderkey, o_custkey FROM orders LIMIT 10", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 10")


# Writes, schema changes, transactions: nation as table t(id, name, region)

_SEED = "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, CAST(n_regionkey AS BIGINT) AS region FROM nation"


def _seeded(spark: SparkSession, sf_dir: str) -> Database:
    db = Database(spark, scratch_folder(spark))
    Session(db).execute("CREATE TABLE t (id INT PRIMARY KEY, name TEXT, region INT)")
    nation = external(spark, "nation", f"{sf_dir}/nation.parquet", "n_nationkey")[1]
    db.load("t", nation)
    return db


def story(script: str, final: str = "SELECT * FROM t") -> Query:
    """What is seen after a script in a store of its own."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with _seeded(spark, sf_dir) as db:
            session = Session(db)
            session.execute(script)
            return session.dataframe(final)

    return run


def _tell(name: str, script: str, oracle: str, final: str = "SELECT * FROM t") -> None:
    _add(name, story(script, final), f"WITH t AS ({_SEED}) {oracle}")


_tell("dml_insert", "INSERT INTO t VALUES (100, 'Atlantis', 9); INSERT INTO t (region, id, name) VALUES (8, 101, 'Mu')", "SELECT * FROM t UNION ALL SELECT 100, 'Atlantis', 9 UNION ALL SELECT 101, 'Mu', 8")
_tell("dml_update", "UPDATE t SET region = 7, name = 'x' WHERE id < 5", "SELECT id, CASE WHEN id < 5 THEN 'x' ELSE name END AS name, CASE WHEN id < 5 THEN 7 ELSE region END AS region FROM t")
_tell("dml_update_old_row", "UPDATE t SET region = id WHERE region = 1", "SELECT id, name, CASE WHEN region = 1 THEN id ELSE region END AS region FROM t")
_tell("dml_update_all", "UPDATE t SET region = 0", "SELECT id, name, CAST(0 AS BIGINT) AS region FROM t")
_tell("dml_delete", "DELETE FROM t WHERE region = 2 OR id = 0", "SELECT * FROM t WHERE NOT (region = 2 OR id = 0)")
_tell("dml_delete_all", "DELETE FROM t", "SELECT * FROM t WHERE FALSE")
_tell("dml_reinsert", "DELETE FROM t WHERE id = 3; INSERT INTO t VALUES (3, 'again', 33); UPDATE t SET region = 34 WHERE id = 3", "SELECT id, CASE WHEN id = 3 THEN 'again' ELSE name END AS name, CASE WHEN id = 3 THEN 34 ELSE region END AS region FROM t")
_tell("ddl_create", "CREATE TABLE u (k TEXT PRIMARY KEY, ok BOOL); INSERT INTO u VALUES ('a', TRUE); INSERT INTO u VALUES ('b', FALSE)", "SELECT 'a' AS k, TRUE AS ok UNION ALL SELECT 'b', FALSE", "SELECT * FROM u")
_tell("ddl_drop", "DROP TABLE t; DROP TABLE IF EXISTS t; CREATE TABLE t (id INT PRIMARY KEY); INSERT INTO t VALUES (1)", "SELECT CAST(1 AS BIGINT) AS id")
_tell("ddl_add_column", "ALTER TABLE t ADD COLUMN age INT DEFAULT 42; UPDATE t SET age = 1 WHERE id = 2; INSERT INTO t VALUES (100, 'n', 1, 5)", "SELECT *, CAST(CASE WHEN id = 2 THEN 1 ELSE 42 END AS BIGINT) AS age FROM t UNION ALL SELECT 100, 'n', 1, 5")
_tell("ddl_drop_column", "ALTER TABLE t DROP COLUMN name", "SELECT id, region FROM t")
_tell("ddl_drop_and_add", "ALTER TABLE t DROP COLUMN name; ALTER TABLE t ADD COLUMN name TEXT DEFAULT 'new'", "SELECT id, region, 'new' AS name FROM t")
_tell("txn_commit", "BEGIN; DELETE FROM t WHERE id >= 10; INSERT INTO t VALUES (50, 'c', 1); COMMIT", "SELECT * FROM t WHERE id < 10 UNION ALL SELECT 50, 'c', 1")
_tell("txn_abort", "BEGIN; DELETE FROM t; INSERT INTO t VALUES (50, 'c', 1); ROLLBACK", "SELECT * FROM t")
_tell("script", "INSERT INTO t VALUES (60, 's', 6); UPDATE t SET region = 66 WHERE id = 60; DELETE FROM t WHERE id < 20;", "SELECT * FROM t WHERE id >= 20 UNION ALL SELECT 60, 's', 66")
_tell("agg_after_writes", "DELETE FROM t WHERE id = 1; UPDATE t SET region = 0 WHERE region = 4", "SELECT CASE WHEN region = 4 THEN 0 ELSE region END AS region, count(*) AS n, CAST(sum(id) AS BIGINT) AS s FROM t WHERE id != 1 GROUP BY 1", "SELECT region, COUNT(*) AS n, SUM(id) AS s FROM t GROUP BY region")


def _dml_insert_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    with _seeded(spark, sf_dir) as db:
        txn = db.begin()
        txn.insert_many("t", [(100 + k, f"n{k}", k) for k in range(30)])
        txn.commit()
        return db.rows_at("t")


_STORED = "SELECT o_orderkey AS id, o_custkey AS customer, o_orderstatus AS status FROM orders"


def _orders(spark: SparkSession, sf_dir: str) -> Database:
    """A table whose statements write more rows than a driver holds."""
    db = Database(spark, scratch_folder(spark))
    Session(db).execute("CREATE TABLE o (id INT PRIMARY KEY, customer INT, status TEXT)")
    db.load("o", external(spark, "orders", f"{sf_dir}/orders.parquet", "o_orderkey")[1].selectExpr("o_orderkey", "o_custkey", "o_orderstatus"))
    return db


def _large_dml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements on most rows of a table, in one transaction and in several."""
    with _orders(spark, sf_dir) as db:
        session = Session(db)
        session.execute("BEGIN; UPDATE o SET status = 'open' WHERE status = 'O'; DELETE FROM o WHERE customer < 30; COMMIT")
        session.execute("UPDATE o SET customer = id WHERE status = 'open'; DELETE FROM o WHERE status = 'P'")
        return session.dataframe("SELECT * FROM o")


def _large_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reader's view of a large table under updates, with a later reader's beside it."""
    with _orders(spark, sf_dir) as db:
        reader, writer = Session(db), Session(db)
        reader.execute("BEGIN")
        writer.execute("UPDATE o SET customer = 0 WHERE status = 'F'; DELETE FROM o WHERE status = 'O'")
        before = reader.dataframe("SELECT * FROM o").selectExpr("'before' AS seen", "*")
        return before.unionByName(writer.dataframe("SELECT * FROM o").selectExpr("'after' AS seen", "*"))


def _snapshot_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reader's view does not change under it."""
    with _seeded(spark, sf_dir) as db:
        reader, writer = Session(db), Session(db)
        reader.execute("BEGIN")
        writer.execute("UPDATE t SET region = 9; DELETE FROM t WHERE id < 10")
        return reader.dataframe("SELECT * FROM t")


def _time_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    with _seeded(spark, sf_dir) as db:
        session = Session(db)
        session.execute("UPDATE t SET region = 5 WHERE id < 3")
        then = db.next_ts - 1
        session.execute("DELETE FROM t; INSERT INTO t VALUES (1, 'later', 1)")
        db.compact("t")
        return db.rows_at("t", then)


def _si_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two writers of one row the first to commit wins."""
    with _seeded(spark, sf_dir) as db:
        one, two = Session(db), Session(db)
        two.execute("BEGIN")
        one.execute("UPDATE t SET name = 'first' WHERE id = 1")
        try:
            two.execute("UPDATE t SET name = 'second' WHERE id = 1; COMMIT")
        except Conflict:
            two.execute("ROLLBACK")
        return one.dataframe("SELECT * FROM t")


def _si_write_skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writers of different rows both commit, whatever they have read."""
    with _seeded(spark, sf_dir) as db:
        one, two = Session(db), Session(db)
        one.execute("BEGIN")
        two.execute("BEGIN")
        one.execute("UPDATE t SET region = 90 WHERE id = 1; COMMIT")
        two.execute("UPDATE t SET region = 91 WHERE id = 2; COMMIT")
        return one.dataframe("SELECT * FROM t")


def _txn_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point read that sees the transaction's own write."""
    with _seeded(spark, sf_dir) as db:
        txn = db.begin()
        txn.update("t", (4, "own", 44))
        return txn.table("t").where(F.col("id") == 4)


def _txn_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    with _seeded(spark, sf_dir) as db:
        txn = db.begin()
        txn.delete("t", 6)
        txn.insert("t", (7000, "own", 70))
        return R.range_scan(txn.table("t"), "id", 5, 8000)


def _recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store that was left with an open transaction, opened again twice."""
    root = scratch_folder(spark)
    db = Database(spark, root)
    Session(db).execute("CREATE TABLE t (id INT PRIMARY KEY, name TEXT, region INT)")
    db.load("t", external(spark, "nation", f"{sf_dir}/nation.parquet", "n_nationkey")[1])
    Session(db).execute("DELETE FROM t WHERE id = 5")
    lost = Session(db)
    lost.execute("BEGIN; DELETE FROM t; INSERT INTO t VALUES (1, 'lost', 1)")
    db.files.delete("LOCK")  # as if the process had died
    for _ in range(2):
        db = Database(spark, root)
        db.close()
    return db.rows_at("t")


def _compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    with _seeded(spark, sf_dir) as db:
        session = Session(db)
        session.execute("UPDATE t SET region = 3 WHERE id < 8; DELETE FROM t WHERE id = 9")
        db.compact("t", files=2)
        session.execute("INSERT INTO t VALUES (9, 'back', 1); UPDATE t SET region = 4 WHERE id = 0")
        return session.dataframe("SELECT * FROM t")


for _name, _query, _sql in (
    ("dml_insert_many", _dml_insert_many, "SELECT * FROM t UNION ALL SELECT 100 + k, 'n' || k, k FROM range(30) r(k)"),
    ("snapshot_read", _snapshot_read, "SELECT * FROM t"),
    ("time_travel", _time_travel, "SELECT id, name, CASE WHEN id < 3 THEN 5 ELSE region END AS region FROM t"),
    ("si_snapshot", _si_snapshot, "SELECT id, CASE WHEN id = 1 THEN 'first' ELSE name END AS name, region FROM t"),
    ("si_write_skew", _si_write_skew, "SELECT id, name, CASE WHEN id = 1 THEN 90 WHEN id = 2 THEN 91 ELSE region END AS region FROM t"),
    ("txn_get", _txn_get, "SELECT id, 'own' AS name, CAST(44 AS BIGINT) AS region FROM t WHERE id = 4"),
    ("txn_scan", _txn_scan, "SELECT * FROM t WHERE id >= 5 AND id <> 6 UNION ALL SELECT 7000, 'own', 70"),
    ("recovery", _recovery, "SELECT * FROM t WHERE id <> 5"),
    ("compaction", _compacted, "SELECT id, CASE WHEN id = 9 THEN 'back' ELSE name END AS name, CASE WHEN id = 0 THEN 4 WHEN id < 8 THEN 3 WHEN id = 9 THEN 1 ELSE region END AS region FROM t"),
):
    _add(_name, _query, f"WITH t AS ({_SEED}) {_sql}")


# Key-value view: events as a log of writes, a click deletes


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), (F.col("event_type") == "click").alias("deleted"), F.col("event_type").alias("value"))


_NEWEST = "SELECT user_id AS key, max(event_id) AS seq, arg_max(event_type, event_id) AS value FROM events GROUP BY user_id"

_add("kv_put_latest", lambda s, d: kv.latest(_log(s, d)).select("key", "seq", "value"), _NEWEST)
_add("kv_get", lambda s, d: kv.get(_log(s, d), 3), f"SELECT key, value FROM ({_NEWEST}) WHERE key = 3 AND value <> 'click'")
_add("kv_delete", lambda s, d: kv.latest(_log(s, d)).where("deleted").select("key"), f"SELECT key FROM ({_NEWEST}) WHERE value = 'click'")
_add("kv_iterate", lambda s, d: kv.iterate(_log(s, d)), f"SELECT key, value FROM ({_NEWEST}) WHERE value <> 'click'")
_add("kv_seek", lambda s, d: kv.seek(_log(s, d), 50), f"SELECT key, value FROM ({_NEWEST}) WHERE key >= 50 AND value <> 'click'")
_add("kv_snapshot", lambda s, d: kv.live(_log(s, d), 400), "SELECT user_id AS key, arg_max(event_type, event_id) AS value FROM events WHERE event_id <= 400 GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'click'")
_add("kv_compact", lambda s, d: kv.compact(_log(s, d)), f"SELECT key, seq, value = 'click' AS deleted, value FROM ({_NEWEST})")

_add("dml_large", _large_dml, f"WITH o AS ({_STORED}) SELECT id, CASE WHEN status = 'O' THEN id ELSE customer END AS customer, CASE WHEN status = 'O' THEN 'open' ELSE status END AS status FROM o WHERE customer >= 30 AND status <> 'P'")
_add("snapshot_large", _large_snapshot, f"WITH o AS ({_STORED}) SELECT 'before' AS seen, * FROM o UNION ALL SELECT 'after', id, CASE WHEN status = 'F' THEN 0 ELSE customer END, status FROM o WHERE status <> 'O'")
