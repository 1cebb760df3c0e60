"""A database: catalog, commit log, timestamps and the files of tables.

    <root>/LOCK                 held while the store is open
    <root>/catalog.json         tables: id, schema, next column id
    <root>/commits/<ts>.json    one commit: its transaction and its files
    <root>/data/<table>/<ts or txn>-<n>   files of versions

A commit is its record: files that no record names don't exist, so a crash
leaves garbage and nothing to redo.  Records are written whole, synced and
never changed.  All state is rebuilt from them when the store is opened.

One process opens a store at a time; its threads share one lock.
"""

from __future__ import annotations

import os
import socket
import threading
import uuid
import warnings
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import Column, TableSchema, Value, type_of
from .sources.files import Files
from .sources.versions import SEQ, TOMB, TS, File, buffered, read_files, snapshot, stored
from .status import Conflict, InvalidArgument, IOErr, NotFound

#: Above every commit's timestamp.
OWN = (1 << 62) - 1
#: Rows that a statement may hold on the driver; beyond, they are staged as files.
SMALL = 1000
#: Files of changes after a table's base with which a commit compacts it.
COMPACT_AFTER = 20


@dataclass
class Table:
    id: str
    schema: TableSchema
    next_id: int
    created: int = 0
    files: list[File] = field(default_factory=list)


@dataclass
class Writes:
    """What a transaction wrote to one table: rows in memory and staged files.

    keys: the keys in memory, with whether the last version is a tombstone;
    fresh: every key written had no version before."""

    rows: list[tuple[tuple[Value, ...], bool, int]] = field(default_factory=list)
    staged: list[str] = field(default_factory=list)
    keys: dict[Value, bool] = field(default_factory=dict)
    fresh: bool = True


class Database:
    def __init__(self, spark: SparkSession, root: str, create_if_missing: bool = True, error_if_exists: bool = False):
        self.spark, self.files = spark, Files(spark, root)
        self.lock = threading.RLock()
        there = self.files.exists("catalog.json")
        if there and error_if_exists:
            raise InvalidArgument(f"{root} exists")
        if not there and not create_if_missing:
            raise NotFound(f"{root} does not exist")
        self._hold()
        self.tables: dict[str, Table] = {}
        self.external: dict[str, tuple[TableSchema, DataFrame]] = {}
        self.open: dict[int, Transaction] = {}
        self.ended: dict[int, str] = {}
        self.ddl = False
        self.next_ts, self.next_txn = 1, 1
        self._load(there)

    # Opening and closing

    def _hold(self) -> None:
        me = {"host": socket.gethostname(), "pid": os.getpid(), "id": uuid.uuid4().hex}
        if not self.files.write("LOCK", me):
            other = self.files.read("LOCK")
            if other["host"] != me["host"] or _alive(other["pid"]):
                raise IOErr(f"store is open in process {other['pid']} on {other['host']}")
            self.files.write("LOCK", me, overwrite=True)

    def _load(self, there: bool) -> None:
        if there:
            for t in self.files.read("catalog.json")["tables"]:
                self.tables[t["schema"]["name"]] = Table(t["id"], TableSchema.from_json(t["schema"]), t["next_id"], t["created"])
        else:
            self.files.make("commits")
            self._save()
        by_id = {t.id: t for t in self.tables.values()}
        for name in self.files.names("commits"):
            if not name.endswith(".json"):
                continue
            record = self.files.read(f"commits/{name}")
            self.next_ts = max(self.next_ts, record["ts"] + 1)
            self.next_txn = max(self.next_txn, record["txn"] + 1)
            self.ended[record["txn"]] = "Committed"
            for table, added in record["tables"].items():
                if table in by_id:
                    by_id[table].files += [File(self.files.uri(f["path"]), record["ts"], f["fresh"], f["base"], f["rows"]) for f in added]

    def close(self) -> None:
        with self.lock:
            for txn in list(self.open.values()):
                txn.abort()
            self.files.delete("LOCK")

    def __enter__(self) -> Database:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def _save(self) -> None:
        tables = [{"id": t.id, "schema": t.schema.to_json(), "next_id": t.next_id, "created": t.created} for t in self.tables.values()]
        self.files.write("catalog.json", {"tables": tables}, overwrite=True)

    # Catalog

    def register_parquet(self, name: str, path: str, key: str | None = None) -> None:
        """A read-only table over Parquet files."""
        from .sources.external import external

        with self.lock:
            if name in self.tables or name in self.external:
                raise InvalidArgument(f"table already exists: {name}")
            self.external[name] = external(self.spark, name, path, key)

    def get_table(self, name: str) -> TableSchema:
        with self.lock:
            if name in self.external:
                return self.external[name][0]
            if name not in self.tables:
                raise NotFound(f"table not found: {name}")
            return self.tables[name].schema

    def has_table(self, name: str) -> bool:
        return name in self.tables or name in self.external

    def table_names(self) -> list[str]:
        return sorted([*self.tables, *self.external])

    @property
    def open_txn_count(self) -> int:
        return len(self.open)

    def txn_state(self, txn: int) -> str:
        if txn in self.open:
            return "Open"
        if txn not in self.ended:
            raise NotFound("txn not found")
        return self.ended[txn]

    # Changes of schema: none while a transaction is open

    def _changing(self) -> None:
        if self.ddl:
            raise InvalidArgument("DDL in progress")
        if self.open:
            raise InvalidArgument("DDL requires no open transactions")

    def create_table(self, schema: TableSchema) -> None:
        schema.validate()
        with self.lock:
            self._changing()
            if self.has_table(schema.name):
                raise InvalidArgument(f"table already exists: {schema.name}")
            columns = tuple(replace(c, id=k) for k, c in enumerate(schema.columns))
            self.tables[schema.name] = Table(uuid.uuid4().hex[:12], TableSchema(schema.name, columns), len(columns), self.next_ts)
            self._save()

    def drop_table(self, name: str) -> None:
        with self.lock:
            self._changing()
            if name not in self.tables:
                raise NotFound(f"table not found: {name}")
            table = self.tables.pop(name)
            self._save()
            self.files.delete(f"data/{table.id}")

    def _own(self, name: str) -> Table:
        if name not in self.tables:
            self.get_table(name)
            raise InvalidArgument(f"table is read-only: {name}")
        return self.tables[name]

    def add_column(self, name: str, column: Column, default: Value) -> None:
        """Files stay as they are: rows without the column have the default."""
        if not column.name:
            raise InvalidArgument("column name is empty")
        if column.primary_key:
            raise InvalidArgument("cannot add a PRIMARY KEY column")
        if default is None:
            raise InvalidArgument("DEFAULT must not be NULL")
        if type_of(default) is not column.type:
            raise InvalidArgument("DEFAULT type does not match column type")
        with self.lock:
            self._changing()
            table = self._own(name)
            if table.schema.index(column.name) >= 0:
                raise InvalidArgument(f"duplicate column: {column.name}")
            added = replace(column, id=table.next_id, default=default)
            table.schema = replace(table.schema, columns=(*table.schema.columns, added))
            table.next_id += 1
            self._save()

    def drop_column(self, name: str, column: str) -> None:
        with self.lock:
            self._changing()
            table = self._own(name)
            k = table.schema.index(column)
            if k < 0:
                raise InvalidArgument(f"unknown column: {column}")
            if table.schema.columns[k].primary_key:
                raise InvalidArgument("cannot drop PRIMARY KEY column")
            table.schema = replace(table.schema, columns=table.schema.columns[:k] + table.schema.columns[k + 1 :])
            self._save()

    # Transactions

    def begin(self) -> Transaction:
        with self.lock:
            if self.ddl:
                raise InvalidArgument("DDL in progress")
            txn = Transaction(self, self.next_txn, self.next_ts - 1)
            self.next_txn += 1
            self.open[txn.id] = txn
            return txn

    def rows_at(self, name: str, ts: int | None = None) -> DataFrame:
        """The rows of a table as of a commit, of now by default."""
        with self.lock:
            if name in self.external:
                return self.external[name][1]
            table = self._table(name)
            ts = self.next_ts - 1 if ts is None else ts
            return snapshot(self.spark, table.schema, [f for f in table.files if f.ts <= ts])

    def _table(self, name: str) -> Table:
        if name not in self.tables:
            raise NotFound(f"table not found: {name}")
        return self.tables[name]

    def _record(self, txn: int, tables: dict[str, list[dict[str, Any]]]) -> int:
        ts = self.next_ts
        if not self.files.write(f"commits/{ts:020d}.json", {"ts": ts, "txn": txn, "tables": tables}):
            raise Conflict(f"commit {ts} exists")
        self.next_ts += 1
        for table in self.tables.values():
            for f in tables.get(table.id, []):
                table.files.append(File(self.files.uri(f["path"]), ts, f["fresh"], f["base"], f["rows"]))
        return ts

    def load(self, name: str, df: DataFrame) -> int:
        """Inserts many rows in one commit; the number of rows."""
        txn = self.begin()
        try:
            n = txn.insert_frame(name, df)
            txn.commit()
            return n
        except BaseException:
            if not txn.finished:
                txn.abort()
            raise

    def compact(self, name: str, files: int | None = None) -> bool:
        """Writes the table's newest rows as a new base.  Old files stay for
        snapshots before it.  False if there is nothing to gain."""
        with self.lock:
            table = self._own(name)
            if len(table.files) < 2 or any(t.writes.get(name) for t in self.open.values()):
                return False
            rows = self.rows_at(name)
            path = f"data/{table.id}/base-{uuid.uuid4().hex[:12]}"
            versions = rows.toDF(*(f"c{c.id}" for c in table.schema.columns)).withColumn(TOMB, F.lit(False)).withColumn(SEQ, F.lit(0).cast("long"))
            key = f"c{table.schema.key.id}"
            # Files in key order let point and range reads skip most of them.
            dealt = versions.repartitionByRange(files, key) if files else versions.repartitionByRange(key)
            dealt.sortWithinPartitions(key).write.parquet(self.files.uri(path))
            self._record(self._next_txn(), {table.id: [{"path": path, "fresh": False, "base": True, "rows": -1}]})
            return True

    def compact_if_due(self, name: str) -> None:
        """compact() once reads would have more than COMPACT_AFTER files of changes
        to combine.  The commit before it stands whatever becomes of this."""
        table = self._own(name)
        since = next((k for k, f in enumerate(reversed(table.files)) if f.base), len(table.files))
        if since > COMPACT_AFTER:
            try:
                self.compact(name)
            except Exception as e:
                warnings.warn(f"{name} was not compacted: {e}", stacklevel=2)

    def _next_txn(self) -> int:
        self.next_txn += 1
        self.ended[self.next_txn - 1] = "Committed"
        return self.next_txn - 1


def _alive(pid: int) -> bool:
    if pid == os.getpid():
        return True
    try:
        os.kill(pid, 0)
    except ProcessLookupError:
        return False
    except PermissionError:
        return True
    return True


class Transaction:
    """A snapshot and the writes on top of it."""

    def __init__(self, db: Database, id_: int, start_ts: int):
        self.db, self.id, self.start_ts = db, id_, start_ts
        self.writes: dict[str, Writes] = {}
        self.finished, self.seq = False, 0

    def _check(self) -> None:
        if self.finished:
            raise InvalidArgument("transaction finished")

    # Reading

    def schema(self, name: str) -> TableSchema:
        return self.db.get_table(name)

    def _own_rows(self, name: str, schema: TableSchema) -> DataFrame | None:
        w = self.writes.get(name)
        if not w or not (w.staged or w.rows):
            return None
        parts = []
        if w.staged:
            parts.append(read_files(self.db.spark, schema, [File(p, OWN) for p in w.staged]))
        if w.rows:
            parts.append(buffered(self.db.spark, schema, w.rows, OWN))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def table(self, name: str) -> DataFrame:
        """The rows that this transaction sees, its own writes included."""
        self._check()
        with self.db.lock:
            if name in self.db.external:
                return self.db.external[name][1]
            table = self.db._table(name)
            seen = [f for f in table.files if f.ts <= self.start_ts]
            return snapshot(self.db.spark, table.schema, seen, self._own_rows(name, table.schema))

    def get(self, name: str, key: Value) -> tuple[Value, ...] | None:
        schema = self.schema(name)
        found = self.table(name).where(F.col(f"`{schema.key.name}`") == F.lit(key)).limit(1).collect()
        return tuple(found[0]) if found else None

    def scan(self, name: str, start: Value = None, end: Value = None) -> Iterator[tuple[Value, ...]]:
        """Rows with keys in [start, end), in key order, a partition at a time."""
        schema = self.schema(name)
        key = F.col(f"`{schema.key.name}`")
        df = self.table(name)
        if start is not None:
            df = df.where(key >= F.lit(start))
        if end is not None:
            df = df.where(key < F.lit(end))
        for row in df.orderBy(key).toLocalIterator():
            yield tuple(row)

    # Writing

    def _begin_write(self, name: str) -> tuple[Table, Writes]:
        self._check()
        return self.db._own(name), self.writes.setdefault(name, Writes())

    def _conflicts(self, table: Table, name: str, keys: DataFrame | Sequence[Value]) -> None:
        """Another open transaction holds a key, or one was committed since."""
        small = not isinstance(keys, DataFrame)
        key = f"c{table.schema.key.id}"
        for other in self.db.open.values():
            w = other.writes.get(name)
            if other is self or not w or not (w.staged or w.rows):
                continue
            if small and not w.staged:
                if any(k in w.keys for k in keys):
                    raise Conflict("write-write conflict: key held by open txn")
                continue
            if self._meet(other._own_rows(name, table.schema).select(key), keys, key):
                raise Conflict("write-write conflict: key held by open txn")
        later = [f for f in table.files if f.ts > self.start_ts and not f.base]
        if later and self._meet(read_files(self.db.spark, table.schema, later).select(key), keys, key):
            raise Conflict("write-write conflict: key committed after snapshot")

    @staticmethod
    def _meet(versions: DataFrame, keys: DataFrame | Sequence[Value], key: str) -> bool:
        found = versions.where(F.col(key).isin(list(keys))) if not isinstance(keys, DataFrame) else versions.join(keys.toDF(key), key, "left_semi")
        return bool(found.limit(1).count())

    def _known(self, table: Table, keys: DataFrame | Sequence[Value]) -> bool:
        """Whether any version of one of the keys was ever committed."""
        if not table.files:
            return False
        key = f"c{table.schema.key.id}"
        return self._meet(read_files(self.db.spark, table.schema, table.files).select(key), keys, key)

    def _next(self) -> int:
        self.seq += 1
        return self.seq

    def insert(self, name: str, row: Sequence[Value]) -> None:
        self.insert_many(name, [row])

    def insert_many(self, name: str, rows: Sequence[Sequence[Value]]) -> int:
        """All rows or none."""
        with self.db.lock:
            table, w = self._begin_write(name)
            k, keys = table.schema.key_index, []
            for row in rows:
                table.schema.check_row(tuple(row))
                if row[k] in keys or w.keys.get(row[k]) is False:
                    raise InvalidArgument("duplicate primary key in transaction")
                keys.append(row[k])
            self._conflicts(table, name, keys)
            unwritten = [x for x in keys if x not in w.keys]
            if w.staged or (unwritten and table.files):
                visible = self.table(name).where(F.col(f"`{table.schema.key.name}`").isin(unwritten))
                if unwritten and visible.limit(1).count():
                    raise InvalidArgument("duplicate primary key")
            if w.fresh:
                w.fresh = len(unwritten) == len(keys) and not self._known(table, keys)
            for row, key in zip(rows, keys, strict=True):
                w.rows.append((tuple(row), False, self._next()))
                w.keys[key] = False
            return len(rows)

    def insert_frame(self, name: str, df: DataFrame) -> int:
        """Inserts a DataFrame's rows, columns in schema order."""
        with self.db.lock:
            table, w = self._begin_write(name)
            schema = table.schema
            if len(df.columns) != len(schema.columns):
                raise InvalidArgument("row column count mismatch")
            for c, kind in zip(schema.columns, df.schema.fields, strict=True):
                if kind.dataType != c.type.spark:
                    raise InvalidArgument(f"type mismatch in column: {c.name}")
            path = self._stage(table, df, False)
            rows = self.db.spark.read.schema(stored(schema)).parquet(path)
            nulls = rows.agg(*(F.count_if(F.col(f"c{c.id}").isNull()) for c in schema.columns))
            for c, n in zip(schema.columns, nulls.first(), strict=True):
                if n:
                    raise InvalidArgument(f"null not allowed in column: {c.name}")
            key = f"c{schema.key.id}"
            if rows.groupBy(key).count().where("count > 1").limit(1).count():
                raise InvalidArgument("duplicate primary key in transaction")
            keys = rows.select(key)
            self._conflicts(table, name, keys)
            if (table.files or w.rows or w.staged) and self.table(name).join(keys.toDF(schema.key.name), schema.key.name, "left_semi").limit(1).count():
                raise InvalidArgument("duplicate primary key")
            w.fresh = w.fresh and not w.rows and not w.staged and not self._known(table, keys)
            w.staged.append(path)
            return rows.count()

    def _stage(self, table: Table, df: DataFrame, tomb: bool) -> str:
        path = self.db.files.uri(f"data/{table.id}/{self.id}-{uuid.uuid4().hex[:12]}")
        out = df.toDF(*(f"c{c.id}" for c in table.schema.columns)).withColumn(TOMB, F.lit(tomb)).withColumn(SEQ, F.lit(self._next()).cast("long"))
        out.write.parquet(path)
        return path

    def write_frame(self, name: str, df: DataFrame, tomb: bool) -> int:
        """New versions, or tombstones, of rows that are visible; their number.
        All or none.  Few are held in memory, many are staged."""
        with self.db.lock:
            table, w = self._begin_write(name)
            few = df.limit(SMALL + 1).collect()
            if not few:
                return 0
            k = table.schema.key_index
            if len(few) <= SMALL and not w.staged:
                rows = [tuple(r) for r in few]
                for row in rows:
                    table.schema.check_row(row)
                self._conflicts(table, name, [r[k] for r in rows])
                w.fresh = False
                for row in rows:
                    w.rows.append((row, tomb, self._next()))
                    w.keys[row[k]] = tomb
                return len(rows)
            if w.rows:  # staged and held versions keep their order by seq
                w.staged.append(self._flush(table, w))
                w.rows = []
            path = self._stage(table, df, tomb)
            key = f"c{table.schema.key.id}"
            staged = self.db.spark.read.schema(stored(table.schema)).parquet(path)
            self._conflicts(table, name, staged.select(key))
            w.fresh = False
            w.staged.append(path)
            return staged.count()

    def _flush(self, table: Table, w: Writes) -> str:
        path = self.db.files.uri(f"data/{table.id}/{self.id}-{uuid.uuid4().hex[:12]}")
        rows = buffered(self.db.spark, table.schema, w.rows, 0).drop(TS)
        rows.coalesce(1).write.parquet(path)
        return path

    def update(self, name: str, row: Sequence[Value]) -> None:
        """Replaces the visible row of the same key."""
        schema = self.schema(name)
        schema.check_row(tuple(row))
        self._visible(name, row[schema.key_index])
        self.write_frame(name, self.db.spark.createDataFrame([tuple(row)], _spark_schema(schema)), False)

    def delete(self, name: str, key: Value) -> None:
        schema = self.schema(name)
        row = self._visible(name, key)
        self.write_frame(name, self.db.spark.createDataFrame([row], _spark_schema(schema)), True)

    def _visible(self, name: str, key: Value) -> tuple[Value, ...]:
        w = self.writes.get(name)
        if w and w.keys.get(key):
            raise NotFound("row already deleted in transaction")
        self._conflicts(self.db._own(name), name, [key])
        row = self.get(name, key)
        if row is None:
            raise NotFound("row not found")
        return row

    # Ending

    def commit(self) -> None:
        with self.db.lock:
            if self.finished:
                raise InvalidArgument("transaction already finished")
            record: dict[str, list[dict[str, Any]]] = {}
            try:
                for name, w in self.writes.items():
                    if not (w.rows or w.staged):
                        continue
                    table = self.db._own(name)
                    if w.keys and not w.staged:
                        self._conflicts(table, name, list(w.keys))
                    else:
                        self._conflicts(table, name, self._own_rows(name, table.schema).select(f"c{table.schema.key.id}"))
                    paths = [*w.staged, *([self._flush(table, w)] if w.rows else [])]
                    root = f"{self.db.files.root}/"
                    record[table.id] = [{"path": p.removeprefix(root), "fresh": w.fresh and len(paths) == 1 and _inserts(w), "base": False, "rows": len(w.rows)} for p in paths]
                if record:
                    self.db._record(self.id, record)
            except Exception:
                self._end("Aborted")
                raise
            self._end("Committed")
            for name in self.writes:
                self.db.compact_if_due(name)

    def abort(self) -> None:
        with self.db.lock:
            self._check()
            self._end("Aborted")

    def _end(self, state: str) -> None:
        self.finished = True
        self.db.open.pop(self.id, None)
        self.db.ended[self.id] = state
        if state == "Aborted":
            root = f"{self.db.files.root}/"
            for w in self.writes.values():
                for path in w.staged:
                    self.db.files.delete(path.removeprefix(root))


def _inserts(w: Writes) -> bool:
    return not any(tomb for _, tomb, _ in w.rows) and len({seq for _, _, seq in w.rows}) == len(w.keys or w.rows)


def _spark_schema(schema: TableSchema):
    from pyspark.sql import types as T

    return T.StructType([T.StructField(c.name, c.type.spark) for c in schema.columns])

