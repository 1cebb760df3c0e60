"""An ordered key-value view of a log of writes.

A log has rows (key, seq, deleted, value); the newest row of a key counts, and
a deleted key has none.  Keys and values are bytes and ordered as bytes.  The
functions work on logs of any size; KvStore keeps one: recent writes in memory
and in small synced log files, older ones in Parquet runs sorted by key.
"""

from __future__ import annotations

import base64
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..status import InvalidArgument, NotFound
from .files import Files

SCHEMA = "key binary, seq long, deleted boolean, value binary"
#: Writes held in memory before they become a run, and runs before they are merged.
FLUSH_AFTER, MERGE_AFTER = 50_000, 4


def latest(log: DataFrame, at: int | None = None) -> DataFrame:
    """The newest row of each key, tombstones too, as of sequence number at.
    max_by combines before the shuffle, however often a key was written."""
    seen = log if at is None else log.where(F.col("seq") <= at)
    newest = F.max_by(F.struct("seq", "deleted", "value"), "seq").alias("n")
    return seen.groupBy("key").agg(newest).select("key", "n.seq", "n.deleted", "n.value")


def live(log: DataFrame, at: int | None = None) -> DataFrame:
    return latest(log, at).where(~F.col("deleted")).select("key", "value")


def get(log: DataFrame, key, at: int | None = None) -> DataFrame:
    """No row or one; the key is pushed down to the files."""
    return live(log.where(F.col("key") == F.lit(key)), at)


def iterate(log: DataFrame, at: int | None = None) -> DataFrame:
    return live(log, at).orderBy("key")


def seek(log: DataFrame, start, at: int | None = None) -> DataFrame:
    """Live rows from the first key not below start, in order."""
    return live(log.where(F.col("key") >= F.lit(start)), at).orderBy("key")


def compact(log: DataFrame) -> DataFrame:
    """One row a key; tombstones are kept, as older runs may hold the key."""
    return latest(log).select("key", "seq", "deleted", "value")


class KvStore:
    def __init__(self, spark: SparkSession, root: str, create_if_missing: bool = True, error_if_exists: bool = False):
        self.spark, self.files, self.lock = spark, Files(spark, root), threading.RLock()
        there = self.files.exists("manifest.json")
        if there and error_if_exists:
            raise InvalidArgument(f"{root} exists")
        if not there and not create_if_missing:
            raise NotFound(f"{root} does not exist")
        if not there:
            self.files.make("log")
            self.files.write("manifest.json", {"runs": [], "seq": 0}, overwrite=True)
        state = self.files.read("manifest.json")
        self.runs: list[str] = state["runs"]
        self.flushed = self.seq = state["seq"]
        self.memory: list[tuple[bytes, int, bool, bytes | None]] = []
        self.unsynced: list[tuple[bytes, int, bool, bytes | None]] = []
        for name in self.files.names("log"):
            if name.endswith(".json"):
                for k, seq, deleted, v in self.files.read(f"log/{name}"):
                    if seq > self.flushed:
                        self.memory.append((base64.b64decode(k), seq, deleted, None if v is None else base64.b64decode(v)))
                        self.seq = max(self.seq, seq)
        self.memory.sort(key=lambda r: r[1])

    def put(self, key: bytes, value: bytes, sync: bool = False) -> None:
        self.write([(key, value)], sync)

    def delete(self, key: bytes, sync: bool = False) -> None:
        self.write([(key, None)], sync)

    def write(self, batch: list[tuple[bytes, bytes | None]], sync: bool = False) -> None:
        """All or none; a value of None deletes.  sync: survives a crash once this returns."""
        with self.lock:
            for key, value in batch:
                self.seq += 1
                row = (bytes(key), self.seq, value is None, None if value is None else bytes(value))
                self.memory.append(row)
                self.unsynced.append(row)
            if sync:
                self.sync()
            if len(self.memory) >= FLUSH_AFTER:
                self.flush()

    def sync(self) -> None:
        with self.lock:
            if self.unsynced:
                text = lambda b: None if b is None else base64.b64encode(b).decode()
                self.files.write(f"log/{self.seq:020d}.json", [(text(k), s, d, text(v)) for k, s, d, v in self.unsynced])
                self.unsynced = []

    def snapshot(self) -> int:
        """A number by which later reads see the store as it is now."""
        return self.seq

    def get(self, key: bytes, at: int | None = None) -> bytes | None:
        with self.lock:
            for k, seq, deleted, value in reversed(self.memory):
                if k == key and (at is None or seq <= at):
                    return None if deleted else value
            runs = list(self.runs)
        if not runs:
            return None
        rows = get(self._read(runs), key, at).collect()
        return bytes(rows[0]["value"]) if rows else None

    def _read(self, runs: list[str]) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(*(self.files.uri(r) for r in runs))

    def log(self) -> DataFrame:
        with self.lock:
            held = self.spark.createDataFrame(list(self.memory), SCHEMA)
            return held.unionByName(self._read(self.runs)) if self.runs else held

    def iterate(self, start: bytes | None = None, at: int | None = None) -> Iterator[tuple[bytes, bytes]]:
        """Live pairs in key order; later writes are not seen."""
        at = self.seq if at is None else at
        df = iterate(self.log(), at) if start is None else seek(self.log(), bytes(start), at)
        for row in df.toLocalIterator():
            yield bytes(row["key"]), bytes(row["value"])

    def flush(self) -> None:
        """Writes held in memory become a run."""
        with self.lock:
            if not self.memory:
                return
            self._add(self.spark.createDataFrame(self.memory, SCHEMA).coalesce(1).sortWithinPartitions("key", F.desc("seq")), self.runs, self.seq)
            self.memory, self.unsynced = [], []
            if len(self.runs) >= MERGE_AFTER:
                self.compact()

    def compact(self) -> None:
        """All runs become one.  Snapshots taken before see only what is newest."""
        with self.lock:
            if len(self.runs) > 1:
                old = self.runs
                self._add(compact(self._read(old)).repartitionByRange("key").sortWithinPartitions("key"), [], self.flushed)
                for run in old:
                    self.files.delete(run)

    def _add(self, rows: DataFrame, runs: list[str], top: int) -> None:
        run = f"runs/{uuid.uuid4().hex[:12]}"
        rows.write.parquet(self.files.uri(run))
        self.runs = [*runs, run]
        self.files.write("manifest.json", {"runs": self.runs, "seq": top}, overwrite=True)
        self.flushed = top
        for name in self.files.names("log"):
            if name.endswith(".json") and int(name.removesuffix(".json")) <= top:
                self.files.delete(f"log/{name}")

    def close(self) -> None:
        self.flush()
