"""Exact duplicates by owners in Patricia tries.

Texts are equal when identical after each run of white space is one space.
Every task that reads texts puts them into a compressed radix trie whose
terminal nodes hold the smallest doc_id and the number of rows; when the trie
grows beyond TRIE_BYTES its largest subtrees are sent on and dropped.  So a text
that a third of all rows have leaves a task once (or once a spill), not once a
row.  What is left is partitioned by length and content hash; there, full byte
strings meet again in a trie, which settles equality whatever the hash says.
A row finds its owner by length and hash, in a join that adaptive execution can
split.  Should two different texts share length and SHA-256, the operator fails
rather than merging them.

Null text is empty; empty texts equal each other.  A null doc_id owns a text
only if no row has another one.  Rows repeated with the owner's doc_id all count
as kept in the decisions; deduplicate() leaves one of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import WHITE, Out, read, rows_of, texts

TRIE_BYTES = 48 << 20


class Node:
    __slots__ = ("label", "children", "owner", "count", "size")

    def __init__(self, label: bytes = b""):
        self.label, self.children, self.owner, self.count, self.size = label, {}, None, 0, 0


def _shared(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of a and b[at:]."""
    low, high = 0, min(len(a), len(b) - at)
    if a[:high] == b[at : at + high]:
        return high
    while low < high - 1:  # equal up to low, different up to high
        mid = (low + high) // 2
        if a[low:mid] == b[at + low : at + mid]:
            low = mid
        else:
            high = mid
    return low


class Trie:
    """A compressed radix trie from byte strings to (smallest id, rows)."""

    def __init__(self):
        self.root, self.size = Node(), 0

    def insert(self, key: bytes, owner: int | None, count: int = 1) -> None:
        node, at, added = self.root, 0, 0
        path = [node]
        while True:
            if at == len(key):
                break
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = Node(key[at:])
                added = len(child.label) + 300
                at = len(key)
            else:
                n = _shared(child.label, key, at)
                if n < len(child.label):
                    middle = Node(child.label[:n])
                    child.label = child.label[n:]
                    middle.children[child.label[0]] = child
                    middle.size = child.size
                    node.children[key[at]] = child = middle
                    added += 300
                at += n
            node = child
            path.append(node)
        node.owner = owner if node.count == 0 or node.owner is None else node.owner if owner is None else min(owner, node.owner)
        node.count += count
        for x in path:
            x.size += added
        self.size += added

    def pop_subtree(self) -> Iterator[tuple[bytes, int | None, int]]:
        """Takes the largest subtree below the root out of the trie."""
        if self.root.children:
            child = max(self.root.children.values(), key=lambda c: c.size)
            del self.root.children[child.label[0]]
            self.size -= child.size
            yield from _terminals(child)

    def drain(self) -> Iterator[tuple[bytes, int | None, int]]:
        root, self.root, self.size = self.root, Node(), 0
        yield from _terminals(root)


def _terminals(node: Node) -> Iterator[tuple[bytes, int | None, int]]:
    stack = [(node, node.label)]
    while stack:
        node, key = stack.pop()
        if node.count:
            yield key, node.owner, node.count
        stack.extend((c, key + c.label) for c in node.children.values())


_TEXT = pa.schema([("length", pa.int64()), ("hash", pa.binary()), ("text", pa.binary()), ("owner", pa.int64()), ("count", pa.int64())])
_OWNER = pa.schema([("length", pa.int64()), ("hash", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


def normalised(text):
    return F.regexp_replace(text, WHITE, " ")


def owners(docs: DataFrame, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """length, hash, keep_id, group_size: a row for each distinct text."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, out = Trie(), Out(_TEXT)

        def row(text: bytes, owner: int | None, count: int) -> bool:
            return out.add((len(text), hashlib.sha256(text).digest(), text, owner, count), len(text))

        for doc_id, text in rows_of(batches, "doc_id", "text"):
            trie.insert(text, doc_id)
            while trie.size > trie_bytes:
                for terminal in trie.pop_subtree():
                    if row(*terminal):
                        yield out.take()
        for terminal in trie.drain():
            if row(*terminal):
                yield out.take()
        yield from out.rest()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, out, key = Trie(), Out(_OWNER), None

        def finish() -> bool:
            own = list(trie.drain())
            if len(own) > 1:
                raise ValueError(f"different texts of {key[0]} bytes have the SHA-256 {key[1].hex()}")
            return bool(own) and out.add((*key, own[0][1], own[0][2]))

        for length, digest, text, owner, count in rows_of(batches, "length", "hash", "text", "owner", "count"):
            if (length, digest) != key:
                if key is not None and finish():
                    yield out.take()
                key = (length, digest)
            trie.insert(text, owner, count)
        if key is not None:
            finish()
        yield from out.rest()

    plain = texts(docs).select("doc_id", normalised(F.col("text")).cast("binary").alias("text"))
    found = plain.mapInArrow(gather, "length long, hash binary, text binary, owner long, count long")
    return found.repartition("length", "hash").sortWithinPartitions("length", "hash").mapInArrow(settle, "length long, hash binary, keep_id long, group_size long")


def _keyed(docs: DataFrame, plain) -> DataFrame:
    return docs.withColumns({"__length": F.octet_length(plain).cast("long"), "__hash": F.unhex(F.sha2(plain, 256))})


def _decided(docs: DataFrame) -> DataFrame:
    plain = _keyed(texts(docs), normalised(F.col("text"))).select("doc_id", "__length", "__hash")
    own = owners(docs).select(F.col("length").alias("__length"), F.col("hash").alias("__hash"), "keep_id", "group_size")
    return plain.join(own, ["__length", "__hash"]).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def decide(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    return _decided(docs).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("__hash")).alias("text_sha256"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows that stay, one of each group of equal texts, with docs' columns.

    Texts are dealt by doc_id, never by content: copies don't meet in a task."""
    gone = _decided(docs).where(~F.col("kept")).select(F.col("doc_id").alias("__id"), F.col("__hash").alias("__gone")).distinct()
    keyed = _keyed(docs, normalised(F.coalesce(F.col("text"), F.lit(""))))
    stay = keyed.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__gone")), "left_anti")
    return stay.dropDuplicates(["doc_id", "__hash"]).select(docs.columns)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide(read(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
