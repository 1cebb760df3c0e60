"""Byte-pair encoding by tree concatenation, and decoding.

A text's pre-tokens are encoded on their own.  One that is long and unsplit is
halved down to LEAF bytes; the halves' ids are joined by re-encoding a window
around the join, which grows on either side until its first and last token are
the ones that stood there before.  Two adjacent tokens of a valid encoding stay
valid, and a row of tokens of which every adjacent pair is valid is the encoding
of its text; so from there on both sides agree exactly.

Documents with an unsplit run of at least SPREAD characters have the halves
encoded by different tasks and then joined; all others are encoded where they
are read.

Null text is empty; it has no ids and decodes to the empty text.  Repeated rows
and null doc_ids are encoded as they come.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .encoding import Encoder, byte_alphabet, to_alphabet, tokenizer_json
from .runtime import Out, hold, read, rows_of, texts

LEAF = 512
#: Bytes of a leaf that is a row of its own, and characters of a run that makes a document spread.
PART, SPREAD = 1 << 15, 1 << 16


class TreeBPE:
    """encode(text) and decode(ids) with a byte-level tokenizer."""

    def __init__(self, definition: str, leaf: int = LEAF):
        spec, self.leaf = json.loads(definition), max(1, leaf)
        self.encoder = Encoder(definition, lambda mapped: np.array(self.tree(mapped), "<u4").tobytes())
        if self.encoder.shape != "bytes":
            raise ValueError("tree concatenation needs a byte-level tokenizer without normaliser")
        self.model = self.encoder.model
        vocabulary = {k: v for v, k in spec["model"]["vocab"].items()}
        self.mapped = [vocabulary.get(k, "") for k in range(max(vocabulary) + 1)]
        back = {c: b for b, c in enumerate(byte_alphabet())}
        self.bytes = {k: bytes(map(back.__getitem__, v)) for k, v in vocabulary.items()}
        self.bytes |= {t["id"]: t["content"].encode() for t in spec.get("added_tokens") or []}
        self.halves = self.windows = 0

    def direct(self, mapped: str) -> list[int]:
        return [t.id for t in self.model.tokenize(mapped)]

    def tree(self, mapped: str) -> list[int]:
        """The ids of one pre-token, given in the byte alphabet."""
        if len(mapped) <= self.leaf:
            return self.direct(mapped)
        mid = len(mapped) // 2
        self.halves += 2
        return self.join(self.tree(mapped[:mid]), self.tree(mapped[mid:]))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The ids of two neighbouring parts' joined text from the parts' ids."""
        if not left or not right:
            return left + right
        n = 2
        while True:
            a, b = left[-n:], right[:n]
            again = self.direct("".join(self.mapped[i] for i in a) + "".join(self.mapped[i] for i in b))
            self.windows += 1
            whole_left, whole_right = n >= len(left), n >= len(right)
            if (whole_left or again[0] == a[0]) and (whole_right or again[-1] == b[-1]):
                return left[: len(left) - len(a)] + again + right[len(b) :]
            n *= 2

    def joined(self, parts: list[list[int]]) -> list[int]:
        while len(parts) > 1:
            parts = [self.join(*parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        return parts[0] if parts else []

    def encode(self, text: str) -> bytes:
        return self.encoder.ids(text)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")

    def parts(self, text: str, part: int) -> Iterator[tuple[int, str | int]]:
        """(kind, what) in order: 0 a short pre-token, 1 the first and 2 a later
        part of a long one, 3 a special token's id."""
        for piece in self.encoder.split(text):
            if isinstance(piece, int):
                yield 3, piece
            elif len(piece) <= part:
                yield 0, piece
            else:
                for at in range(0, len(piece), part):
                    yield 2 - (at == 0), piece[at : at + part]


@lru_cache(4)
def _tree(definition: str, leaf: int) -> TreeBPE:
    return TreeBPE(definition, leaf)


def worker_tree(definition: str, leaf: int) -> TreeBPE:
    hold("tree", _tree.cache_clear)
    return _tree(definition, leaf)


_DONE = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
_PART = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int64()), ("kind", pa.int64()), ("part", pa.string()), ("ids", pa.binary())])
_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_decode(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", leaf: int = LEAF, part: int = PART, spread: int = SPREAD, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text of every row;
    with_ids adds the ids (binary, little-endian 32-bit) and the decoded text."""
    definition = tokenizer_json(tokenizer)
    schema = pa.schema([*_DONE, ("ids", pa.binary()), ("decoded", pa.string())]) if with_ids else _DONE
    kinds = _SCHEMA + ", ids binary, decoded string" * with_ids

    def digest(doc_id: int | None, ids: bytes, tree: TreeBPE) -> tuple:
        text = tree.decode(ids)
        row = (doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        return row + ((ids, text) if with_ids else ())

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, out = worker_tree(definition, leaf), Out(schema)
        for doc_id, text in rows_of(batches, "doc_id", "text"):
            ids = tree.encode(text)
            if out.add(digest(doc_id, ids, tree), len(ids) * with_ids):
                yield out.take()
        yield from out.rest()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, out = worker_tree(definition, leaf), Out(_PART)
        for row, doc_id, text in rows_of(batches, "row", "doc_id", "text"):
            place, ready = 0, []

            for kind, what in tree.parts(text, part):
                if kind == 0:
                    ready.extend(tree.tree(what))
                elif kind == 3:
                    ready.append(what)
                else:
                    if ready:
                        out.add((row, doc_id, place, 0, None, np.array(ready, "<u4").tobytes()), 4 * len(ready))
                        place, ready = place + 1, []
                    if out.add((row, doc_id, place, kind, what, None), len(what)):
                        yield out.take()
                    place += 1
            out.add((row, doc_id, place, 0, None, np.array(ready, "<u4").tobytes()), 4 * len(ready))
        yield from out.rest()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, out = worker_tree(definition, leaf), Out(_PART)
        for row, doc_id, place, kind, what, ids in rows_of(batches, "row", "doc_id", "place", "kind", "part", "ids"):
            if kind:
                ids = np.array(tree.tree(what), "<u4").tobytes()
            if out.add((row, doc_id, place, kind, None, ids), len(ids)):
                yield out.take()
        yield from out.rest()

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, out = worker_tree(definition, leaf), Out(schema)
        now, of, done, open_ = None, None, [], []

        def close():
            if open_:
                done.append(np.array(tree.joined(open_), "<u4").tobytes())

        for row, doc_id, _, kind, ids in rows_of(batches, "row", "doc_id", "place", "kind", "ids"):
            if row != now:
                close()
                if now is not None and out.add(digest(of, b"".join(done), tree), sum(map(len, done))):
                    yield out.take()
                now, of, done, open_ = row, doc_id, [], []
            if kind != 2:
                close()
                open_ = []
            if kind:
                open_.append(np.frombuffer(ids, "<u4").tolist())
            else:
                done.append(ids)
        close()
        if now is not None:
            out.add(digest(of, b"".join(done), tree))
        yield from out.rest()

    docs = texts(docs)
    long_run = (F.length("text") >= spread) & F.col("text").rlike(f"(?:^|[ \\n])[^ \\n]{{{spread}}}")
    short = docs.where(~long_run).mapInArrow(whole, kinds)
    parts = docs.where(long_run).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    layout = "row long, doc_id long, place long, kind long, part string, ids binary"
    encoded = parts.mapInArrow(split, layout).repartition("row", "place").mapInArrow(encode, layout).drop("part")
    spread_out = encoded.repartition("row").sortWithinPartitions("row", "place").mapInArrow(combine, kinds)
    return short.unionByName(spread_out)


def op10_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(read(spark, sf_dir, "documents"))
