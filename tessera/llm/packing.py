"""Harmonic packing of whole documents into sequences of fixed capacity.

Lengths fall into reciprocal-capacity classes: a class with upper length u
holds capacity // u pieces a sequence, always, so a worker fills its sequences
by counting and needs no other worker.  A document is first cut into pieces of
capacity, capacity/2, ... down to SMALLEST (the classes 1, 2, 4, ... whose
sequences fill exactly); what is left, shorter than SMALLEST, is one piece of a
small class.  Sequences that a worker leaves incomplete are regrouped over
GROUP workers at a time.  What is then left of the exact classes goes into
sequences of a power of two of tokens, which need no padding.

Null and empty texts have the end id alone.  Repeated rows are packed as often
as they occur; a null doc_id is kept as it is.  An empty table gives no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .encoding import tokenizer_json, worker_encoder
from .runtime import Out, read, rows_of, texts, written

CAPACITY = 2048
SMALLEST = 128
#: Workers whose incomplete sequences are regrouped together.
GROUP = 64
#: Ratio of the upper lengths of neighbouring small classes, about.
RATIO = 0.9


def class_bounds(capacity: int = CAPACITY, smallest: int = SMALLEST) -> list[int]:
    """Upper lengths of the classes, descending: halves of the capacity down to
    smallest, then reciprocals capacity // k for k growing by 1 / RATIO."""
    bounds, u = [], capacity
    while u >= smallest and u > 0:
        bounds.append(u)
        if u % 2:
            break
        u //= 2
    k = -(-capacity // max(1, smallest - 1))
    while capacity // k > 0 and smallest > 1:
        u = min(smallest - 1, capacity // k)
        if u < bounds[-1]:
            bounds.append(u)
        k = max(k + 1, int(k / RATIO))
    if bounds[-1] > 1:
        bounds.append(1)
    return bounds


def cut(n: int, capacity: int = CAPACITY, smallest: int = SMALLEST) -> list[int]:
    """The lengths of the pieces of a document of n ids, in order."""
    lengths, u = [capacity] * (n // capacity), capacity
    n %= capacity
    while u % 2 == 0 and u // 2 >= smallest:
        u //= 2
        if n >= u:
            lengths.append(u)
            n -= u
    while n >= u:  # an odd capacity has no halves
        lengths.append(u)
        n -= u
    return lengths + [n] * (n > 0)


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, capacity: int = CAPACITY, smallest: int = SMALLEST, with_ids: bool = False) -> DataFrame:
    """Pieces of documents with the sequence and offset where each lies.

    with_ids adds the piece's ids as an array."""
    definition = tokenizer_json(tokenizer)
    bounds = class_bounds(capacity, smallest)
    by_length = [0] * (capacity + 1)
    for k, u in enumerate(bounds):
        by_length[: u + 1] = [k] * (u + 1)
    counts = [capacity // u for u in bounds]
    fields = [("worker", pa.int64()), ("class", pa.int64()), ("rank", pa.int64()), ("sequence", pa.int64()), ("offset", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int64()))] * with_ids)
    end = struct.pack("<I", end_id)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, out, worker = worker_encoder(definition), Out(schema, rows=16384), TaskContext.get().partitionId()
        open_, ranks, sequences = [[] for _ in bounds], [0] * len(bounds), 0
        for doc_id, text in rows_of(batches, "doc_id", "text"):
            ids = encoder.ids(text) + end
            n, start = len(ids) // 4, 0
            for length in cut(n, capacity, smallest):
                k, part = by_length[length], ids[4 * start : 4 * (start + length)]
                piece = (doc_id, start, length, zlib.crc32(part), n) + ((list(struct.unpack(f"<{length}I", part)),) if with_ids else ())
                start += length
                open_[k].append(piece)
                if len(open_[k]) == counts[k]:
                    offset = 0
                    for piece in open_[k]:
                        if out.add((worker, k, None, sequences, offset, *piece)):
                            yield out.take()
                        offset += piece[2]
                    open_[k], sequences = [], sequences + 1
        for k, pieces in enumerate(open_):
            for rank, piece in enumerate(pieces):
                if out.add((worker, k, rank, None, None, *piece)):
                    yield out.take()
        yield from out.rest()

    kinds = {pa.int64(): "long", pa.list_(pa.int64()): "array<long>"}
    pieces = written(texts(docs).mapInArrow(fill, ", ".join(f"`{f.name}` {kinds[f.type]}" for f in schema)))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]

    # Full sequences of a worker: even numbers; regrouped ones: odd numbers.
    full = pieces.where(F.col("sequence").isNotNull()).withColumn("sequence_id", (F.col("worker") * (1 << 40) + F.col("sequence")) * 2).select(columns)
    left = pieces.where(F.col("sequence").isNull()).withColumn("group", F.floor(F.col("worker") / GROUP))
    # At most GROUP times a class's count of rows share a window.
    key = Window.partitionBy("group", "class")
    inside = key.orderBy("worker", "rank")
    count = F.get(F.lit(counts), F.col("class").cast("int")).cast("long")
    exact = F.col("class") < F.lit(len([u for u in bounds if capacity % u == 0 and u & (u - 1) == 0 and u >= smallest]))
    left = left.select("*", count.alias("per"), (F.row_number().over(inside) - 1).cast("long").alias("at"), F.count(F.lit(1)).over(key).alias("of"))
    rest, whole = F.col("of") % F.col("per"), F.col("of") - F.col("of") % F.col("per")
    # The rest of an exact class is dealt by the binary digits of its number:
    # the piece at place p is in the block of the highest digit where p and
    # the number differ, and blocks start where higher digits end.
    place = F.col("at") - whole
    differ = place.bitwiseXOR(rest)
    digit = F.floor(F.log2(differ.cast("double"))).cast("int")
    block = F.when((F.col("at") >= whole) & exact, digit).otherwise(F.lit(-1))
    # class < 2**10, blocks < 2**10, sequences of a group and class < 2**20
    number = F.floor(F.col("at") / F.col("per"))
    left = left.withColumn("block", block)
    sequence = ((F.col("group") * (1 << 10) + F.col("class")) * (1 << 20) + number) * 32 + F.col("block") + 1
    left = left.withColumn("sequence_id", sequence * 2 + 1)
    before = Window.partitionBy("group", "class", "sequence_id").orderBy("worker", "rank").rowsBetween(Window.unboundedPreceding, -1)
    left = left.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    return full.unionByName(left.select(columns))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
