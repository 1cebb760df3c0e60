"""Token ids in independent Zstandard frames with a trailing seek table.

File format (little endian).  Every document's ids (2 bytes each where the
vocabulary allows it, else 4) fill one or more independent Zstandard frames of
at most FRAME_IDS ids; no frame holds two documents, so a reader decompresses
only the documents asked for.  Each frame carries Zstandard's own content
checksum.  Then follow two skippable frames: the document index (doc_id i64,
null flag u8, first frame u32, ids u64 of each document, then the bytes of an id
u8, and a crc32 of all that), and the seek table of the Zstandard seekable format: for each frame its
compressed size, decompressed size and the low 32 bits of the XXH64 of its
content, the number of frames, a descriptor byte (0x80: checksums), and the
magic number 0x8F92EAB1.  A file is read from its end: footer, seek table,
index, then the frames wanted.

A document without text has the end id alone.  Rows with one doc_id stay
separate documents, in the order of their ids' crc32; a null doc_id comes
first.  An empty table makes no file and no row.
"""

from __future__ import annotations

import bisect
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .encoding import tokenizer_json, worker_encoder
from .runtime import Out, read, rows_of, scratch_folder, texts, written

# Fixed values of the Zstandard (seekable) format.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEKABLE_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1

FRAME_IDS = 1 << 16
LEVEL = 3
#: Documents of a shard file, about; a shard is what one task writes.
SHARD_DOCS = 50_000

_INDEX = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("frame", "<u4"), ("n", "<u8")])
_SEEK = np.dtype([("packed", "<u4"), ("size", "<u4"), ("check", "<u4")])


def pack_frames(ids: bytes, width: int, compressor: zstandard.ZstdCompressor) -> tuple[bytes, bytes]:
    """32-bit ids to their frames, joined, and those frames' seek entries."""
    data = ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()
    step, frames, entries = FRAME_IDS * width, [], []
    for at in range(0, len(data), step):
        part = data[at : at + step]
        frames.append(compressor.compress(part))
        entries.append(struct.pack("<III", len(frames[-1]), len(part), xxhash.xxh64_intdigest(part) & 0xFFFFFFFF))
    return b"".join(frames), b"".join(entries)


class ShardWriter:
    """Appends documents' frames to a file; close() writes index and seek table."""

    def __init__(self, sink, width: int = 4):
        self.width, self.sink, self.seek, self.index, self.frames, self.ids = width, sink, [], [], 0, 0

    def add(self, doc_id: int | None, n: int, frames: bytes, entries: bytes) -> None:
        self.sink.write(frames)
        self.seek.append(entries)
        self.index.append(struct.pack("<qBIQ", doc_id or 0, doc_id is None, self.frames, n))
        self.frames += len(entries) // _SEEK.itemsize
        self.ids += n

    def close(self) -> None:
        index, seek = b"".join(self.index), b"".join(self.seek)
        index += struct.pack("<B", self.width)
        index += struct.pack("<I", zlib.crc32(index))
        self.sink.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        seek += struct.pack("<IBI", self.frames, 0x80, SEEKABLE_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_SEEK, len(seek)) + seek)


class ShardReader:
    """Random access to the documents of one file; width: bytes of an id, which
    the file must agree with where it is given."""

    def __init__(self, source, width: int | None = None):
        self.source = source
        end = source.seek(0, 2)
        n, descriptor, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEKABLE_MAGIC or descriptor != 0x80:
            raise ValueError("no seek table")
        size = n * _SEEK.itemsize
        start = end - 9 - size - 8
        if struct.unpack("<II", self._at(start, 8)) != (SKIPPABLE_SEEK, size + 9):
            raise ValueError("damaged seek table")
        self.seek = np.frombuffer(self._at(start + 8, size), _SEEK)
        self.starts = np.concatenate([[0], np.cumsum(self.seek["packed"], dtype=np.int64)])
        at = int(self.starts[-1])
        index = self._at(at + 8, start - at - 8)
        kind, held = struct.unpack("<II", self._at(at, 8))
        if kind != SKIPPABLE_INDEX or held != len(index) or zlib.crc32(index[:-4]) != struct.unpack("<I", index[-4:])[0]:
            raise ValueError("damaged index")
        self.index, self.width = np.frombuffer(index[:-5], _INDEX), index[-5]
        if self.width not in (2, 4) or width not in (None, self.width):
            raise ValueError("ids of another width")
        self._unpack = zstandard.ZstdDecompressor().decompress

    def _at(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def document(self, k: int) -> tuple[int | None, bytes]:
        """The doc_id and 32-bit ids of the k-th document."""
        row, parts = self.index[k], []
        frames = range(int(row["frame"]), int(row["frame"]) + -(-int(row["n"]) // FRAME_IDS))
        for f in frames:
            entry = self.seek[f]
            part = self._unpack(self._at(int(self.starts[f]), int(entry["packed"])), max_output_size=int(entry["size"]))
            if len(part) != entry["size"] or xxhash.xxh64_intdigest(part) & 0xFFFFFFFF != entry["check"]:
                raise ValueError(f"frame {f} is damaged")
            parts.append(part)
        data = b"".join(parts)
        if len(data) != int(row["n"]) * self.width:
            raise ValueError(f"document {k} is damaged")
        ids = data if self.width == 4 else np.frombuffer(data, "<u2").astype("<u4").tobytes()
        return None if row["null"] else int(row["doc_id"]), ids


_FRAMED = pa.schema([("shard", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("crc", pa.int64()), ("frames", pa.binary()), ("entries", pa.binary())])
_SHARD = pa.schema([("shard", pa.int64()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("shard", pa.int64())])


def write_frames(docs: DataFrame, folder: str, tokenizer: str = "word_bpe_49k.json", end_id: int = 2, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Encode the documents and write them to folder in ascending doc_id order.

    Returns the manifest (shard, file, n_docs, n_ids, start), also kept in
    folder/manifest.  Frames are made where the texts are read, so only
    compressed ids are shuffled, to shards that are ranges of doc_id; a doc_id
    that has several shards' rows, or null, is dealt on by ranges of its ids' crc32,
    in which its rows are ordered.  A shard file gets its final name only when whole, so repeated tasks are harmless."""
    spark, definition = docs.sparkSession, tokenizer_json(tokenizer)
    docs = texts(docs)
    width = 2 if _vocabulary(definition, end_id) <= 1 << 16 else 4
    n, nulls = docs.agg(F.count(F.lit(1)), F.count_if(F.col("doc_id").isNull())).first()
    shards = max(1, -(-n // shard_docs), min(n // 64, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    bounds = sorted(int(x) for x in docs.approxQuantile("doc_id", [k / shards for k in range(1, shards)], 0.2 / shards)) if shards > 1 else []
    without = max(1, -(-nulls * shards // max(n, 1)))  # shards of rows without id, the last one shared
    end = struct.pack("<I", end_id)

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, compressor, out = worker_encoder(definition), zstandard.ZstdCompressor(level=LEVEL, write_checksum=True), Out(_FRAMED)
        for doc_id, text in rows_of(batches, "doc_id", "text"):
            ids = encoder.ids(text) + end
            frames, entries = pack_frames(ids, width, compressor)
            crc = zlib.crc32(ids)
            if doc_id is None:
                shard = crc * without >> 32
            else:
                first, last = bisect.bisect_left(bounds, doc_id), bisect.bisect_right(bounds, doc_id)
                shard = without - 1 + first + (last > first) + (crc * (last - first) >> 32)
            if out.add((shard, doc_id, len(ids) // 4, crc, frames, entries), len(frames)):
                yield out.take()
        yield from out.rest()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        now, writer, sink, first = None, None, None, ""

        def finish():
            writer.close()
            sink.close()
            name = f"shard-{now:08d}.zst"
            fs.move(first, f"{root}/{name}")
            return pa.RecordBatch.from_pylist([{"shard": now, "file": name, "n_docs": len(writer.index), "n_ids": writer.ids}], _SHARD)

        for shard, doc_id, count, frames, entries in rows_of(batches, "shard", "doc_id", "n", "frames", "entries"):
            if shard != now:
                if writer:
                    yield finish()
                now, first = shard, f"{root}/.{shard}-{uuid.uuid4().hex}"
                sink = fs.open_output_stream(first)
                writer = ShardWriter(sink, width)
            writer.add(doc_id, count, frames, entries)
        if writer:
            yield finish()

    ready = docs.mapInArrow(framed, "shard long, doc_id long, n long, crc long, frames binary, entries binary")
    dealt = ready.repartitionById(len(bounds) + without, F.col("shard").cast("int")).sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "crc")
    found = written(dealt.select("shard", "doc_id", "n", "frames", "entries").mapInArrow(write, "shard long, file string, n_docs long, n_ids long"))
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    if shards and n:  # what failed tasks began
        for info in fs.get_file_info(pyarrow.fs.FileSelector(root)):
            if info.base_name.startswith(".") and info.is_file:
                fs.delete_file(info.path)
    # One row for each shard file.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return written(found.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0))), f"{folder}/manifest")


def _vocabulary(definition: str, *ids: int) -> int:
    spec = json.loads(definition)
    return 1 + max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens") or []), *ids])


def read_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Every document of the files: doc_id, start, n_tokens, ids_crc32."""
    manifest = spark.read.parquet(f"{folder}/manifest")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        out = Out(_READ)
        for shard, file, start in rows_of(batches, "shard", "file", "start"):
            with fs.open_input_file(f"{root}/{file}") as source:
                reader, at = ShardReader(source), start
                for k in range(len(reader.index)):
                    doc_id, ids = reader.document(k)
                    if out.add((doc_id, at, len(ids) // 4, zlib.crc32(ids), shard)):
                        yield out.take()
                    at += len(ids) // 4
        yield from out.rest()

    n = manifest.count()
    dealt = manifest.repartitionById(max(1, n), F.col("shard").cast("int")) if n else manifest
    return dealt.mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long, shard long").drop("shard")


def op3_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{scratch_folder(spark)}/frames"
    write_frames(read(spark, sf_dir, "documents"), folder)
    return read_frames(spark, folder)
