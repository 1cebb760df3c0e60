"""Packing, token files, BPE round trips."""

import hashlib
import io
import struct
import zlib

import numpy as np
import pytest
import zstandard
from tokenizers import Tokenizer

from tessera.llm import packing, token_frames, tree_bpe
from tessera.llm.encoding import tokenizer_json

from .cases import empty, frame, odd, some

WORDS = Tokenizer.from_str(tokenizer_json("word_bpe_49k.json"))


def ids(text, end):
    return [*WORDS.encode(text or "", add_special_tokens=False).ids, end]


def crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


def check_pieces(rows, docs, capacity=2048):
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append(ids(r.text, 1))
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
        full = next(t for t in texts[r.doc_id] if len(t) == r.doc_tokens)
        assert r.ids_crc32 == crc(full[r.start : r.start + r.length])
    for doc_id, own in texts.items():
        assert sum(map(len, own)) == sum(r.length for r in by_doc[doc_id])
        if len(own) == 1:
            at = 0
            for r in sorted(by_doc[doc_id], key=lambda r: r.start):
                assert r.start == at
                at += r.length
    used = padded = 0
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= capacity
        used += at
        padded += at if at & (at - 1) == 0 else capacity
    return 1 - used / padded if padded else 0


def test_packing(spark):
    for n in (1, 5):
        docs = some(spark, sf="0.01").repartition(n)
        assert check_pieces(packing.pack(docs).collect(), docs) < 0.08
    assert check_pieces(packing.pack(odd(spark)).collect(), odd(spark)) < 1
    assert packing.pack(empty(spark)).count() == 0


def test_packing_with_ids_and_other_capacity(spark):
    docs = some(spark, 40)
    rows = packing.pack(docs, capacity=300, smallest=50, with_ids=True).collect()
    check_pieces(rows, docs, 300)
    assert all(crc(r.ids) == r.ids_crc32 for r in rows)


@pytest.mark.parametrize(("capacity", "smallest"), [(2048, 128), (300, 50), (7, 2), (1, 1), (1000, 1)])
def test_classes(capacity, smallest):
    bounds = packing.class_bounds(capacity, smallest)
    assert bounds[0] == capacity and bounds[-1] == 1 and bounds == sorted(set(bounds), reverse=True)
    for n in range(1, 3 * capacity, 7):
        assert sum(packing.cut(n, capacity, smallest)) == n and max(packing.cut(n, capacity, smallest)) <= capacity


def files(spark, docs, tmp_path, **kw):
    folder = f"file://{tmp_path}/frames"
    manifest = token_frames.write_frames(docs, folder, **kw).collect()
    return manifest, token_frames.read_frames(spark, folder).collect()


def test_token_frames(spark, tmp_path):
    docs = some(spark).repartition(3)
    manifest, rows = files(spark, docs, tmp_path)
    assert len(manifest) > 1
    at = 0
    for r, d in zip(sorted(rows, key=lambda r: r.doc_id), docs.orderBy("doc_id").collect(), strict=True):
        own = ids(d.text, 2)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, at, len(own), crc(own))
        at += len(own)


def test_token_frames_of_odd_rows(spark, tmp_path):
    _, rows = files(spark, odd(spark), tmp_path)
    want = sorted((r.doc_id if r.doc_id is not None else -1, crc(ids(r.text, 2))) for r in odd(spark).collect())
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.ids_crc32) for r in rows) == want
    spans = sorted((r.start, r.n_tokens) for r in rows)
    assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))
    assert files(spark, empty(spark), tmp_path / "e") == ([], [])


def test_token_frames_of_one_id(spark, tmp_path):
    """A doc_id that many rows share, or none, fills several files in order."""
    rows = [(None, f"nothing {k}") for k in range(300)] + [(7, f"seven {k}") for k in range(300)] + [(k, f"own {k}") for k in range(300)]
    folder = f"file://{tmp_path}/one"
    manifest = token_frames.write_frames(frame(spark, rows).repartition(3), folder, shard_docs=50).collect()
    assert sum(r.n_docs for r in manifest) == 900 and max(r.n_docs for r in manifest) <= 120
    read = sorted(((r.start, r.doc_id, r.ids_crc32, r.n_tokens) for r in token_frames.read_frames(spark, folder).collect()))
    assert [(d, c) for _, d, c, _ in read] == sorted(((d, crc(ids(t, 2))) for d, t in rows), key=lambda x: (x[0] is not None, x))
    assert read[0][0] == 0 and all(a[0] + a[3] == b[0] for a, b in zip(read, read[1:], strict=False))


def test_file_format():
    sink, packer = io.BytesIO(), zstandard.ZstdCompressor(level=3, write_checksum=True)
    docs = [(5, [1, 2, 3]), (None, [7]), (9, list(range(200_000)))]
    writer = token_frames.ShardWriter(sink)
    for doc_id, own in docs:
        writer.add(doc_id, len(own), *token_frames.pack_frames(np.array(own, "<u4").tobytes(), 4, packer))
    writer.close()
    data = sink.getvalue()
    # Any reader of the seekable format finds the table; any Zstandard reader the content.
    n, flag, magic = struct.unpack("<IBI", data[-9:])
    assert (n, flag, magic) == (2 + -(-200_000 // token_frames.FRAME_IDS), 0x80, 0x8F92EAB1)
    assert struct.unpack("<II", data[-9 - 12 * n - 8 : -9 - 12 * n]) == (0x184D2A5E, 12 * n + 9)
    reader = token_frames.ShardReader(io.BytesIO(data), 4)
    for k in (2, 0, 1):
        doc_id, own = reader.document(k)
        assert doc_id == docs[k][0] and np.frombuffer(own, "<u4").tolist() == docs[k][1]
    broken = bytearray(data)
    broken[int(reader.starts[0]) + 8] ^= 1
    reader = token_frames.ShardReader(io.BytesIO(bytes(broken)), 4)
    assert reader.document(1)[0] is None  # other frames are not touched
    with pytest.raises((ValueError, zstandard.ZstdError)):
        reader.document(0)
    with pytest.raises(ValueError):
        token_frames.ShardReader(io.BytesIO(data[:-1]), 4)


def test_tree_bpe(spark):
    library = Tokenizer.from_str(tokenizer_json("byte_bpe_50k.json"))
    long = ["y" * 3000 + " " + "abcé" * 700 + "<|endoftext|>q", "é" * 5000, "ab" * 2500 + " c"]
    for docs, kw in ((some(spark), {}), (odd(spark), {}), (odd(spark), {"leaf": 16, "part": 100, "spread": 1000}), (frame(spark, list(enumerate(long))), {"leaf": 8, "part": 64, "spread": 500})):
        want = sorted(_want(library, r) for r in docs.collect())
        got = tree_bpe.encode_decode(docs, with_ids=True, **kw).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
        assert all(hashlib.sha256(r.ids).hexdigest() == r.ids_sha256 for r in got)
    assert tree_bpe.encode_decode(empty(spark)).count() == 0


def _want(library, r):
    own = library.encode(r.text or "", add_special_tokens=False).ids
    text = library.decode(own, skip_special_tokens=False)
    return -1 if r.doc_id is None else r.doc_id, len(own), hashlib.sha256(np.array(own, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def test_files_say_the_width_of_their_ids():
    compressor = zstandard.ZstdCompressor(level=3, write_checksum=True)
    many = np.array([1, 70_000, 3], "<u4")
    for width, given in ((2, many % 60_000), (4, many)):
        sink = io.BytesIO()
        writer = token_frames.ShardWriter(sink, width)
        writer.add(5, 3, *token_frames.pack_frames(given.astype("<u4").tobytes(), width, compressor))
        writer.close()
        reader = token_frames.ShardReader(io.BytesIO(sink.getvalue()))
        assert reader.width == width and reader.document(0) == (5, given.astype("<u4").tobytes())
        with pytest.raises(ValueError):
            token_frames.ShardReader(io.BytesIO(sink.getvalue()), 6 - width)
