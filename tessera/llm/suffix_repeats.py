"""Repeated byte strings by common-prefix interval trees of suffix arrays.

Finds every byte covered by a string of MIN bytes that also starts elsewhere.

Where to look.  Of the K-byte strings in each window of MIN bytes the one with
the least hash is the window's anchor; equal windows have equal anchors at equal
places, so a repeat is found among suffixes that start at one anchor string.
The windows of one anchor make a context: the bytes from the first window's
start to the last one's end.  Equal contexts are one class; the windows of a
class that occurs twice are repeats.

The suffix array.  Classes that share an anchor string but differ make a group.
The group's anchor suffixes are sorted (a suffix array of these positions) with
the lengths of the neighbours' common prefixes; a scan with a stack gives the
tree of common-prefix intervals.  Inside each interval the same is done for the
bytes before the anchor, which gives the left-diverse sets of its members: the
maximal repeats, each with all its members.  All intervals above a member are
looked at, not its neighbours alone, so long extensions on either side are
found.  Those of MIN bytes cover what is removed.

Groups of more than GROUP classes, such as the rims of a passage that very many
documents hold, are not given to one task: their part of the suffix array is
split on longer prefixes.  Windows are dealt into blocks of neighbouring places;
the windows of a block have their middle in common, so members that agree in one
agree in that middle, which becomes the anchor of a group of its own.  Equal
members are collapsed (counted by hash, which combines before the shuffle), and
each such group has its own tree; one that is still too large is split again by
smaller blocks, in the end single windows, where members agree wholly.

Texts are UTF-8 bytes, null text is empty.  Equality of classes, blocks and
whole texts is by hashes of 127 bits or more with their keys.  Texts that occur twice are
repeated as wholes if they have MIN bytes.  Repeated rows and null doc_ids count
like others; a row is told by a hash of its doc_id and text and one of its text.
An empty table gives no rows.

A passage can also be measured in words: the same search then runs over texts in
which every word is a code of CODE bytes, its hash, so that WORDS words are as many
bytes whatever their lengths are and whatever white space parts them.  All places
and lengths are then whole words (a coding's unit).  Both searches are one run: the
lowest bit of an anchor's hash says in which coding it was found, so groups of the
two never meet.

dig() gives what is removed of each row, deduplicate() the rows with what is
left of their texts, and repeat_groups() the maximal repeats themselves with all
the places where they occur.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .exact_dedup import _shared as shared_prefix
from .runtime import Out, read, release, rows_of, texts, written
from .words import mixed, word_hashes

MIN, K = 400, 64
#: Words of a passage that deduplicate() also takes out, and bytes of a word's code.
WORDS, CODE = 51, 8
#: Classes of a group that one task sorts, and places of a block by which larger ones are split, again and again.
GROUP, BLOCKS = 250, (64, 16, 4, 1)
#: Bytes of text that are anchored at once.
CHUNK = 1 << 19
#: Ids that may be broadcast to thin a scan (8 MB of them); more are joined.
BROADCAST_ROWS = 1_000_000
#: The same for keys of texts, which are longer (13 MB).
BROADCAST_KEYS = 200_000

_B = 0x9E3779B97F4A7C15 | 1
_POSITION = 20


class Coding(NamedTuple):
    """How a text becomes bytes, and of how many of them a place is a multiple."""

    of: Callable[[str], bytes]
    unit: int


def in_words(text: str) -> bytes:
    """The codes of a text's words, which ASCII white space separates."""
    return word_hashes(text.encode().split()).tobytes()


#: A search's number, the lowest bit of its hashes, is its coding's place here.
CODINGS = Coding(str.encode, 1), Coding(in_words, CODE)


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A value for each byte, and powers of the base and of its inverse."""
    size = CHUNK + 2 * MIN + 8
    byte = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_B))
    up, down = np.full(size, _B, np.uint64), np.full(size, pow(_B, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return byte, np.multiply.accumulate(up), np.multiply.accumulate(down)


def _gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k bytes or codes."""
    byte, up, down = _tables()
    value = byte[data] if data.dtype == np.uint8 else mixed(data)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(value * up[: len(data)], out=sums[1:])
    return mixed((sums[k:] - sums[:-k]) * down[: len(data) - k + 1])


def _window_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of width values."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: bytes, least: int = MIN, k: int = K, unit: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and place of each anchor of a text, and its first and last window."""
    found: list[tuple[np.ndarray, ...]] = []
    units = np.frombuffer(data, np.uint8 if unit == 1 else np.uint64)
    least, k = least // unit, k // unit
    last = len(units) - least
    for at in range(0, last + 1, CHUNK):
        part = units[at : at + CHUNK + least - 1]
        h = _gram_hashes(part, k)
        # The first of equal hashes counts, as the place is in the lowest bits.
        mask = np.uint64((1 << _POSITION) - 1)
        place = (_window_least((h & ~mask) | np.arange(len(h), dtype=np.uint64), least - k + 1) & mask).astype(np.int64)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        end = np.append(first[1:], len(place)) - 1
        found.append((h[place[first]], place[first] + at, first + at, end + at))
    if not found:
        return (np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3)))
    h, p, lo, hi = (np.concatenate(x) for x in zip(*found, strict=True))
    if len(found) > 1:  # an anchor on both sides of a chunk's end is one
        new = np.append(True, p[1:] != p[:-1])
        h, p, lo = h[new], p[new], lo[new]
        hi = np.append(hi[np.flatnonzero(new)[1:] - 1], hi[-1])
    return h, p * unit, lo * unit, hi * unit


def classes(data: bytes, least: int = MIN, k: int = K, unit: int = 1) -> tuple[np.ndarray, ...]:
    """anchors() with a hash of each context and of where the anchor is in it."""
    h, p, lo, hi = anchors(data, least, k, unit)
    context = [xxhash.xxh3_64_intdigest(data[a : b + least], (x - a) << 20 | b - a) for x, a, b in zip(p.tolist(), lo.tolist(), hi.tolist(), strict=True)]
    return h.view(np.int64), np.array(context, np.uint64).view(np.int64), p, lo, hi


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of every interval of a common-prefix array, where
    lcp[i] belongs to neighbours i and i + 1: a scan with a stack."""
    stack: list[tuple[int, int]] = []
    for i, depth in enumerate([*lcp, -1]):
        first = i
        while stack and stack[-1][0] > depth:
            own, first = stack.pop()
            yield own, first, i
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


def maximal_repeats(members: list[tuple[bytes, int]], least: int = MIN, unit: int = 1) -> Iterator[tuple[int, int, list[int]]]:
    """For contexts (bytes, place of the anchor in them) of one anchor string:
    (left, right, members) of every maximal repeat of least bytes or more around
    the anchor, with all members that have it.

    The sorted suffixes from the anchor on give the intervals of common right
    extension.  Inside one, the intervals of common left extension are those
    whose members differ in the byte before, so each is left-diverse; a group
    that agrees further to the right belongs to a deeper interval."""
    common_units = lambda x, y: shared_prefix(x, y, 0) // unit * unit
    n = len(members)
    right = [data[a:] for data, a in members]
    left = [data[:a][::-1] for data, a in members]
    order = sorted(range(n), key=right.__getitem__)
    lcp = [common_units(right[a], right[b]) for a, b in zip(order, order[1:], strict=False)]
    place, rank = [0] * n, [0] * n
    for r, m in enumerate(order):
        place[m] = r
    for r, m in enumerate(sorted(range(n), key=left.__getitem__)):
        rank[m] = r
    for depth, first, last in intervals(lcp):
        near = sorted(order[first : last + 1], key=rank.__getitem__)
        common = [common_units(left[a], left[b]) for a, b in zip(near, near[1:], strict=False)]
        for extension, low, high in intervals(common):
            if extension + depth >= least:
                group = near[low : high + 1]
                ends = min(group, key=place.__getitem__), max(group, key=place.__getitem__)
                if common_units(right[ends[0]], right[ends[1]]) == depth:
                    yield extension, depth, group


def group_repeats(members: list[tuple[bytes, int]], least: int = MIN, unit: int = 1) -> list[list[tuple[int, int]]]:
    """The spans of each context, from its anchor, that a maximal repeat covers.

    All of them hold the anchor, so a context's are one: only its ends are held,
    as the members of nested intervals can be very many."""
    before, after = [-1] * len(members), [0] * len(members)
    for extension, depth, group in maximal_repeats(members, least, unit):
        for m in group:
            if extension > before[m]:
                before[m] = extension
            if depth > after[m]:
                after[m] = depth
    return [[(-b, a)] if b >= 0 else [] for b, a in zip(before, after, strict=True)]


_DOC = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("words", pa.int64()), ("key", pa.string()), ("h", pa.list_(pa.int64())), ("e", pa.list_(pa.int64())), ("p", pa.list_(pa.int64())), ("lo", pa.list_(pa.int64())), ("hi", pa.list_(pa.int64()))])
_CONTEXT = pa.schema([("h", pa.int64()), ("e", pa.int64()), ("c", pa.int64()), ("hot", pa.bool_()), ("at", pa.int64()), ("data", pa.binary())])
_SPANS = pa.schema([("h", pa.int64()), ("e", pa.int64()), ("from", pa.int64()), ("to", pa.int64())])
_PIECE = pa.schema([("h", pa.int64()), ("e", pa.int64()), ("c", pa.int64()), ("g", pa.int64()), ("f", pa.int64()), ("r", pa.int64()), ("size", pa.int64()), ("shift", pa.int64())])
_MEMBER = pa.schema([("h", pa.int64()), ("e", pa.int64()), ("c", pa.int64()), ("at", pa.int64()), ("data", pa.binary())])
_REPEAT = pa.schema([("h", pa.int64()), ("e", pa.int64()), ("repeat", pa.string()), ("before", pa.int64()), ("length", pa.int64())])
_KINDS = {pa.int64(): "long", pa.string(): "string", pa.bool_(): "boolean", pa.binary(): "binary", pa.list_(pa.int64()): "array<long>"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"`{f.name}` {_KINDS[f.type]}" for f in schema)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def searched(text: str, leasts: tuple[int, ...], k: int, only: set[int] | None = None) -> Iterator[tuple[int, bytes, tuple[np.ndarray, ...]]]:
    """(number, coded text, classes) of each search; leasts: the bytes that a
    repeat has in each coding."""
    for number, (least, coding) in enumerate(zip(leasts, CODINGS, strict=False)):
        if only is None or number in only:
            data = coding.of(text)
            h, *rest = classes(data, least, k, coding.unit)
            yield number, data, (h & np.int64(-2) | np.int64(number), *rest)


def anchored(docs: DataFrame, leasts: tuple[int, ...], k: int) -> DataFrame:
    """Every row with its classes; key is the SHA-256 of the text, words are
    counted where they are searched."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(_DOC, rows=1024)
        for a, b, doc_id, text in rows_of(batches, "a", "b", "doc_id", "text"):
            own = list(searched(text, leasts, k))
            found = [np.concatenate(x) for x in zip(*(f for _, _, f in own), strict=True)]
            words = len(own[1][1]) // CODE if len(own) > 1 else 0
            if out.add((a, b, doc_id, len(own[0][1]), words, hashlib.sha256(own[0][1]).hexdigest(), *found), 40 * len(found[0])):
                yield out.take()
        yield from out.rest()

    return docs.select("a", "b", "doc_id", "text").mapInArrow(find, _ddl(_DOC))


def thinned(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """df's rows whose column is in ids, or all rows where ids are too many to
    be broadcast: only for use before a join that decides."""
    return df.join(F.broadcast(ids), column, "left_semi") if ids.count() <= BROADCAST_ROWS else df


def contexts(docs: DataFrame, wanted: DataFrame, leasts: tuple[int, ...], k: int) -> DataFrame:
    """The context of one occurrence of each wanted class (h, e, c, hot, a)."""
    by_doc = written(wanted.groupBy("a").agg(F.collect_list(F.struct("h", "e", "c", "hot")).alias("want")))
    need = thinned(docs.select("a", "text"), by_doc.select("a"), "a").join(by_doc, "a").select("text", *(F.col(f"want.{c}").alias(c) for c in ("h", "e", "c", "hot")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(_CONTEXT)
        for text, *want in rows_of(batches, "text", "h", "e", "c", "hot"):
            left = {(h, e): more for h, e, *more in zip(*want, strict=True)}
            for number, data, (h, e, p, lo, hi) in searched(text, leasts, k, {h & 1 for h, _ in left}):
                least = leasts[number]
                for key, x, a, b in zip(zip(h.tolist(), e.tolist(), strict=True), p.tolist(), lo.tolist(), hi.tolist(), strict=True):
                    if more := left.pop(key, None):
                        if out.add((*key, *more, x - a, data[a : b + least]), b - a + least):
                            yield out.take()
        yield from out.rest()

    return need.mapInArrow(cut, _ddl(_CONTEXT))


def _by_group(found: DataFrame, each: Callable[[list[tuple], int], Iterator[tuple[int, tuple]]], schema: pa.Schema) -> DataFrame:
    """h, e and what each() says of the members (number, values) of every group h
    that has two or more classes, given the search's number; found: h, e, c, at, data."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now, members = Out(schema), None, {}

        def finish() -> Iterator[tuple]:
            if len(members) > 1:
                names, held = list(members), list(members.values())
                for m, values in each(held, now & 1):
                    yield now, names[m], *values

        for h, e, c, at, data in rows_of(batches, "h", "e", "c", "at", "data"):
            if h != now:
                for row in finish():
                    if out.add(row):
                        yield out.take()
                now, members = h, {}
            members[e] = (data, at, c)
        for row in finish():
            if out.add(row):
                yield out.take()
        yield from out.rest()

    return found.select("h", "e", "c", "at", "data").repartition("h").sortWithinPartitions("h").mapInArrow(scan, _ddl(schema))


def _sorted_groups(found: DataFrame, leasts: tuple[int, ...]) -> DataFrame:
    """Spans of the classes of groups that one task can sort."""

    def covered(members: list[tuple], number: int) -> Iterator[tuple[int, tuple]]:
        for m, own in enumerate(group_repeats([x[:2] for x in members], leasts[number], CODINGS[number].unit)):
            if members[m][2] == 1:
                for span in own:
                    yield m, span

    return _by_group(found, covered, _SPANS)


def _named_groups(found: DataFrame, leasts: tuple[int, ...]) -> DataFrame:
    """h, e, repeat, before, length: every maximal repeat of the groups that one
    task can sort, once for each class that has it, begun so far before the anchor."""

    def named(members: list[tuple], number: int) -> Iterator[tuple[int, tuple]]:
        for before, depth, group in maximal_repeats([x[:2] for x in members], leasts[number], CODINGS[number].unit):
            data, at, _ = members[group[0]]
            name = xxhash.xxh3_128_hexdigest(data[at - before : at + depth])
            for m in group:
                yield m, (name, before, before + depth)

    return _by_group(found, named, _REPEAT)


def _blocks(h: int, at: int, data: bytes, leasts: tuple[int, ...], block: int) -> Iterator[tuple[int, int, int, int, int, bytes]]:
    """(g, f, r, size, shift, bytes) of each block of a context's windows: the
    group by the middle that its windows share, the kind by all its bytes, the
    first window's place, how far windows go from there, and where the middle begins.
    block is in bytes; of these, whole units count."""
    number = h & 1
    least, unit = leasts[number], CODINGS[number].unit
    block = max(block // unit, 1) * unit
    first, last = -at, len(data) - least - at  # windows, from the anchor
    for b in range(first // block, last // block + 1):
        r1, r2, shift = max(first, b * block), min(last, b * block + block - unit), b * block + block - unit
        own = data[r1 + at : r2 + at + least]
        g = xxhash.xxh3_64_intdigest(data[shift + at : b * block + least + at], (h ^ b * _B) & (1 << 64) - 1)
        yield _signed(g & ~1 | number), _signed(xxhash.xxh3_64_intdigest(own, shift - r1)), r1, r2 - r1 + 1, shift, own


def split_groups(found: DataFrame, leasts: tuple[int, ...], group: int, blocks: tuple[int, ...], solve: Callable[..., DataFrame] = _sorted_groups) -> tuple[DataFrame, DataFrame]:
    """Groups too large for one task, split on longer prefixes.

    found: h, e, c, at, data.  Returns pieces (h, e, c, g, f, r, size, shift, n:
    rows of this kind) and what solve() says of the kinds (h: g, e: f) of the
    groups of pieces; at the last block size all members of a group are equal."""
    block, *smaller = blocks

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(_PIECE, rows=8192)
        for h, e, c, at, data in rows_of(batches, "h", "e", "c", "at", "data"):
            for g, f, r, size, shift, _ in _blocks(h, at, data, leasts, block):
                if out.add((h, e, c, g, f, r, size, shift)):
                    yield out.take()
        yield from out.rest()

    pieces = written(found.select("h", "e", "c", "at", "data").mapInArrow(hashes, _ddl(_PIECE)))
    kinds = written(pieces.groupBy("g", "f").agg(F.sum("c").alias("n"), F.min(F.struct("h", "e")).alias("of")))
    open_ = written(kinds.groupBy("g").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"))
    # The bytes of one member of each kind that can share windows with another.
    wanted = kinds.join(open_, "g").groupBy("of.h", "of.e").agg(F.collect_list(F.struct("g", "f", "n", (F.col("kinds") > group).alias("hot"))).alias("want"))
    need = found.select("h", "e", "at", "data").join(wanted, ["h", "e"]).select("h", "at", "data", *(F.col(f"want.{c}").alias(c) for c in ("g", "f", "n", "hot")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(pa.schema([*_MEMBER, ("hot", pa.bool_())]))
        for h, at, data, *want in rows_of(batches, "h", "at", "data", "g", "f", "n", "hot"):
            left = {(g, f): more for g, f, *more in zip(*want, strict=True)}
            for g, f, r, _, shift, own in _blocks(h, at, data, leasts, block):
                if more := left.pop((g, f), None):
                    if out.add((g, f, more[0], shift - r, own, more[1]), len(own)):
                        yield out.take()
        yield from out.rest()

    members = written(need.mapInArrow(cut, f"{_ddl(_MEMBER)}, hot boolean"))
    told = solve(members.where("not hot"), leasts)
    if smaller and members.where("hot").limit(1).count():
        told = told.unionByName(_rejoined(*split_groups(members.where("hot"), leasts, group, tuple(smaller), solve), leasts, solve))
    return pieces.join(kinds.select("g", "f", "n"), ["g", "f"]), told


def _least(leasts: tuple[int, ...]) -> Column:
    """The bytes that a repeat has, of the search of the row's h."""
    return F.when(F.col("h").bitwiseAND(1) == 1, leasts[-1]).otherwise(leasts[0])


def _rejoined(pieces: DataFrame, told: DataFrame, leasts: tuple[int, ...], solve: Callable[..., DataFrame]) -> DataFrame:
    """What is told of pieces, in terms of the classes they were cut from."""
    whole, some = pieces.where("n > 1"), pieces.join(told.withColumnsRenamed({"h": "g", "e": "f"}), ["g", "f"])
    if solve is _named_groups:
        some = some.select("h", "e", "repeat", (F.col("before") - F.col("shift")).alias("before"), "length")
        name = F.concat_ws(":", F.hex("g"), F.hex("f"))
        whole = _unless_told(whole.withColumn("length", F.col("size") - 1 + _least(leasts)), told.withColumnsRenamed({"h": "g", "e": "f"}), ["g", "f"])
        return some.unionByName(whole.select("h", "e", name.alias("repeat"), (-F.col("r")).alias("before"), "length"))
    once = F.col("c") == 1
    moved = some.where(once).select("h", "e", *((F.col(c) + F.col("shift")).alias(c) for c in ("from", "to")))
    return moved.unionByName(whole.where(once).select("h", "e", F.col("r").alias("from"), (F.col("r") + F.col("size") - 1 + _least(leasts)).alias("to")))


def _unless_told(whole: DataFrame, told: DataFrame, key: list[str]) -> DataFrame:
    """Classes that are repeats as wholes, but for those of which a tree has said
    so, with more members."""
    longest = told.groupBy(*key).agg(F.max("length").alias("longest"))
    return whole.join(longest, key, "left").where(F.coalesce(F.col("longest") < F.col("length"), F.lit(True)))


def _solved(found: DataFrame, leasts: tuple[int, ...], group: int, solve: Callable[..., DataFrame]) -> DataFrame:
    """solve() for all groups, the large ones (hot) split first."""
    told = solve(found.where("not hot"), leasts)
    if found.where("hot").limit(1).count():
        told = told.unionByName(_rejoined(*split_groups(found.where("hot"), leasts, group, BLOCKS, solve), leasts, solve))
    return told


def _met(flat: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, kinds): the rows of flat whose anchor h occurs twice, with mixed
    where it has several classes, and their classes: h, e, mixed, c rows of the
    class, and the name a of one of them."""
    met = written(flat.groupBy("h").agg(F.count(F.lit(1)).alias("n"), (F.min("e") != F.max("e")).alias("mixed")).where("n > 1").select("h", "mixed"))
    # Joined alike at every size, as these grow with the corpus.
    hits = written(flat.join(met, "h"))
    kinds = written(hits.groupBy("h", "e", "mixed").agg(F.count(F.lit(1)).alias("c"), F.min("a").alias("a")))
    release(met)
    return hits, kinds


def _found(docs: DataFrame, kinds: DataFrame, leasts: tuple[int, ...], k: int, group: int) -> DataFrame:
    """The contexts of classes that share an anchor with others; hot: too many for one task."""
    # Such groups are few; classes don't meet by h to learn it.
    hot = written(kinds.where("mixed").groupBy("h").agg(F.count(F.lit(1)).alias("of")).where(F.col("of") > group).select("h", F.lit(True).alias("hot")))
    side = F.broadcast(hot) if hot.count() <= BROADCAST_ROWS else hot
    wanted = kinds.where("mixed").join(side, "h", "left").select("h", "e", "c", "a", F.coalesce("hot", F.lit(False)).alias("hot"))
    found = written(contexts(docs, wanted, leasts, k))
    release(hot)
    return found


def repeats(docs: DataFrame, least: int = MIN, k: int = K, group: int = GROUP, *, words: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, parts).  rows: a, b, doc_id, n, words, key, whole (all of it is
    repeated), whole_words (the same by words) of every row; parts: a, b, spans
    (from, to; of coded words words_from, words_to) of the rows of which some
    bytes or words are repeated, but which are no copies."""
    leasts = (least, words * CODE) if words else (least,)
    docs = _numbered(docs)
    rows = written(anchored(docs, leasts, k))
    copies = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1"))
    side = F.broadcast(copies) if copies.count() <= BROADCAST_KEYS else copies
    copy = F.col("m").isNotNull()
    known_rows = rows.join(side, "key", "left").withColumns({"whole": copy & (F.col("n") >= least), "whole_words": copy & (F.col("words") >= (words or 0)) & F.lit(bool(words))})
    told = written(known_rows.select("a", "b", "doc_id", "n", "words", "key", "whole", "whole_words"))
    flat = known_rows.where(F.size("h") > 0).select("a", "b", "whole", "whole_words", F.inline(F.arrays_zip("h", "e", "p", "lo", "hi")))
    by_words = F.col("h").bitwiseAND(1) == 1
    hits, kinds = _met(flat.select("a", "b", F.when(by_words, ~F.col("whole_words")).otherwise(~F.col("whole")).alias("own"), "h", "e", "p", "lo", "hi"))
    found = _found(docs, kinds, leasts, k, group)
    spans = _solved(found, leasts, group, _sorted_groups)
    known = written(spans.unionByName(kinds.where("c > 1").select("h", "e", F.lit(None).cast("long").alias("from"), F.lit(None).cast("long").alias("to"))))
    hit = hits.where("own").join(known, ["h", "e"]).select("a", "b", by_words.alias("w"), F.coalesce(F.col("p") + F.col("from"), "lo").alias("from"), F.coalesce(F.col("p") + F.col("to"), F.col("hi") + _least(leasts)).alias("to"))
    ends = {name: F.collect_list(F.when(w, F.col(c))) for w, names in ((~F.col("w"), ("from", "to")), (F.col("w"), ("words_from", "words_to"))) for name, c in zip(names, ("from", "to"), strict=True)}
    parts = written(hit.groupBy("a", "b").agg(*(c.alias(name) for name, c in ends.items())))
    release(rows, copies, hits, kinds, found, known)
    return told, parts


def repeat_groups(docs: DataFrame, least: int = MIN, k: int = K, group: int = GROUP) -> DataFrame:
    """repeat, length, doc_id, start: the maximal repeats of least bytes or more
    and every place where each occurs.

    A repeat is maximal within its anchor's context (in a group that was split:
    within a block); one that is longer is given as several that overlap, one for
    each anchor in it.  A class that occurs twice is a repeat of its whole
    context.  Each is named by its bytes' hash, or by its class's."""
    docs, leasts = _numbered(docs), (least,)
    rows = written(anchored(docs, leasts, k))
    at, kinds = _met(rows.select("a", "doc_id", F.inline(F.arrays_zip("h", "e", "p", "lo", "hi"))))
    found = _found(docs, kinds, leasts, k, group)
    told = _solved(found, leasts, group, _named_groups)
    some = at.join(told, ["h", "e"]).select("repeat", "length", "doc_id", (F.col("p") - F.col("before")).alias("start"))
    # In a group that was split the blocks of such a class are told.
    twice = kinds.where("c > 1").select("h", "e").join(found.where("hot").select("h", "e"), ["h", "e"], "left_anti")
    whole = _unless_told(at.join(twice, ["h", "e"]).withColumn("length", F.col("hi") - F.col("lo") + least), told, ["h", "e"])
    whole = whole.select(F.concat_ws(":", F.hex("h"), F.hex("e")).alias("repeat"), "length", "doc_id", F.col("lo").alias("start"))
    return some.unionByName(whole).distinct()


def _names(doc_id: Column, text: Column) -> dict[str, Column]:
    """What a row is told by: its text and doc_id, which may be null."""
    return {"a": F.xxhash64(doc_id, text), "b": F.xxhash64(F.lit(1), text)}


def _numbered(docs: DataFrame) -> DataFrame:
    return texts(docs).withColumns(_names(F.col("doc_id"), F.col("text")))


_CUT = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("n_passage_words", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])


def word_spans(data: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of the words that lie whole in spans of coded words."""
    at = [m.span() for m in re.finditer(rb"[^ \t\n\r\x0b\x0c]+", data)]
    return [(at[-(-a // CODE)][0], at[b // CODE - 1][1]) for a, b in spans]


def removed(docs: DataFrame, parts: DataFrame, with_text: bool = False) -> DataFrame:
    """a, b, n_removed, n_spans, n_passage_words, kept_sha256 of the rows in parts;
    with_text takes the passages of words out besides and adds what is left as
    text, where a character goes only as a whole."""
    docs = _numbered(docs).select("a", "b", "text")
    need = thinned(docs, parts.select("a").distinct(), "a").join(parts, ["a", "b"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(_CUT)
        for a_, b_, text, starts, ends, first, last in rows_of(batches, "a", "b", "text", "from", "to", "words_from", "words_to"):
            data, at, rest, whole, gone = text.encode(), 0, [], [], 0
            passages = merged(list(zip(first, last, strict=True)))
            spans = merged([*zip(starts, ends, strict=True), *(word_spans(data, passages) if with_text and passages else [])])
            for a, b in [*spans, (len(data), len(data))]:
                rest.append(data[at:a])
                gone += b - a
                at = b
            if with_text:
                at = 0
                for a, b in [*spans, (len(data), len(data))]:
                    while a < b and data[a] & 0xC0 == 0x80:
                        a += 1
                    while a < b < len(data) and data[b] & 0xC0 == 0x80:
                        b -= 1
                    whole.append(data[at:a])
                    at = b
            told = sum(b // CODE - -(-a // CODE) for a, b in passages)
            row = (a_, b_, gone, len(spans), told, hashlib.sha256(b"".join(rest)).hexdigest(), b"".join(whole).decode() if with_text else None)
            if out.add(row, len(row[-1] or "")):
                yield out.take()
        yield from out.rest()

    return need.mapInArrow(cut, _ddl(_CUT)).dropDuplicates(["a", "b"])


def dig(docs: DataFrame, least: int = MIN, words: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; with words
    also n_passage_words: its words that lie in runs of so many words which also
    start elsewhere, however few bytes these have.  What is removed goes by bytes
    alone."""
    told, parts = repeats(docs, least, words=words)
    made = written(removed(docs, parts).drop("kept"))
    all_, empty, zero = told.join(made, ["a", "b"], "left"), hashlib.sha256(b"").hexdigest(), F.lit(0).cast("long")
    passage = F.when(F.col("whole_words"), F.col("words")).otherwise(F.coalesce("n_passage_words", zero)).alias("n_passage_words")
    return all_.select("doc_id", F.col("n").alias("n_bytes"), F.when(F.col("whole"), F.col("n")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"), F.when(F.col("whole"), F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"), F.when(F.col("whole"), empty).otherwise(F.coalesce("kept_sha256", "key")).alias("kept_sha256"), *([passage] if words else []))


def deduplicate(docs: DataFrame, least: int = MIN, words: int | None = None) -> DataFrame:
    """docs with repeated bytes taken out of the texts, and n_chars, if it is
    there, counted anew; with words, repeated runs of so many words as well,
    however short the words are.  A copy goes whole if either says so."""
    told, parts = repeats(docs, least, words=words)
    left = removed(docs, parts, with_text=True).select(F.col("a").alias("__a"), F.col("b").alias("__b"), F.col("kept").alias("__kept"))
    whole = told.where("whole or whole_words").select(F.col("a").alias("__a"), F.col("b").alias("__b"), F.lit("").alias("__kept")).distinct()
    changed = written(left.unionByName(whole))
    names = _names(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")))
    out = docs.withColumns({f"__{c}": x for c, x in names.items()}).join(changed, ["__a", "__b"], "left").withColumn("text", F.coalesce("__kept", "text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__kept").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def op4_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dig(read(spark, sf_dir, "documents"), words=WORDS)
