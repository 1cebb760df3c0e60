"""Near duplicates by an exact n-gram Jaccard join.

Sets of equal content are one node, so copies cost one row.  Sets of sizes r
and s with similarity t differ in at most (1 - t) / (1 + t) * (r + s) elements.
Sizes are dealt into bands; a band's scheme hashes the universe of shingles into
segments, and by the pigeonhole principle two sets of a band agree in a segment,
or differ by a single element in one of those for which one-deletion
neighbourhoods are indexed.  How many segments are of either kind is chosen by
cost: signatures written against expected chance meetings.  Small sizes at the
low end of a band also join the band below, where their smaller partners are.

Nodes that share a signature are candidates.  Each signature has a centre, its
best supported node, against which all its nodes are verified; links found so
make components.  What may still be missing are links between nodes of one
centre that are in different components.

Few nodes of a centre (GROUP at most) are compared in one task by parity
sketches: the bits in which two sketches differ are never more than the elements
in which the sets differ, so most pairs are ruled out for certain and only the
others are verified.  The same bound spares nodes unlike their centre.

Of a centre with more nodes, each node's difference from the centre is known
whole.  The elements in which two nodes differ follow from those in which each
differs from the centre; so two can be similar only if these differences overlap
enough, and then they share an element in the rare part of both (prefix filter,
rarest first).  No group emits all its pairs, and none is capped.  All
verification is of whole sets, dealt by centre and salt.

A set is told by 128 bits of hash: nodes have 64 of them, and where two sets
share these, both hashes together.

Null and empty texts have an empty set and are linked with nothing.  Repeated
rows are copies.  Rows are told by doc_id and text, so rows that share a doc_id
are rows of their own; their components are not joined by it.  A null doc_id
takes part as text; its component is that of its set, and null where no row of
the component has a doc_id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .runtime import Out, read, release, rows_of, texts, written
from .words import mixed, shingles

#: Ratio of a band's sizes, in steps of 1 / similarity, from and below a similarity of 85 percent.
BAND_STEPS = (3, 2)
#: Cost of a chance meeting, and of an empty segment's signature, against that of a signature, and chance that an element is common.
MEETING, EMPTY, COMMON = 200.0, 1000.0, 0.05
#: Spokes of a centre that are verified by one task; so many wanted documents are found by broadcast, more by join.
SPOKES, BROADCAST_ROWS = 256, 500_000
#: Nodes of a centre that one task compares by sketch, and bits of a sketch as a power of two, at most.
GROUP, SKETCH = 500, 15
#: Nodes of a signature beyond which those that can do without it do, and bits of the band in a signature.
HOT, TAG = 100, 4

_C1, _C2 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def steps(percent: int) -> int:
    return BAND_STEPS[percent < 85]


class Scheme:
    """The signatures of one band of sizes.

    Two sets of the band differ in at most ``differ`` elements, and each of
    these touches one segment.  An exact segment takes one of them to hide an
    agreement, one with deletions two; so units of more than ``differ`` make
    sure of an agreement.  Segments empty in both sets agree and say nothing:
    with ``spare`` units more, a set with no more empty segments than that
    gives no signature for them; a set with more gives them all.  What of the
    spare units is left then is the set's ``room``: so many more signatures it
    may do without (see informative())."""

    def __init__(self, band: int, percent: int):
        width = (percent / 100) ** -steps(percent)
        self.band = band
        self.low = max(1, math.ceil(width**band - 1e-9))
        self.top = max(self.low, math.ceil(width ** (band + 1) - 1e-9) - 1)
        # A partner from the band above has at most top / ratio elements.
        reach = self.top * 100 // percent
        self.differ = min((self.top + reach) * (100 - percent) // (100 + percent), 2 * reach)
        need = self.differ + 1
        spares = [0, 1, 2, 3, *sorted({int(1.3**k) for k in range(6, 60) if 1.3**k < 2 * need + 8})]
        plans = [(self.exact_cost(need, n), 0, need + n, n) for n in spares]
        plans += [(self.deletion_cost(n, need - 2 * n), n, max(0, need - 2 * n), -1) for n in range(1, min(need // 2 + 1, 64) + 1)]
        _, self.deleting, self.exact, self.spare = min(plans)
        # A segment with deletions is two units wide.
        self.units = np.array([k for k in range(self.deleting) for _ in (0, 1)] + [self.deleting + k for k in range(self.exact)], np.int64)
        self.segments = self.deleting + self.exact
        self.seed = np.uint64(xxhash.xxh3_64_intdigest(f"{band} {percent} {steps(percent)}".encode()))

    def exact_cost(self, need: int, spare: int) -> float:
        """Signatures, chance meetings, and empty segments if they are many."""
        n, size = need + spare, (self.low + self.top) / 2
        mean = size / n
        none = n * (1 - 1 / n) ** self.low if n > 1 else 0.0
        if none > 50:
            below = (1 + math.erf((spare + 0.5 - none) / math.sqrt(2 * none))) / 2
        else:  # Poisson
            term, below = math.exp(-none), 0.0
            for k in range(spare + 1):
                below += term
                term *= none / (k + 1)
        return n * (1 + MEETING * _meets(mean)) + max(0.0, 1 - below) * none * EMPTY

    def deletion_cost(self, deleting: int, exact: int) -> float:
        exact = max(0, exact)
        n, size = 2 * deleting + exact, (self.low + self.top) / 2
        mean = size / n
        one = MEETING * _meets(mean) + EMPTY * math.exp(-mean) if n > 1 else 0.0
        two = MEETING * _meets(2 * mean) + EMPTY * math.exp(-2 * mean) * (1 + 2 * mean) if n > 2 else 0.0
        return exact * (1 + one) + deleting * (1 + 2 * mean) * (1 + two)

    def signatures(self, h: np.ndarray) -> tuple[np.ndarray, int]:
        """The set's signatures, with the band in their last TAG bits, and its room or -1."""
        value = mixed(h ^ self.seed)
        segment = self.units[((value >> np.uint64(33)) % np.uint64(len(self.units))).astype(np.int64)]
        value = mixed(value * _C1)
        order = np.argsort(segment, kind="stable")
        segment, value = segment[order], value[order]
        starts = np.searchsorted(segment, np.arange(self.segments + 1))
        total = np.concatenate([[np.uint64(0)], np.cumsum(value, dtype=np.uint64)])
        sums = total[starts[1:]] - total[starts[:-1]]
        place = np.arange(self.segments, dtype=np.uint64) * _C2 + self.seed
        full = starts[1:] > starts[:-1]
        room, kept = self.spare - int(self.segments - np.count_nonzero(full)), place
        if room >= 0:
            sums, kept = sums[full], place[full]
        out = [mixed(sums ^ kept)]
        if self.deleting:
            inner = segment < self.deleting
            at = segment[inner]
            whole = total[starts[1:]] - total[starts[:-1]]
            out.append(mixed((whole[at] - value[inner]) ^ place[at]))
        tagged = np.concatenate(out) >> np.uint64(TAG) << np.uint64(TAG) | np.uint64(self.band % (1 << TAG))
        return np.unique(tagged), max(-1, room)


def _meets(mean: float) -> float:
    """Chance that all elements of a segment, one at least, are common ones."""
    return math.exp(-mean * (1 - COMMON)) - math.exp(-mean)


@lru_cache(4096)
def scheme(band: int, percent: int) -> Scheme:
    return Scheme(band, percent)


@lru_cache(1 << 16)
def schemes(size: int, percent: int) -> tuple[Scheme, ...]:
    """The band of a size, and the band below if partners may be there."""
    band = max(0, int(math.log(size) / -steps(percent) / math.log(percent / 100)) - 1)
    while scheme(band, percent).top < size:
        band += 1
    own = scheme(band, percent)
    below = [scheme(k, percent) for k in range(max(0, band - 2), band) if scheme(k, percent).top * 100 >= percent * size]
    return (own, *below)


_SETS = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("twin", pa.int64()), ("sketch", pa.binary()), ("tags", pa.list_(pa.int64())), ("room", pa.list_(pa.int64())), ("sigs", pa.list_(pa.int64()))])
#: Centres' salts in one row of what is told.
_SALTS = 64

_TOLD = pa.schema([("centre", pa.int64()), ("salt", pa.int64()), ("spoke", pa.int64()), ("first", pa.int64()), ("set", pa.binary())])
_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("linked", pa.bool_()), ("size", pa.int64()), ("middle", pa.int64()), ("differ", pa.list_(pa.int64()))])


def sketch(h: np.ndarray) -> bytes:
    """For each leading bits of a hash the parity of the number of elements
    that have them; about as many bits as elements."""
    bits = min(SKETCH, max(6, (len(h) - 1).bit_length()))
    odd = np.bincount((h >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def folded(data: bytes, size: int) -> np.ndarray:
    """A sketch at a lesser size in bytes: neighbouring parities add up."""
    bits = np.unpackbits(np.frombuffer(data, np.uint8))
    if len(bits) > 8 * size:
        bits = np.bitwise_xor.reduce(bits.reshape(8 * size, -1), axis=1)
    return np.packbits(bits)


def reach(total: int, percent: int) -> int:
    """Elements in which similar sets of total elements together may differ."""
    return total * (100 - percent) // (100 + percent)


def node_of(h: np.ndarray, seed: int) -> tuple[int, int]:
    data = h.tobytes()
    return int(np.uint64(xxhash.xxh3_64_intdigest(data, 2 * seed)).view(np.int64)), int(np.uint64(xxhash.xxh3_64_intdigest(data, 2 * seed + 1)).view(np.int64))


def node_names(node: int, twin: int) -> tuple[int, int]:
    """A set's node, and its node where another set has the same first hash."""
    return node, node ^ twin


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and key, a hash of both by which a row is found again."""
    return texts(docs).withColumn("key", F.xxhash64("doc_id", "text"))


def sets(docs: DataFrame, words: int, percent: int, seed: int) -> DataFrame:
    """doc_id, key, n, node, twin, sketch, tags, room, sigs of every row; an empty set has no node.

    A set that a task has seen before is given without signatures again."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, seen = Out(_SETS, rows=1024), set()
        for doc_id, key, text in rows_of(batches, "doc_id", "key", "text"):
            h = shingles(text, words)
            if not len(h):
                row = (doc_id, key, 0, None, None, None, [], [], [])
            else:
                node, twin = node_of(h, seed)
                if node << 64 | twin + (1 << 63) in seen:
                    row = (doc_id, key, len(h), node, twin, None, [], [], [])
                else:
                    if len(seen) < 1_000_000:
                        seen.add(node << 64 | twin + (1 << 63))
                    given = [(s.band % (1 << TAG), *s.signatures(h)) for s in schemes(len(h), percent)]
                    row = (doc_id, key, len(h), node, twin, sketch(h), [g[0] for g in given], [g[2] for g in given], np.concatenate([g[1] for g in given]).view(np.int64))
            if out.add(row, 8 * len(row[-1])):
                yield out.take()
        yield from out.rest()

    return docs.mapInArrow(measure, "doc_id long, key long, n long, node long, twin long, sketch binary, tags array<long>, room array<long>, sigs array<long>")


def verified(docs: DataFrame, pairs: DataFrame, words: int, percent: int, seed: int, whole: bool = False) -> DataFrame:
    """For each pair of nodes (a, a_at, b, b_at: keys of rows that have them):
    whether they are linked, the sizes of a and b, and, if whole, the elements in
    which a and b differ."""
    share = pairs.groupBy("b").agg(F.max("b_at").alias("b_at"), F.ceil(F.count(F.lit(1)) / SPOKES).cast("long").alias("salts"))
    share = written(share)
    # pairs grouped by spoke, so that a set is computed once and told to each centre
    sized, one, zero = share.drop("b_at"), F.lit(1).cast("long"), F.lit(0).cast("long")
    spokes = pairs.join(F.broadcast(sized) if share.count() <= BROADCAST_ROWS else sized, "b").select(F.col("a_at").alias("at"), F.col("a").alias("node"), zero.alias("part"), F.struct(F.col("b").alias("centre"), F.pmod("a", "salts").alias("salt"), one.alias("first")).alias("to"))
    centres = share.select(F.col("b_at").alias("at"), F.col("b").alias("node"), F.explode(F.sequence(zero, F.col("salts") - 1)).alias("salt"))
    # A centre with very many salts is told in several rows, so none is long.
    centres = centres.select("at", "node", F.expr(f"salt div {_SALTS}").alias("part"), F.struct(F.col("node").alias("centre"), "salt", zero.alias("first")).alias("to"))
    want = written(spokes.unionByName(centres).groupBy("at", "node", "part").agg(F.collect_list("to").alias("to")))
    side = F.broadcast(want) if want.count() <= BROADCAST_ROWS else want
    found = docs.join(side, docs.key == F.col("at")).select("node", "part", "text", F.to_json("to").alias("to"))

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        out, done = Out(_TOLD), set()  # repeated rows are told once a task
        for node, part, text, to in rows_of(batches, "node", "part", "text", "to"):
            if (node, part) in done:
                continue
            h = shingles(text, words)
            if len(h) and node in node_names(*node_of(h, seed)):
                if len(done) < 1_000_000:
                    done.add((node, part))
                data = h.tobytes()
                for t in json.loads(to):
                    if out.add((t["centre"], t["salt"], node, t["first"], data), len(data)):
                        yield out.take()
        yield from out.rest()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, key, centre = Out(_LINK), None, None
        for b, salt, a, first, data in rows_of(batches, "centre", "salt", "spoke", "first", "set"):
            if first == 0:
                key, centre = (b, salt), np.frombuffer(data, np.uint64)
            elif (b, salt) == key:
                spoke = np.frombuffer(data, np.uint64)
                differ = np.setxor1d(spoke, centre, assume_unique=True)
                union = (len(spoke) + len(centre) + len(differ)) // 2
                linked = 100 * (union - len(differ)) >= percent * union
                differ = differ.view(np.int64) if whole else []
                if out.add((a, b, linked, len(spoke), len(centre), differ), 8 * len(differ)):
                    yield out.take()
        yield from out.rest()

    told = found.mapInArrow(tell, "centre long, salt long, spoke long, first long, set binary")
    dealt = told.repartition("centre", "salt").sortWithinPartitions("centre", "salt", "first")
    return dealt.mapInArrow(compare, "a long, b long, linked boolean, size long, middle long, differ array<long>")


def informative(hit: DataFrame, rows: DataFrame) -> DataFrame:
    """hit (sig, node) without the signatures of many nodes, at the nodes that
    can do without: those whose such signatures in a band are within their room.

    Similar sets agree in more segments than spare units.  If empty ones and
    ones with a signature of many nodes are no more than these in either set, the
    two also agree in another segment; so that set needs neither kind."""
    many = written(hit.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("sig"))
    n = many.count()
    if not n:
        return hit
    side = F.broadcast(many) if n <= BROADCAST_ROWS else many
    hot = written(hit.join(side, "sig").distinct().withColumn("tag", F.col("sig").bitwiseAND((1 << TAG) - 1)))
    room = rows.where(F.size("tags") > 0).select("node", F.inline(F.arrays_zip(F.col("tags").alias("tag"), "room"))).distinct()
    without = hot.groupBy("node", "tag").agg(F.count(F.lit(1)).alias("m")).join(room, ["node", "tag"]).where("m <= room").select("node", "tag")
    kept = hot.join(without, ["node", "tag"], "left_anti").select("sig", "node")
    return written(hit.join(side, "sig", "left_anti").select("sig", "node").unionByName(kept))


_STAR = pa.schema([("a", pa.int64()), ("a_at", pa.int64()), ("b", pa.int64()), ("b_at", pa.int64())])
_PAIR = "a long, a_at long, b long, b_at long"


def plausible(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, a_at, b, b_at) that sizes and sketches don't rule out."""
    one = known.select(F.col("node").alias("a"), F.col("size").alias("a_size"), F.col("sketch").alias("a_sketch"))
    two = known.select(F.col("node").alias("b"), F.col("size").alias("b_size"), F.col("sketch").alias("b_sketch"))
    fits = 100 * F.least("a_size", "b_size") >= percent * F.greatest("a_size", "b_size")
    both = pairs.join(one, "a").join(two, "b").where(fits)

    def rule(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(_STAR)
        for a, a_at, b, b_at, r, s, x, y in rows_of(batches, "a", "a_at", "b", "b_at", "a_size", "b_size", "a_sketch", "b_sketch"):
            size = min(len(x), len(y))
            if int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum()) <= reach(r + s, percent) and out.add((a, a_at, b, b_at)):
                yield out.take()
        yield from out.rest()

    return both.mapInArrow(rule, _PAIR)


def within_groups(pairs: DataFrame, placed: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes of one centre, in different components, that sizes and
    sketches don't rule out.  pairs: of centres with GROUP nodes at most."""
    slim = pairs.select("b", "a").join(placed.select(F.col("node").alias("a"), "at", "size", "comp"), "a")
    open_ = slim.groupBy("b").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x != y").select("b")
    rows = slim.join(open_, "b").join(placed.select(F.col("node").alias("a"), "sketch"), "a")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now, members = Out(_STAR), None, []

        def finish() -> Iterator[tuple]:
            if len(members) < 2:
                return
            size = min(len(m[4]) for m in members)
            bits = np.stack([folded(m[4], size) for m in members]).view(np.uint64)
            sizes, comps = np.array([m[2] for m in members]), np.array([m[3] for m in members])
            for i in range(len(members) - 1):
                later = slice(i + 1, None)
                small, large = np.minimum(sizes[i], sizes[later]), np.maximum(sizes[i], sizes[later])
                may = (comps[later] != comps[i]) & (100 * small >= percent * large)
                if may.any():
                    may &= np.bitwise_count(bits[later] ^ bits[i]).sum(1) <= (sizes[later] + sizes[i]) * (100 - percent) // (100 + percent)
                    for j in np.flatnonzero(may) + i + 1:
                        yield (*members[i][:2], *members[j][:2])

        for b, a, at, n, comp, data in rows_of(batches, "b", "a", "at", "size", "comp", "sketch"):
            if b != now:
                for row in finish():
                    if out.add(row):
                        yield out.take()
                now, members = b, []
            members.append((a, at, n, comp, data))
        for row in finish():
            if out.add(row):
                yield out.take()
        yield from out.rest()

    found = rows.select("b", "a", "at", "size", "comp", "sketch").repartition("b").sortWithinPartitions("b").mapInArrow(compare, _PAIR)
    return found.distinct()


def across(compared: DataFrame, placed: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, a_at, b, b_at) of nodes in different components that may be
    linked, among those that share a signature and so a centre.

    Nodes that are alike whatever elements they share, as their differences from
    the centre are within reach together, needn't be looked for: with sizes r, s
    and t of a, b and the centre and differences d and e, d + e within reach of
    r + s, e is at least s - t, and so d within reach of r + t: a is linked to the
    centre, and b likewise."""
    # Only a centre whose nodes are in several components, one of them not
    # linked to it, can have pairs left.
    slim = compared.select("b", "a", "linked", "size", F.size("differ").cast("long").alias("d"))
    slim = written(slim.join(placed.select(F.col("node").alias("a"), "at", "comp"), "a"))
    open_ = slim.groupBy("b").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x != y").select("b")
    open_ = written(open_)
    near = written(slim.join(F.broadcast(open_) if open_.count() <= BROADCAST_ROWS else open_, "b"))
    ids = near.select("b", "a")
    side = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    within = lambda total: F.floor(total * (100 - percent) / (100 + percent) + 1e-9).cast("long")
    most = within(F.col("size") + F.floor(F.col("size") * 100 / percent))
    each = compared.join(side, ["b", "a"]).select("b", "a", F.explode("differ").alias("x"))
    rare = each.groupBy("b", "x").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # Elements that no other node differs in come first of all; they need no
    # rows, as nothing meets there, but they count for the places of the rest.
    shared = each.join(rare, ["b", "x"]).groupBy("b", "a").agg(F.sort_array(F.collect_list(F.struct("n", "x"))).alias("xs"))
    told = near.join(shared, ["b", "a"]).withColumn("alone", F.col("d") - F.size("xs"))
    told = told.select("*", F.posexplode("xs").alias("place", "e")).select("b", "a", "at", "comp", "linked", "size", "d", F.col("e.x").alias("x"), (F.col("alone") + F.col("place") + 1).alias("place"))
    told = written(told.where(F.col("place") <= F.when(F.col("linked"), F.col("d")).otherwise(most + 1)))
    # A linked node belongs to its centre's component: of two such nodes no
    # pair is open; so one of a pair is not linked to the centre.
    one, two = told.where("not linked"), told.select(*(F.col(c).alias(f"o_{c}") for c in told.columns))
    need = F.ceil((F.col("d") + F.col("o_d") - within(F.col("size") + F.col("o_size"))) / 2)
    fits = (F.col("comp") != F.col("o_comp")) & (100 * F.least("size", "o_size") >= percent * F.greatest("size", "o_size"))
    once = F.col("o_linked") | (F.col("a") < F.col("o_a"))
    by_element = (F.col("b") == F.col("o_b")) & (F.col("x") == F.col("o_x")) & fits & once & (F.col("place") <= F.col("d") - need + 1) & (F.col("o_place") <= F.col("o_d") - need + 1)
    return one.join(two, by_element).select("a", F.col("at").alias("a_at"), F.col("o_a").alias("b"), F.col("o_at").alias("b_at")).distinct()


def measured(docs: DataFrame, words: int, percent: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The rows of sets(), and their nodes: node, rep (smallest doc_id), at (that
    row's key), n, sketch."""
    rows = written(sets(docs, words, percent, seed))

    def grouped() -> DataFrame:
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")
        of = rows.where("n > 0").groupBy("node").agg(first, F.max("n").alias("n"), F.max("sketch").alias("sketch"), (F.min("twin") != F.max("twin")).alias("clash"))
        return written(of.select("node", F.col("first.doc_id").alias("rep"), F.col("first.key").alias("at"), "n", "sketch", "clash"))

    nodes = grouped()
    # Of 10^10 sets a few pairs share 64 bits; they are told by their other hash too.
    clash = nodes.where("clash").select("node", "clash")
    if clash.limit(1).count():
        name = F.when(F.col("clash"), F.col("node").bitwiseXOR(F.col("twin"))).otherwise(F.col("node"))
        old, rows = (nodes, rows), written(rows.join(clash, "node", "left").withColumn("node", name).select(rows.columns))
        nodes = grouped()
        release(*old)
        if nodes.where("clash").limit(1).count():
            raise ValueError("two sets have one hash of 128 bits; take another seed")
    return rows, nodes.drop("clash")


def join(docs: DataFrame, words: int = 5, percent: int = 80, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n_shingles, node, component_id) and the links found (a, b: smallest doc_ids)."""
    rows, linked, nodes = _joined(docs, words, percent, seed)
    a, b = nodes.select(F.col("node").alias("a"), F.col("rep").alias("a_rep")), nodes.select(F.col("node").alias("b"), F.col("rep").alias("b_rep"))
    links = linked.join(a, "a").join(b, "b").select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b"))
    return rows.select("doc_id", "n_shingles", "node", "component_id"), links


def _joined(docs: DataFrame, words: int, percent: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """doc_id, key, n_shingles, node, component_id and keep (the key of the row
    that stays for the component) of every row; links and nodes."""
    docs = keyed(docs)
    rows, nodes = measured(docs, words, percent, seed)
    exploded = rows.select("node", F.explode("sigs").alias("sig"))
    popular = written(exploded.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("sig"))
    # Joined alike at every size.  A table of its own: what follows by signature
    # combines before it shuffles.
    hit = informative(written(exploded.join(popular, "sig").select("sig", "node")), rows)
    # Signatures of the same nodes say the same: one stands for all.  Nodes are
    # told by number, least, greatest and two sums of parts of their hashes,
    # which are null, and then not used, where they overflow.
    told = hit.groupBy("sig").agg(F.min("node").alias("x"), F.max("node").alias("y"), F.count(F.lit(1)).alias("n"), F.try_sum(F.col("node").bitwiseAND((1 << 40) - 1)).alias("p"), F.try_sum(F.shiftrightunsigned("node", 24)).alias("q")).where("x != y")
    shared = written(told.groupBy("x", "y", "n", F.coalesce("p", "sig").alias("p"), F.coalesce("q", "sig").alias("q")).agg(F.min("sig").alias("sig"), (F.col("n") * F.count(F.lit(1))).alias("weight")).select("sig", "weight"))
    side = F.broadcast(shared) if shared.count() <= BROADCAST_ROWS else shared
    met = hit.join(side, "sig").groupBy("node").agg(F.sum("weight").alias("support"), F.collect_set("sig").alias("sigs"))
    known = written(met.join(nodes.select("node", "at", F.col("n").alias("size"), "sketch"), "node"))
    slim = written(rows.select("doc_id", "key", "n", "node"))
    release(rows, popular, hit, shared)
    flat = known.select(F.explode("sigs").alias("sig"), "node", "at", "support")
    centre = written(flat.groupBy("sig").agg(F.max(F.struct("support", "node", "at")).alias("c")).select("sig", F.col("c.node").alias("b"), F.col("c.at").alias("b_at")))
    pairs = written(flat.join(centre, "sig").where("node != b").select(F.col("node").alias("a"), F.col("at").alias("a_at"), "b", "b_at").distinct())
    placed = written(known.select("node", "at", "size", "sketch"))
    release(known, centre)
    large = written(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > GROUP).select("b"))
    n_large = large.count()
    side = F.broadcast(large) if n_large <= BROADCAST_ROWS else large
    few, many = pairs.join(side, "b", "left_anti"), pairs.join(side, "b", "left_semi")
    near = written(plausible(few, placed, percent))
    compared = written(verified(docs, near, words, percent, seed))
    told = written(verified(docs, many, words, percent, seed, whole=True)) if n_large else None

    linked = written((compared.unionByName(told) if told else compared).where("linked").select("a", "b"))
    part = components(linked)
    placed = written(placed.join(part, "node", "left").select("node", "at", "size", "sketch", F.coalesce("component", "node").alias("comp")))
    rest = within_groups(few, placed, percent)
    rest = written(rest.unionByName(across(told, placed, percent)).distinct() if told else rest)
    release(pairs, near, compared, placed)
    if rest.limit(1).count():
        more = written(verified(docs, rest, words, percent, seed).where("linked").select("a", "b"))
        if more.limit(1).count():
            linked = written(linked.unionByName(more))
            part = components(linked)
    # Of each component the row of the smallest doc_id, by which it is named.
    all_ = part.unionByName(part.select(F.col("component").alias("node"), "component").distinct())
    first = F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "at")).alias("first")
    named = all_.join(nodes, "node").groupBy("component").agg(first)
    named = written(all_.join(named, "component").select("node", F.col("first.rep").alias("least"), F.col("first.at").alias("keep")))
    of = nodes.join(named, "node", "left").select("node", F.coalesce("least", "rep").alias("component_id"), F.coalesce("keep", "at").alias("keep"))
    out = slim.join(of, "node", "left")
    return out.select("doc_id", "key", F.col("n").alias("n_shingles"), "node", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "keep"), linked, nodes


def deduplicate(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay: of each component the row of the smallest
    doc_id, once, and each row without words, once.  A null doc_id comes after all
    others; of rows that share the smallest doc_id one stays."""
    decided, _, _ = _joined(docs, words, percent, 0)
    gone = decided.where("key != keep").select(F.col("doc_id").alias("__gone"), F.col("key").alias("__gone_key")).distinct()
    own = F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__gone")) & (own == F.col("__gone_key"))
    return docs.join(gone, same, "left_anti").dropDuplicates(["doc_id", "text"]).select(docs.columns)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(read(spark, sf_dir, "documents"), words=3, percent=90)[0].drop("node")
