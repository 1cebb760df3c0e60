"""Quality rules: fixed base rules and robust multivariate outliers.

Every text gives a vector of transformed statistics.  For each language and
source, each language, and all rows a minimum-covariance-determinant estimate of
centre and covariance is searched for by concentration: the share COVER of rows
with the smallest Mahalanobis distances re-estimates both, again and again for
as long as this lowers the determinant.  There are three starts, which
follow from the rows alone: coordinate-wise medians and quartiles, the covariance
of hyperbolic tangents, and that of spatial signs.  After TRIALS steps the start of
the least determinant goes on.

The estimate of a language and source is drawn to that of its language, and that
to the one of all rows, by weights n and POOL for a group of n rows; that of all
rows to fixed standard deviations by n and PRIOR_ROWS.  So there is no size at
which a group is treated otherwise.

A row is rejected when its distance, scaled so that the median row of its group
has the median of a chi-square variable (drawn to the language's and all rows'
medians in the same way), is beyond the cut.  The degrees of freedom are those
that the covariance has: the trace of C (C + F)^-1 for a covariance C and the
squared floors F, so a statistic without variance adds none.

All estimates are over all rows.  Vectors are fixed-point integers, sums are
exact integers, order statistics are exact counts of quantised values, of which
there are few as all statistics are shares, their roots, or logarithms; so
results don't depend on how rows are dealt, and every aggregate combines before
the shuffle, whatever share of rows one source has.

Null and empty texts have no words and fail the base rules.  Null languages and
sources are groups like others.  Repeated rows count as often as they occur.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import Out, read, rows_of, texts, written
from .words import window_hashes, word_hashes

SYMBOLS = b"#*$%&|<>"
PUNCTUATION = b"!\"'()+,-./:;=?@[\\]^_`{}~"
UPPER = bytes(range(65, 91))
WHITE = b" \t\n\r\x0b\x0c"

MIN_WORDS, WINDOW, MOST_REPEATED = 10, 5, 20
#: Share of rows that an estimate rests on, and concentration steps of a fixed number.
COVER, STEPS = 0.75, 5
#: Steps after which the starts are compared, and at most.
TRIALS, MOST_STEPS = 2, 40
#: Weight of a larger group's estimate, in rows, and of the fixed deviations.
POOL, PRIOR_ROWS = 100, 12
#: The cut is the 0.99 quantile of chi-square, by the Wilson-Hilferty form from its normal deviate.
CUT = 2.326
#: Fixed point of the statistics, and of log distances.
UNIT, STEP = 10_000, 1_000
#: Parameters of so many groups are broadcast; of more, joined by salt.
BROADCAST_GROUPS, SALTS = 20_000, 64

#: Statistic, and the standard deviation that is added to an estimate.  That of word_length,
#: punctuation and upper only keeps the matrix regular; the others are 0 in nearly all rows that an
#: estimate rests on, which then says nothing of their variance, and their floors stand for it.
STATISTICS = [("word_length", 0.002), ("symbols", 0.05), ("punctuation", 0.0003), ("upper", 0.0003), ("dup_lines", 0.2), ("repeats", 0.2)]
#: Standard deviations that the estimate of all rows is drawn to.
PRIOR = [0.2, 0.1, 0.02, 0.02, 0.2, 0.2]
_D = len(STATISTICS)
_NAMES = [f"v{k}" for k in range(_D)]

_COUNTS = pa.schema([("doc_id", pa.int64()), ("key", pa.string()), ("lang", pa.string()), ("source", pa.string())] + [(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *_NAMES)])


def _count(data: bytes, chars: bytes) -> int:
    return len(data) - len(data.translate(None, chars))


def statistics(text: str) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the vector."""
    data = text.encode()
    words = data.split()
    n, chars, symbols = len(words), len(text) - _count(data, WHITE), _count(data, SYMBOLS)
    lines = [x for x in data.split(b"\n") if x.strip(WHITE)]
    dup = len(lines) - len(set(lines))
    windows = window_hashes(word_hashes(words), WINDOW)
    repeated = 0
    if len(windows):
        _, place, times = np.unique(windows, return_inverse=True, return_counts=True)
        starts = np.flatnonzero(times[place] > 1)
        if len(starts):
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + WINDOW, -1)
            repeated = int(np.count_nonzero(np.cumsum(edge[:n])))
    # Short texts are drawn to what is usual, as their shares vary most.
    vector = (
        math.log((chars + 1500) / (n + 300)),
        math.sqrt(symbols / (chars + 50)),
        (_count(data, PUNCTUATION) + 52) / (chars + 2000),
        (_count(data, UPPER) + 30) / (chars + 2000),
        math.sqrt(dup / (len(lines) + 5)),
        math.sqrt(repeated / (n + 20)),
    )
    return (n, chars, symbols, dup, repeated, *(round(x * UNIT) for x in vector))


def _groups(docs: DataFrame) -> list[Column]:
    """lang and source, which are null where docs don't have them."""
    return [F.col(c).cast("string").alias(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("lang", "source")]


def measured(docs: DataFrame, keyed: bool = False) -> DataFrame:
    """doc_id, key (the SHA-256 of the text, if keyed), lang, source and the
    statistics of every row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(_COUNTS)
        for doc_id, text, key, lang, source in rows_of(batches, "doc_id", "text", "key", "lang", "source"):
            if out.add((doc_id, key, lang, source, *statistics(text))):
                yield out.take()
        yield from out.rest()

    key = F.sha2(F.coalesce("text", F.lit("")), 256) if keyed else F.lit(None).cast("string")
    kinds = ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'long'}" for f in _COUNTS)
    return texts(docs, key.alias("key"), *_groups(docs)).mapInArrow(count, kinds)


def _grouped(rows: DataFrame, least: int) -> DataFrame:
    """rows with their group g: language and source, or the pool that they fall into."""
    name = lambda *c: F.to_json(F.array(*c))
    fine, coarse = name(F.col("lang"), F.col("source")), name(F.col("lang"))
    sized = written(rows.groupBy(fine.alias("fine"), coarse.alias("coarse")).agg(F.count(F.lit(1)).alias("n")))
    small = sized.where(F.col("n") < least).groupBy("coarse").agg(F.sum("n").alias("pooled"))
    names = sized.join(small, "coarse", "left").select("fine", F.when(F.col("n") >= least, F.col("fine")).when(F.col("pooled") >= least, F.col("coarse")).otherwise("*").alias("g"))
    return _attached(rows.withColumn("fine", fine), written(names), sized.count(), "fine").drop("fine")


def _groups_of(rows: DataFrame) -> int:
    return rows.select("g").distinct().count()


def _attached(rows: DataFrame, table: DataFrame, groups: int, *key: str) -> DataFrame:
    """rows with the columns of table, which has some rows for each of so many
    groups; rows of groups that aren't there go."""
    if groups <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(table), [*key])
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", *_NAMES), F.lit(SALTS)))
    return salted.join(table.select("*", salts.alias("salt")), [*key, "salt"]).drop("salt")


def _distance() -> Column:
    """ln(1 + squared Mahalanobis distance) in fixed point, from centre c and whitening rows w."""
    x = [f"({n} / {float(UNIT)}D - get(c, {k}))" for k, n in enumerate(_NAMES)]
    z = [" + ".join(f"get(w, {i * _D + j}) * {x[j]}" for j in range(i + 1)) for i in range(_D)]
    return F.expr(f"CAST(round(log1p({' + '.join(f'power({v}, 2D)' for v in z)}) * {STEP}) AS BIGINT)")


def _floors() -> np.ndarray:
    return np.diag([f * f for _, f in STATISTICS])


_STATE = "g string, k long, n long, c array<double>, v array<double>, w array<double>, dof double, det double"


def _solved(moments: DataFrame) -> DataFrame:
    """g, k, n, c, v, w, dof, det from g, k and moments: the centre, covariance, whitening
    matrix, degrees of freedom and log determinant."""
    floors = _floors()
    schema = pa.schema([("g", pa.string()), ("k", pa.int64()), ("n", pa.int64()), *((x, pa.list_(pa.float64())) for x in "cvw"), ("dof", pa.float64()), ("det", pa.float64())])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(schema)
        for g, k, n, s, high, low in rows_of(batches, "g", "k", "n", "s", "high", "low"):
            centre, cov = [x / n / UNIT for x in s], _covariance(n, s, high, low)
            lower = np.linalg.cholesky(cov + floors)
            whiten = np.linalg.inv(lower)
            dof = max(1.0, float(np.trace(whiten @ cov @ whiten.T)))
            det = round(2 * float(np.log(np.diag(lower)).sum()), 9)
            if out.add((g, k, n, centre, cov.ravel().tolist(), whiten.ravel().tolist(), dof, det)):
                yield out.take()
        yield from out.rest()

    return moments.mapInArrow(solve, _STATE)


def _covariance(n: int, s: list[int], high: list[int], low: list[int]) -> np.ndarray:
    """From exact sums and sums of products of fixed-point numbers."""
    cov, at = np.zeros((_D, _D)), 0
    for i in range(_D):
        for j in range(i, _D):
            cov[i, j] = cov[j, i] = (((high[at] << 16) + low[at]) * n - s[i] * s[j]) / n / n / UNIT**2
            at += 1
    return cov


def _moments(rows: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """n, sums s, and sums of products in high and low bits, exact in 64 bits, of each group."""
    products = [f"{values[i]} * {values[j]}" for i in range(_D) for j in range(i, _D)]
    sums = [f"array({', '.join(f'sum({v})' for v in vs)}) AS {name}" for name, vs in (("s", values), ("high", [f"shiftright({p}, 16)" for p in products]), ("low", [f"({p}) & 65535L" for p in products]))]
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), *map(F.expr, sums))


def _started(rows: DataFrame) -> DataFrame:
    """g, c, w, dof from medians and quartiles."""
    # Values of few digits, so that the exact percentiles count few distinct ones.
    coarse = [F.percentile(F.round(F.col(n) / 10) * 10, F.lit([0.25, 0.5, 0.75])).alias(n) for n in _NAMES]
    q = rows.groupBy("g").agg(*coarse)
    centre = F.array(*(F.get(n, 1) / float(UNIT) for n in _NAMES))
    scales = [F.sqrt(F.pow((F.get(n, 2) - F.get(n, 0)) / (1.349 * UNIT), 2) + f * f) for n, (_, f) in zip(_NAMES, STATISTICS, strict=True)]
    whiten = F.array(*(1 / scales[i] if i == j else F.lit(0.0) for i in range(_D) for j in range(_D)))
    return q.select("g", centre.alias("c"), whiten.alias("w"), F.lit(float(_D)).alias("dof"))


def _starts(rows: DataFrame, groups: int) -> DataFrame:
    """g, k, c, w of the three starts of each group."""
    first = written(_started(rows).select("g", "c", "w"))
    at = _attached(rows, first, groups, "g")
    z = [f"(({n} / {float(UNIT)}D - get(c, {i})) * get(w, {i * _D + i})) AS z{i}" for i, n in enumerate(_NAMES)]
    far = "sqrt(" + " + ".join(f"z{i} * z{i}" for i in range(_D)) + ")"
    tangents = [f"CAST(round(tanh(z{i}) * {UNIT}) AS BIGINT) AS t{i}" for i in range(_D)]
    signs = [f"CAST(round(if({far} > 0, z{i} / {far}, 0D) * {UNIT}) AS BIGINT) AS u{i}" for i in range(_D)]
    at = written(at.selectExpr("g", *z).selectExpr("g", *tangents, *signs))
    tangents, signs = (_moments(at, ["g"], [f"{x}{i}" for i in range(_D)]) for x in "tu")
    both = tangents.withColumn("k", F.lit(1).cast("long")).unionByName(signs.withColumn("k", F.lit(2).cast("long"))).join(first, "g")
    schema = pa.schema([("g", pa.string()), ("k", pa.int64()), ("c", pa.list_(pa.float64())), ("w", pa.list_(pa.float64()))])

    def shape(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(schema)
        for g, k, n, s, high, low, c, w in rows_of(batches, "g", "k", "n", "s", "high", "low", "c", "w"):
            scatter = _covariance(n, s if k == 1 else [0] * _D, high, low) + 1e-6 * np.eye(_D)
            whiten = np.linalg.inv(np.linalg.cholesky(scatter)) @ np.reshape(w, (_D, _D))
            if out.add((g, k, c, whiten.ravel().tolist())):
                yield out.take()
        yield from out.rest()

    return first.withColumn("k", F.lit(0).cast("long")).unionByName(both.mapInArrow(shape, "g string, k long, c array<double>, w array<double>"))


def _concentrated(rows: DataFrame, now: DataFrame, groups: int, cover: float) -> DataFrame:
    """The state of each group and start after one step from now (g, k, c, w)."""
    at = _attached(rows, now.select("g", "k", "c", "w"), groups, "g").withColumn("d", _distance()).drop("c", "w")
    edge = at.groupBy("g", "k").agg(F.percentile("d", cover).alias("edge"))
    inner = _attached(at, edge, groups, "g", "k").where(F.col("d") <= F.col("edge"))
    return _solved(_moments(inner, ["g", "k"], _NAMES))


def _middles(rows: DataFrame) -> DataFrame:
    """g, middle: the median distance of each group."""
    return rows.groupBy("g").agg(F.percentile(F.col("d"), 0.5).alias("middle"))


def estimates(rows: DataFrame, cover: float = COVER, steps: int = STEPS) -> DataFrame:
    """g, c, w, dof, middle: centre, whitening matrix, degrees of freedom and median
    distance of each group, after a number of steps from medians and quartiles."""
    now, groups = written(_started(rows).withColumn("k", F.lit(0).cast("long"))), _groups_of(rows)
    for _ in range(steps):
        now = written(_concentrated(rows, now, groups, cover))
    at = _attached(rows, now.select("g", "c", "w"), groups, "g").withColumn("d", _distance())
    return written(now.join(_middles(at), "g"))


def least_determinants(rows: DataFrame, cover: float = COVER, trials: int = TRIALS, most: int = MOST_STEPS) -> DataFrame:
    """The state (g, det, k, n, c, v, w, dof) of each group where the best of its
    starts leads to no lower determinant."""
    groups = _groups_of(rows)
    now = written(_starts(rows, groups))
    for _ in range(trials):
        now = written(_concentrated(rows, now, groups, cover))
    names = ("det", "k", "n", "c", "v", "w", "dof")
    now = written(now.groupBy("g").agg(F.min(F.struct(*names)).alias("b")).select("g", "b.*"))
    done = []
    for _ in range(most - trials):
        # Only groups of which the last step lowered the determinant go on.
        last = now.select("g", F.struct(*names).alias("last"))
        step = written(_concentrated(rows, now, groups, cover).join(F.broadcast(last) if groups <= BROADCAST_GROUPS else last, "g"))
        done.append(step.where(F.col("det") >= F.col("last.det")).select("g", "last.*"))
        now = step.where(F.col("det") < F.col("last.det")).select("g", *names)
        if not now.limit(1).count():
            break
    return written(reduce(DataFrame.unionByName, [*done, now]))


def _drawn(n: float, own: np.ndarray, weight: float, to: np.ndarray) -> np.ndarray:
    return (n * own + weight * to) / (n + weight)


_LEVEL_NAMES = ["g", "wide", "all"]


def _shrunk(states: DataFrame, levels: DataFrame) -> DataFrame:
    """g, c, w, dof of each language and source, drawn to its language and to all;
    levels: g, wide, all, and the numbers of rows n_g, n_wide, n_all."""
    floors, prior = _floors(), np.diag(np.square(PRIOR))
    each = levels
    for name in _LEVEL_NAMES:
        own = states.select(F.col("g").alias(f"of_{name}"), F.col("c").alias(f"c_{name}"), F.col("v").alias(f"v_{name}"))
        each = each.join(own, F.col(name) == F.col(f"of_{name}")).drop(f"of_{name}")
    columns = ["g", *(f"{x}_{name}" for name in _LEVEL_NAMES for x in "ncv")]
    schema = pa.schema([("g", pa.string()), ("c", pa.list_(pa.float64())), ("w", pa.list_(pa.float64())), ("dof", pa.float64())])

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(schema)
        for g, *values in rows_of(batches, *columns):
            own = [(values[k], np.array(values[k + 1]), np.reshape(values[k + 2], (_D, _D))) for k in (0, 3, 6)]
            n, centre, cov = own[2]
            cov = _drawn(n, cov, PRIOR_ROWS, prior)
            for n, c, v in (own[1], own[0]):
                centre, cov = _drawn(n, c, POOL, centre), _drawn(n, v, POOL, cov)
            whiten = np.linalg.inv(np.linalg.cholesky(cov + floors))
            if out.add((g, centre.tolist(), whiten.ravel().tolist(), max(1.0, float(np.trace(whiten @ cov @ whiten.T))))):
                yield out.take()
        yield from out.rest()

    return each.select(*columns).mapInArrow(shrink, "g string, c array<double>, w array<double>, dof double")


def chi_square(z: float, d: float | Column = _D) -> float | Column:
    """The quantile of chi-square with d degrees at normal deviate z, about."""
    return d * (1 - 2 / (9 * d) + z * (2 / (9 * d)) ** 0.5) ** 3


def judge(docs: DataFrame, cut: float = CUT) -> DataFrame:
    """The statistics, distance and verdict of every row."""
    return _judged(docs, cut).drop("key", "lang", "source")


def _levels(rows: DataFrame) -> DataFrame:
    """rows with the names of their language and source (g), language (wide), and all."""
    name = lambda *c: F.to_json(F.array(*c))
    return rows.withColumns({"g": name("lang", "source"), "wide": name("lang"), "all": F.lit("*")})


def _exploded(rows: DataFrame, *columns: str) -> DataFrame:
    """A row for each level that a row is in, as g."""
    return rows.select(*columns, F.explode(F.array(*_LEVEL_NAMES)).alias("g"))


def _judged(docs: DataFrame, cut: float = CUT, keyed: bool = False) -> DataFrame:
    """judge() with key, lang and source."""
    rows = written(_levels(measured(docs, keyed)))
    # Read again and again, so dealt over all cores once.
    every = written(_exploded(rows, "doc_id", *_NAMES).repartition(2 * docs.sparkSession.sparkContext.defaultParallelism))
    states = least_determinants(every)
    sizes = written(every.groupBy("g").agg(F.count(F.lit(1)).alias("n")))
    levels = rows.select(*_LEVEL_NAMES).distinct()
    for name in _LEVEL_NAMES:
        levels = levels.join(sizes.select(F.col("g").alias(name), F.col("n").alias(f"n_{name}")), name)
    levels = written(levels)
    known = written(_shrunk(states, levels))
    groups = sizes.count()
    at = _attached(rows, known, groups, "g").withColumn("d", _distance()).drop("c", "w")
    middles = written(_middles(_exploded(at, "d")))
    drawn = levels.join(known.select("g", "dof"), "g")
    for name in _LEVEL_NAMES:
        drawn = drawn.join(middles.select(F.col("g").alias(name), (F.expm1(F.col("middle") / STEP)).alias(f"m_{name}")), name)
    # The median row has the median of chi-square.  The estimate of the inner rows is narrower than all
    # rows, so this is over 1 unless most rows are alike and there is no variance to scale by.
    scale = (F.col("n_all") * F.col("m_all") / chi_square(0.0, F.col("dof")) + PRIOR_ROWS) / (F.col("n_all") + PRIOR_ROWS)
    for name in ("wide", "g"):
        n = F.col(f"n_{name}")
        scale = (n * F.col(f"m_{name}") / chi_square(0.0, F.col("dof")) + POOL * scale) / (n + POOL)
    at = _attached(at, drawn.select("g", F.greatest(scale, F.lit(1.0)).alias("scale")), groups, "g")
    distance = F.expm1(F.col("d") / STEP) / F.col("scale")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    outlier = distance > chi_square(cut, F.col("dof"))
    return at.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~outlier).alias("kept"), distance.alias("distance"), "key", "lang", "source")


def filtered(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept.  Rows are told by doc_id, text, lang and
    source, as the verdict follows from the last three; null ids are ids."""
    names = ["doc_id", "key", "lang", "source"]
    gone = _judged(docs, keyed=True).where(~F.col("kept")).select(*(F.col(c).alias(f"__gone_{c}") for c in names)).distinct()
    own = [F.col("doc_id").cast("long"), F.sha2(F.coalesce(F.col("text"), F.lit("")), 256), *_groups(docs)]
    keyed = docs.withColumns({f"__own_{c}": x for c, x in zip(names, own, strict=True)})
    same = [F.col(f"__own_{c}").eqNullSafe(F.col(f"__gone_{c}")) for c in names]
    return keyed.join(gone, same, "left_anti").select(docs.columns)


def op8_robust_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents")).drop("distance")
