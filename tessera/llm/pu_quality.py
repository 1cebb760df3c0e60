"""Quality scores by positive-unlabelled learning.

A small network on statistics of the text is fitted by minimising the
non-negative unbiased risk: with positives P, unlabelled text U and class prior
p, the risk p * R(P, +) + max(0, R(U, -) - p * R(P, -)); where the bracket is
negative its gradient is taken with the sign turned, which keeps the network
from fitting unlabelled text as negative.  Positives are rows labelled 1 of the
training fold; unlabelled rows are documents of the training fold, whatever
their label.  Rows labelled 0 are used for nothing.

The prior is estimated from positives and unlabelled rows alone: two networks are
fitted to tell them apart, each on one half of either, and score the other half.
The share of unlabelled rows with a score of at least c, over that of positives,
is at least the prior, and equal to it where only positives score so high; the
estimate is this ratio at the c at which its upper confidence bound is least.  It
is held within PRIOR.

Fitted on about SAMPLE positives and SAMPLE unlabelled rows, chosen by the hash
of their ids; every row is scored, over its whole text.  Held-out rows (crc32 of
doc_id as text, modulo 3, is 1) take no part in the fit.  Language, source,
doc_id and labels are no inputs.

Null and empty texts are scored like others, from the statistics of no words.
Without positives or unlabelled rows every score is 0.5.  A null doc_id is not held out and is not fitted on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality_rules import UNIT, _count, statistics
from .runtime import Out, read, rows_of, texts, written

#: Rows of either kind that the network is fitted on, about.
SAMPLE = 20_000
PRIOR = (0.02, 0.98)
HIDDEN, EPOCHS, RATE, DECAY, SEED = 16, 400, 0.02, 1e-4, 7
#: Epochs of the networks that estimate the prior, and the chance that its bound doesn't hold.
PRIOR_EPOCHS, DOUBT = 150, 0.1


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def features(text: str) -> list[float]:
    n, chars, symbols, _, _, *vector = statistics(text)
    data = text.encode()
    words = data.lower().split()
    lines = [x.strip() for x in data.split(b"\n") if x.strip()]
    ended = sum(x[-1:] in (b".", b"!", b"?") for x in lines)
    return [
        *(v / UNIT for v in vector),
        math.log1p(n),
        math.sqrt(_count(data, b"|") / (chars + 50)),
        math.sqrt(_count(data, b"!") / (chars + 50)),
        math.sqrt(_count(data, b"0123456789") / (chars + 50)),
        math.sqrt(_count(data, b"#$%&*<>") / (chars + 50)),
        (len(set(words)) + 10) / (n + 10),
        math.log1p(n / (len(lines) + 1)),
        (ended + 1) / (len(lines) + 2),
    ]


class Network:
    """One hidden layer on standardised inputs."""

    def __init__(self, size: int, hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.middle, self.scale = np.zeros(size), np.ones(size)
        self.parts = [rng.normal(0, size**-0.5, (size, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.clip((x - self.middle) / self.scale, -8, 8)
        h = np.tanh(x @ self.parts[0] + self.parts[1])
        return x, h, h @ self.parts[2] + self.parts[3][0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.forward(x)[2], -30, 30)))

    def gradients(self, x: np.ndarray, h: np.ndarray, dz: np.ndarray) -> list[np.ndarray]:
        dh = np.outer(dz, self.parts[2]) * (1 - h * h)
        return [x.T @ dh, dh.sum(0), h.T @ dz, np.array([dz.sum()])]


def non_negative_risk(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The risk of outputs for positives and unlabelled rows, and its gradients."""
    sp, su = 1 / (1 + np.exp(-np.clip(zp, -30, 30))), 1 / (1 + np.exp(-np.clip(zu, -30, 30)))
    as_positive = np.logaddexp(0, -zp).mean()
    negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    dp, du = (prior * (sp - 1) - prior * sp, su) if negative >= 0 else (prior * sp, -su)
    return float(prior * as_positive + max(0.0, negative)), dp / len(zp), du / len(zu)


def contrast_risk(zp: np.ndarray, zu: np.ndarray, _: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The logistic loss of telling positives from unlabelled rows, at equal weights."""
    sp, su = 1 / (1 + np.exp(-np.clip(zp, -30, 30))), 1 / (1 + np.exp(-np.clip(zu, -30, 30)))
    return float(np.logaddexp(0, -zp).mean() + np.logaddexp(0, zu).mean()), (sp - 1) / len(zp), su / len(zu)


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, epochs: int = PRIOR_EPOCHS, doubt: float = DOUBT) -> float:
    """The share of positives among unlabelled rows, without any negatives."""
    if min(len(positive), len(unlabelled)) < 2:
        return 0.5
    # Rows come sorted, so every other one is a fair half.
    ratios = []
    for k in (0, 1):
        net = fit(positive[k::2], unlabelled[k::2], 0.5, epochs, contrast_risk)[0]
        ratios.append(least_ratio(net.score(positive[1 - k :: 2]), net.score(unlabelled[1 - k :: 2]), doubt))
    return min(max(sum(ratios) / 2, PRIOR[0]), PRIOR[1])


def least_ratio(positive: np.ndarray, unlabelled: np.ndarray, doubt: float = DOUBT) -> float:
    """The share of scores of at least c among unlabelled rows over that among
    positives, at the c of the least upper bound."""
    cuts = np.unique(positive)
    qp = 1 - np.searchsorted(np.sort(positive), cuts) / len(positive)
    qu = 1 - np.searchsorted(np.sort(unlabelled), cuts) / len(unlabelled)
    slack = sum(math.sqrt(math.log(4 / doubt) / 2 / len(x)) for x in (positive, unlabelled))
    return float((qu / qp)[np.argmin((qu + slack) / qp)])


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = EPOCHS, risk=non_negative_risk) -> tuple[Network, list[float]]:
    """A network and its risk after each epoch (whole batches, Adam)."""
    net = Network(unlabelled.shape[1])
    net.middle, net.scale = unlabelled.mean(0), unlabelled.std(0) + 1e-3
    first, second, risks = [np.zeros_like(w) for w in net.parts], [np.zeros_like(w) for w in net.parts], []
    for epoch in range(1, epochs + 1):
        xp, hp, zp = net.forward(positive)
        xu, hu, zu = net.forward(unlabelled)
        now, dp, du = risk(zp, zu, prior)
        risks.append(now)
        grads = [a + b for a, b in zip(net.gradients(xp, hp, dp), net.gradients(xu, hu, du), strict=True)]
        for k, g in enumerate(grads):
            g = g + DECAY * net.parts[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            net.parts[k] = net.parts[k] - RATE * (first[k] / (1 - 0.9**epoch)) / (np.sqrt(second[k] / (1 - 0.999**epoch)) + 1e-8)
    return net, risks


_FEATURES = pa.schema([("kind", pa.int64()), ("x", pa.list_(pa.float64()))])
_SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def sample(docs: DataFrame, labels: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of positives and of unlabelled rows."""
    fold = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    ones = fold.where("quality = 1").count()
    train = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    all_ = train.select("doc_id").count()
    share = lambda n: F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 31)) < int(size / max(n, 1) * (1 << 31))
    # Bounded by size, about; so it can be broadcast.
    chosen = written(fold.where((F.col("quality") == 1) & share(ones)).select("doc_id").distinct())
    kinds = train.join(F.broadcast(chosen.withColumn("p", F.lit(True))), "doc_id", "left").select("text", F.coalesce("p", F.lit(False)).alias("p"), share(all_).alias("u")).where("p or u")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(_FEATURES)
        for text, p, u in rows_of(batches, "text", "p", "u"):
            x = features(text)
            for kind, wanted in ((1, p), (0, u)):
                if wanted and out.add((kind, x)):
                    yield out.take()
        yield from out.rest()

    table = kinds.mapInArrow(measure, "kind long, x array<double>").toArrow()
    kind = np.array(table["kind"])
    x = np.array(table["x"].to_pylist(), np.float64).reshape(len(kind), len(features("")))
    order = np.lexsort((*x.T, kind))  # the fit doesn't depend on the order of rows
    return x[order][kind[order] == 1], x[order][kind[order] == 0]


def score(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    docs = texts(docs)
    positive, unlabelled = sample(docs, labels, size)
    net = fit(positive, unlabelled, estimated_prior(positive, unlabelled))[0] if len(positive) and len(unlabelled) else None

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                x = np.array([features(t) for t in part.column("text").to_pylist()])
                s = net.score(x) if net else np.full(len(x), 0.5)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s)], schema=_SCORES)

    scored = docs.mapInArrow(judge, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
