"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document.
Expectation-maximisation over the counts of vote patterns, taken from all
documents, estimates how often each labeller is right and how much of the corpus
is good, without any label. The posterior labels then train a linear scorer over
hashed shapes of tokens, which scores every whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from operator import eq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldframe.llm.common import append, column, slices, with_fields

GOOD, BAD, NONE = 1, 0, 2
#: Buckets of the hashed scorer.
BUCKET_BITS = 14
BUCKETS = 1 << BUCKET_BITS
#: Buckets set apart for repetition.
_TWICE, _SAME_PAIR = 0, 1
#: At most so many documents, the least by hash of their text, train the scorer.
SAMPLE = 6_000
EPOCHS = 12
KEEP_AT = 0.5

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#$%&*+<=>@\\^_`{|}~")] = True
#: Letters by case, digits as 9, marks as they are; letters beyond ASCII count as lower case.
_SHAPE = bytes(120 if 97 <= c <= 122 or c >= 128 else 88 if 65 <= c <= 90 else 57 if 48 <= c <= 57 else c for c in range(256))
_PLAIN = re.compile(rb"[\"'(\[]?(X?x+|X)(['-]X?x+)*[.,;:?!)\]\"']{0,2}")
_RUN = re.compile(rb"(.)\1{2,}", re.DOTALL)
_MIX = 0x9E3779B97F4A7C15


class Shapes(dict):
    """Shape of a token -> its hash, runs cut to two, and whether it looks like a word of prose."""

    def __missing__(self, shape: bytes) -> tuple[int, bool]:
        if len(self) > 100_000:
            self.clear()
        found = self[shape] = xxhash.xxh64_intdigest(_RUN.sub(rb"\1\1", shape)), bool(_PLAIN.fullmatch(shape))
        return found


_shapes = Shapes()


def _shaped(data: bytes) -> list[tuple[int, bool]]:
    return [_shapes[x] for x in data.translate(_SHAPE).split()]


def _band(value: float, good: bool, bad: bool) -> int:
    return BAD if bad else GOOD if good else NONE


LABELLERS = ("few symbols", "not shouted", "few exclamations", "sentence lengths", "plain words", "few words said twice", "varied pairs", "no ruling word")


def votes(text: str | None, shaped: list[tuple[int, bool]] | None = None) -> list[int]:
    """The labellers' votes, in the order of LABELLERS; a text without words gets a bad vote of the first alone."""
    data = (text or "").encode()
    tokens = data.split()
    if not tokens:
        return [BAD] + [NONE] * (len(LABELLERS) - 1)
    hist = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = len(tokens)
    upper, lower = int(hist[65:91].sum()), int(hist[97:123].sum())
    symbols = hist[_SYMBOLS].sum() / len(data)
    shout = upper / max(upper + lower, 1)
    marks = int(hist[33]) / words
    sentence = words / max(int(hist[46] + hist[33] + hist[63]), 0.5)
    plain = sum(x[1] for x in shaped or _shaped(data)) / words
    twice = sum(map(eq, tokens, tokens[1:])) / words
    varied = len(set(zip(tokens, tokens[1:], strict=False))) / max(words - 1, 1)
    ruling = max(Counter(tokens).values()) / words
    long = words >= 20
    return [
        _band(symbols, symbols < 0.004, words >= 12 and symbols > 0.015),
        _band(shout, shout < 0.12, shout > 0.25 and words >= 12),
        _band(marks, marks < 0.02, words >= 12 and marks > 0.08),
        _band(sentence, 4 <= sentence <= 40, long and (sentence > 80 or sentence < 1.5)),
        _band(plain, plain > 0.93, plain < 0.8 and words >= 12),
        _band(twice, twice < 0.05, long and twice > 0.12),
        _band(varied, varied > 0.7, long and varied < 0.5),
        _band(ruling, long and ruling < 0.15, long and ruling > 0.25),
    ]


class Labels(NamedTuple):
    """What expectation-maximisation found: the share of good documents; P(vote | class), of votes cast, as (labeller, class, vote)."""

    prior: float
    votes: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """P(good) of each row of votes."""
        log = np.concatenate((np.log(self.votes), np.zeros((len(self.votes), 2, 1))), 2)  # no vote says nothing
        at = np.arange(patterns.shape[1])
        good = np.log(self.prior) + log[at, GOOD, patterns].sum(1)
        bad = np.log(1 - self.prior) + log[at, BAD, patterns].sum(1)
        return 1 / (1 + np.exp(np.clip(bad - good, -60, 60)))


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> Labels:
    """EM over distinct vote patterns and their counts, begun from the majority of the votes cast."""
    cast = np.maximum((patterns != NONE).sum(1), 1)
    good = np.clip((patterns == GOOD).sum(1) / cast, 0.02, 0.98)
    for _ in range(rounds):
        weight = np.stack([(1 - good) * counts, good * counts])
        table = np.stack([[[(w * (patterns[:, k] == v)).sum() for v in (BAD, GOOD)] for w in weight] for k in range(patterns.shape[1])])
        table = (table + 0.5) / (table + 0.5).sum(2, keepdims=True)
        prior = float(np.clip(weight[1].sum() / max(counts.sum(), 1e-9), 1e-3, 1 - 1e-3))
        found = Labels(prior, table)
        now = found.posterior(patterns)
        if np.abs(now - good).max() < 1e-6:
            break
        good = now
    return found


def features(text: str | None, shaped: list[tuple[int, bool]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values: roots of the shares of token shapes, of pairs of them, and of tokens that repeat the one before."""
    data = (text or "").encode()
    shaped = _shaped(data) if shaped is None else shaped
    h = np.fromiter((x[0] for x in shaped), np.uint64, len(shaped))
    with np.errstate(over="ignore"):
        pair = h[:-1] * np.uint64(_MIX) + h[1:]
        both = np.concatenate((h, pair)) * np.uint64(_MIX) >> np.uint64(64 - BUCKET_BITS)
    count = np.bincount(both.astype(np.int64), minlength=BUCKETS)
    tokens = data.split()
    count[_TWICE] = sum(map(eq, tokens, tokens[1:]))
    count[_SAME_PAIR] = len(tokens) - len(set(zip(tokens, tokens[1:], strict=False)))
    at = np.flatnonzero(count)
    return at, np.sqrt(count[at] / max(len(tokens), 1))


def train(rows: list[tuple[np.ndarray, np.ndarray, float]]) -> np.ndarray:
    """Weights, the bias last, by AdaGrad on the logistic loss against the posterior labels."""
    w, g2 = np.zeros(BUCKETS + 1), np.full(BUCKETS + 1, 1e-6)
    for _ in range(EPOCHS):
        for at, x, y in rows:
            p = 1 / (1 + np.exp(-np.clip(w[at] @ x + w[-1], -30, 30)))
            g = (p - y) * x + 1e-5 * w[at]
            g2[at] += g * g
            w[at] -= 0.3 * g / np.sqrt(g2[at])
            g2[-1] += (p - y) ** 2
            w[-1] -= 0.3 * (p - y) / np.sqrt(g2[-1])
    return w


def score(text: str | None, w: np.ndarray) -> float:
    at, x = features(text)
    return float(1 / (1 + np.exp(-np.clip(w[at] @ x + w[-1], -30, 30))))


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        codes = [sum(v * 3**k for k, v in enumerate(votes(t))) for t in column(batch, "text").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int32())], names=["pattern"])


def _patterns(codes: np.ndarray) -> np.ndarray:
    return codes[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


class Model(NamedTuple):
    labels: Labels
    weights: np.ndarray


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """EM over the vote patterns of all documents (3^8 counts reach the driver at most), then the scorer from at most `sample` of them, in one task.

    An empty table gives a scorer that calls every text good with 0.5. The
    driver gets the weights, not features.
    """
    found = docs.select("text").mapInArrow(_vote, "pattern int").groupBy("pattern").count().collect()
    if not found:
        return Model(Labels(0.5, np.full((len(LABELLERS), 2, 2), 1 / 2)), np.zeros(BUCKETS + 1))
    labels = estimate(_patterns(np.array([r["pattern"] for r in found])), np.array([r["count"] for r in found], float))
    # Distinct by hash: copies would else fill the sample.
    chosen = docs.select(F.xxhash64(F.lit(7), "text").alias("h")).distinct().orderBy("h").limit(sample)
    texts = docs.select(F.xxhash64(F.lit(7), "text").alias("h"), "text").join(F.broadcast(chosen), "h").dropDuplicates(["h"])
    rows = texts.mapInArrow(_featurise, "h bigint, pattern int, at binary, x binary").repartition(1).sortWithinPartitions("h")
    weights = rows.mapInArrow(_trained(docs.sparkSession.sparkContext.broadcast(labels)), "weights binary").collect()
    return Model(labels, np.frombuffer(weights[0][0]))


def _trained(labels):
    """All rows in one order -> the weights. A row has at most BUCKETS features, so that the task holds at most 12 bytes for each of those and each row of the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, patterns = [], []
        for batch in batches:
            patterns += column(batch, "pattern").to_pylist()
            rows += [(np.frombuffer(at, np.int32), np.frombuffer(x, np.float32)) for at, x in zip(column(batch, "at").to_pylist(), column(batch, "x").to_pylist(), strict=True)]
        if rows:
            goods = labels.value.posterior(_patterns(np.array(patterns)))
            yield pa.RecordBatch.from_arrays([pa.array([train([(at, x, float(y)) for (at, x), y in zip(rows, goods, strict=True)]).tobytes()], pa.binary())], names=["weights"])

    return run


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = column(batch, "text").to_pylist()
        both = [features(t) for t in texts]
        yield append(
            batch,
            ["h"],
            pattern=pa.array([sum(v * 3**k for k, v in enumerate(votes(t))) for t in texts], pa.int32()),
            at=pa.array([a.astype(np.int32).tobytes() for a, _ in both], pa.binary()),
            x=pa.array([x.astype(np.float32).tobytes() for _, x in both], pa.binary()),
        )


def _scorer(weights, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value.astype(np.float64)
        for batch in slices(batches):
            yield append(batch, keep, quality_score=pa.array([score(t, w) for t in column(batch, "text").to_pylist()], pa.float64()))

    return run


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of docs and quality_score (0 to 1, higher: better); a column of that name is replaced. Null counts as empty; rows stay as they are."""
    keep = [c for c in docs.columns if c != "quality_score"]
    weights = docs.sparkSession.sparkContext.broadcast(model.weights.astype(np.float32))
    return docs.select(*keep).mapInArrow(_scorer(weights, keep), with_fields(docs.select(*keep).schema, "quality_score double"))


def op6_quality_classifier(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, score, keep (score of at least KEEP_AT), a row for each document."""
    out = scored(docs.select("doc_id", "text"), fit(docs, sample))
    return out.select("doc_id", F.col("quality_score").alias("score"), (F.col("quality_score") >= KEEP_AT).alias("keep"))


def kept(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents that the classifier keeps, with the columns they had."""
    at = "quality_score"
    had = docs.withColumnRenamed(at, "quality_score_before") if at in docs.columns else docs
    return scored(had, fit(docs, sample)).filter(F.col(at) >= KEEP_AT).drop(at).toDF(*docs.columns)
