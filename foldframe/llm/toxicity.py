"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Every coordinate has its own rate, and the L1 term leaves most weights at zero,
so that the model travels as a short list of buckets and weights. Besides words,
their pairs and pairs around one word, a word's first four to six characters
count as a unigram of its own (a stem): inflected forms share it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldframe.llm.common import append, column, packed, slices, unpacked, with_fields

BUCKET_BITS = 20
#: At most so many labelled documents, the least by hash of their id, train the model.
SAMPLE = 20_000
EPOCHS = 3
REJECT_AT = 0.3
STEMS = (4, 5, 6)

ALPHA, BETA, L1, L2 = 0.5, 1.0, 4.0, 1.0

_WORD = re.compile(r"\w+")
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
_DOWN = np.uint64(64 - BUCKET_BITS)


class Words(dict):
    """Word -> its row; rows hold the word's hash and the buckets of its unigram and stems. Starts anew when it holds `most` words."""

    def __init__(self, most: int = 100_000) -> None:
        self.hash, self.own = np.empty(most, np.uint64), np.empty((most, 1 + len(STEMS)), np.uint32)

    def __missing__(self, word: str) -> int:
        row = self[word] = len(self)
        h = xxhash.xxh64_intdigest(word)
        self.hash[row] = h
        stems = [h if len(word) <= n else xxhash.xxh64_intdigest(f"{word[:n]}~") for n in STEMS]
        self.own[row] = [x >> (64 - BUCKET_BITS) for x in (h, *stems)]
        return row

    def rows(self, words: list[str]) -> np.ndarray:
        if len(self) + len(words) > len(self.hash):
            self.clear()
            if len(words) > len(self.hash):
                self.__init__(2 * len(words))
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


_words = Words()


def buckets(text: str | None) -> np.ndarray:
    """Buckets of all features of a text, with repeats."""
    at = _words.rows(_WORD.findall((text or "").lower()))
    h = _words.hash[at]
    pair = h[:-1] * _A + h[1:] * _B
    skip = h[:-2] * _C + h[2:] * _D
    mixed = np.concatenate((pair, skip)) * _A >> _DOWN
    return np.concatenate((_words.own[at].ravel(), mixed.astype(np.uint32)))


class Model(NamedTuple):
    """Buckets with a weight, their weights, the bias."""

    at: np.ndarray
    weights: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BUCKET_BITS, np.float32)
        out[self.at] = self.weights
        return out


class Learner:
    """FTRL-proximal; a feature is there or isn't."""

    def __init__(self) -> None:
        n = 1 << BUCKET_BITS
        self.z, self.n = np.zeros(n), np.zeros(n)
        self.bias_z = self.bias_n = 0.0

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) > L1, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2), 0.0)

    def bias(self) -> float:
        return -self.bias_z / ((BETA + self.bias_n**0.5) / ALPHA)

    def learn(self, at: np.ndarray, label: int) -> None:
        w, b = self.weights(at), self.bias()
        g = float(1 / (1 + np.exp(-np.clip(w.sum() + b, -30, 30)))) - label
        n = self.n[at]
        more = n + g * g
        self.z[at] += g - (np.sqrt(more) - np.sqrt(n)) / ALPHA * w
        self.n[at] = more
        more = self.bias_n + g * g
        self.bias_z += g - (more**0.5 - self.bias_n**0.5) / ALPHA * b
        self.bias_n = more

    def model(self) -> Model:
        at = np.flatnonzero(np.abs(self.z) > L1).astype(np.int32)
        return Model(at, self.weights(at).astype(np.float32), self.bias())


def score(text: str | None, dense: np.ndarray, bias: float) -> float:
    at = buckets(text)
    at = np.unique(at[dense[at] != 0])
    return float(1 / (1 + np.exp(-np.clip(dense[at].sum(dtype=np.float64) + bias, -30, 30))))


def held_out(doc_id: Column) -> Column:
    """Rows from which no label is learned: crc32 of the id as text leaves 2 by 4. False for a null id, which has no label."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _featurised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        yield append(batch, ["h", "doc_id", "toxic"], features=pa.array([packed(np.unique(buckets(t))) for t in column(batch, "text").to_pylist()], pa.binary()))


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of all epochs, in their order -> the model, one row. No row is held."""
    learner = Learner()
    for batch in slices(batches, "features"):
        for data, label in zip(column(batch, "features").to_pylist(), column(batch, "toxic").to_pylist(), strict=True):
            learner.learn(unpacked(data), int(label))
    at, weights, bias = learner.model()
    yield pa.RecordBatch.from_arrays([pa.array([at.tobytes()], pa.binary()), pa.array([weights.tobytes()], pa.binary()), pa.array([float(bias)])], names=["at", "weights", "bias"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model from docs with a 0/1 label that are not held out; several labels of an id count as the highest.

    Without any such row it scores every text 0.5 and rejects it only if the
    caller's threshold says so. Features are hashed where the texts are; one
    task puts them in one order, whatever the partitions, and streams them to
    the learner, once for each epoch. The driver gets the weights that aren't
    zero, of at most 2^BUCKET_BITS.
    """
    known = labels.filter("toxic in (0, 1)").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = known.select("doc_id", "toxic", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("h", "doc_id", "toxic", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = rows.mapInArrow(_featurised, f"h bigint, doc_id {kind}, toxic int, features binary").repartition(1)
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(EPOCHS)))).sortWithinPartitions("epoch", "h", "doc_id", "features")
    found = rows.select("toxic", "features").mapInArrow(_trained, "at binary, weights binary, bias double").first()
    return Model(np.frombuffer(found["at"], np.int32), np.frombuffer(found["weights"], np.float32), found["bias"]) if found else Learner().model()


def _scorer(model, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense, bias = model.value.dense(), model.value.bias
        for batch in slices(batches):
            yield append(batch, keep, toxicity=pa.array([score(t, dense, bias) for t in column(batch, "text").to_pylist()], pa.float64()))

    return run


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of docs and toxicity (0 to 1); a column of that name is replaced. Null counts as empty; rows stay as they are."""
    keep = [c for c in docs.columns if c != "toxicity"]
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(*keep).mapInArrow(_scorer(sent, keep), with_fields(docs.select(*keep).schema, "toxicity double"))


def op7_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from REJECT_AT on), a row for each document."""
    out = scored(docs.select("doc_id", "text"), fit(docs, labels, sample))
    return out.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= REJECT_AT).cast("int").alias("predicted"),
    )


def accepted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents that score below REJECT_AT, with the columns they had."""
    had = docs.withColumnRenamed("toxicity", "toxicity_before") if "toxicity" in docs.columns else docs
    return scored(had, fit(docs, labels, sample)).filter(F.col("toxicity") < REJECT_AT).drop("toxicity").toDF(*docs.columns)
