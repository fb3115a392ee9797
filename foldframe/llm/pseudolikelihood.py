"""Masked pseudo-likelihood of documents by a bidirectional window network, trained in numpy.

Each token is predicted from the two before it and the two after it, itself
masked: their embeddings, weighted by position, add up and pass a tanh; the
product with a token's vector moves that token's log-probability away from the
one that its count gives. Training is noise-contrastive: a token against others
of the corpus, which teaches log-probabilities that add up to one without a sum
over the vocabulary, so that a step costs the same for any vocabulary. The summed conditional log-probabilities score a document.

The vocabulary holds all tokens of a least count, which grows with the square
root of the corpus, so that the network grows with it; rarer tokens share
buckets, a third as many as there are frequent tokens, and a token of a bucket
has an even share of it among the types that the corpus has there.

Documents are dealt to shards by hash. The number of shards follows from counts
alone, a shard's documents are ordered by hash and its steps don't follow files
or batches, so that the network is the same however the table is partitioned.
Training goes in ROUNDS rounds, each over its part of the shards: every shard
trains a replica from the same start, and a distributed sum, in the order of the
shards, averages what the replicas moved, each token by how often it was met.
"""

from __future__ import annotations

import ctypes
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldframe.llm.common import append, column, packed, slices, stable, unpacked, with_fields

#: The most frequent tokens that have an id of their own in a corpus of any size.
FREQUENT = 4096
#: A token of LEAST_COUNT, and of the square root of all tokens over ROOT_SHARE, has an id of its own too.
LEAST_COUNT, ROOT_SHARE = 10, 225
#: Of embeddings and vectors; the last of a vector is the token's bias.
WIDTH = 16
AROUND = (-2, -1, 1, 2)
#: Tokens of a training step and of a block, in which each has the others for noise; the rate of AdaGrad.
STEP, BLOCK, RATE = 8192, 32, 0.1
#: Rounds of averaging, and tokens of a shard for each id at least: what a replica sends stays below what it reads.
ROUNDS, SHARE = 3, 32
LEAST_SHARD = 1 << 19
#: A task sends on its token counts when it holds so many distinct ones.
MOST_COUNTS = 200_000

_REACH = max(AROUND)
#: Ids of a piece of the averaged weights.
_EACH = 1024
_TOKEN = re.compile(r"\w+|[^\w\s]")


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower())


def size(frequent: int) -> int:
    """Ids for so many frequent tokens and their buckets."""
    return frequent + frequent // 3 + 1


def one_thread() -> None:
    """A worker has one core: the threads of numpy's matrix library would only wait for each other."""
    with open("/proc/self/maps") as f:
        paths = {line.split()[-1] for line in f if "openblas" in line}
    for path in paths:
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if found := getattr(ctypes.CDLL(path), name, None):
                found(1)
                break


class Ids(dict):
    """Token -> id; rare ones by hash. Starts anew when it holds too many."""

    def __init__(self, frequent: list[str]) -> None:
        super().__init__({t: i for i, t in enumerate(frequent)})
        self.frequent = frequent
        self.rare = size(len(frequent)) - len(frequent)

    def __missing__(self, token: str) -> int:
        if len(self) > len(self.frequent) + 100_000:
            self.clear()
            self.update((t, i) for i, t in enumerate(self.frequent))
            if token in self:
                return self[token]
        found = self[token] = len(self.frequent) + xxhash.xxh64_intdigest(token) % self.rare
        return found

    def of(self, text: str | None) -> np.ndarray:
        own = tokens(text)
        return np.fromiter(map(self.__getitem__, own), np.int32, len(own))


class Vocabulary(NamedTuple):
    """Frequent tokens, a count for each id (buckets have even shares of what is left), and the types of a bucket on average, 1 at least."""

    frequent: list[str]
    counts: np.ndarray
    types: float

    def unigram(self) -> np.ndarray:
        """Probability of each id."""
        floored = np.maximum(self.counts, 0.5)
        return floored / floored.sum()


class Network(NamedTuple):
    """Embeddings, weights of the positions around, vectors with the bias last. Embeddings and vectors have a last row for the pad."""

    inner: np.ndarray
    place: np.ndarray
    outer: np.ndarray

    @staticmethod
    def start(n: int) -> Network:
        """Before training: every token as probable as its count says, nearly."""
        rng = np.random.Generator(np.random.PCG64(1))
        draw = lambda *shape: (rng.random(shape, np.float32) - 0.5)
        inner, outer = draw(n + 1, WIDTH), draw(n + 1, WIDTH) * 0.1
        outer[:, -1] = 0
        return Network(inner, np.ones((len(AROUND), WIDTH), np.float32), outer)

    @property
    def pad(self) -> int:
        return len(self.inner) - 1

    def hidden(self, x: np.ndarray) -> np.ndarray:
        """From the embeddings of a line, REACH more at both ends, what is seen around each place; the last is 1, for the bias."""
        n = len(x) - 2 * _REACH
        h = x[:n] * self.place[0]
        for k, off in enumerate(AROUND[1:], 1):
            h += x[_REACH + off : _REACH + off + n] * self.place[k]
        np.tanh(h, out=h)
        h[:, -1] = 1
        return h


class Trainer:
    """AdaGrad on the noise-contrastive loss of steps of a line.

    The tokens of a step lie in blocks of BLOCK, a block's tokens far apart. What
    stands around each is held against its own token and, as noise, against the
    others of its block, which come by their counts since they are of the corpus.
    """

    def __init__(self, net: Network) -> None:
        self.net = Network(*(x.copy() for x in net))
        self.squares = [np.full(x.shape, 1e-10, np.float32) for x in net]

    def gradients(self, line: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """Of the loss of the tokens of line but REACH at both ends, a multiple of BLOCK: (ids, rows) of embeddings, places, (ids, rows) of vectors."""
        net, target = self.net, line[_REACH:-_REACH]
        n = len(target)
        blocks = lambda x: x.reshape(BLOCK, n // BLOCK, *x.shape[1:]).swapaxes(0, 1)
        x = net.inner[line]
        h, vectors = np.ascontiguousarray(blocks(net.hidden(x))), np.ascontiguousarray(blocks(net.outer[target]))
        # Of each pair: how likely it is a token and what stands around it, not noise.
        g = h @ -vectors.swapaxes(1, 2)
        np.exp(np.minimum(g, 60, out=g), out=g)
        g *= BLOCK - 1
        g += 1
        np.reciprocal(g, out=g)
        at = np.arange(BLOCK)
        g[:, at, at] -= 1
        known = np.ascontiguousarray(blocks(target != net.pad))
        some = np.flatnonzero(~known.all(1))
        g[some] *= known[some, :, None] & known[some, None, :]
        back = g @ vectors
        back *= 1 - h * h  # the last of h is 1, so that nothing goes back from the bias
        rows = (g.swapaxes(1, 2) @ h).swapaxes(0, 1).reshape(n, WIDTH)
        moved = back.swapaxes(0, 1).reshape(n, WIDTH)
        spread, places = np.zeros_like(x), np.empty_like(net.place)
        for k, off in enumerate(AROUND):
            part = slice(_REACH + off, _REACH + off + n)
            spread[part] += moved * net.place[k]
            places[k] = np.einsum("ij,ij->j", moved, x[part])
        return (line, spread), places, (target, rows)

    def learn(self, line: np.ndarray) -> None:
        short = (2 * _REACH - len(line)) % BLOCK
        if short:
            line = np.concatenate((line, np.full(short, self.net.pad, np.int32)))
        inner, places, outer = self.gradients(line)
        self._move(1, slice(None), places)
        for i, (ids, rows) in ((0, inner), (2, outer)):
            order = np.argsort(ids.astype(np.uint16) if self.net.pad < 1 << 16 else ids, kind="stable")
            ids = ids[order]
            first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
            self._move(i, ids[first], np.add.reduceat(rows[order], first, axis=0))

    def _move(self, part: int, at: np.ndarray | slice, g: np.ndarray) -> None:
        s = self.squares[part][at] + g * g
        self.squares[part][at] = s
        np.sqrt(s, out=s)
        np.divide(g, s, out=s)
        s *= RATE
        self.net[part][at] -= s


def lined(ids: list[np.ndarray], pad: int) -> np.ndarray:
    """Documents one after the other; pads, REACH of them, stand before and after each."""
    gap = np.full(_REACH, pad, np.int32)
    return np.concatenate([gap, *[x for own in ids for x in (own, gap)]])


def contrasts(net: Network, line: np.ndarray) -> np.ndarray:
    """How much the network moves each token's log-probability from that of its count, for the tokens of line but REACH at both ends; 0 for pads."""
    target, out = line[_REACH:-_REACH], []
    for at in range(0, len(target), STEP):
        own = target[at : at + STEP]
        h = net.hidden(net.inner[line[at : at + len(own) + 2 * _REACH]])
        out.append(np.where(own == net.pad, 0, np.einsum("ij,ij->i", h, net.outer[own])))
    return np.concatenate(out) if out else np.empty(0)


class Model(NamedTuple):
    vocabulary: Vocabulary
    net: Network

    def unigrams(self) -> np.ndarray:
        """Log-probability of each id by its count, in a bucket of one of its types; 0 for the pad."""
        log = np.log(self.vocabulary.unigram())
        log[len(self.vocabulary.frequent) :] -= np.log(self.vocabulary.types)
        return np.append(log, 0.0)


def log_likelihoods(ids: list[np.ndarray], net: Network, unigrams: np.ndarray) -> np.ndarray:
    """Summed log-probability of each document's tokens."""
    line = lined(ids, net.pad)
    log = contrasts(net, line) + unigrams[line[_REACH:-_REACH]]
    sums = np.concatenate(([0.0], np.cumsum(log, dtype=np.float64)))
    sizes = np.array([len(x) for x in ids])
    first = np.concatenate(([0], np.cumsum(sizes + _REACH)[:-1]))
    return sums[first + sizes] - sums[first]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[str] = Counter()

    def sent() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array(list(held.values()), pa.int64())], names=["token", "n"])
        held.clear()
        return out

    for batch in slices(batches):
        for text in column(batch, "text").to_pylist():
            held.update(tokens(text))
            if len(held) >= MOST_COUNTS:
                yield sent()
    if held:
        yield sent()


def vocabulary(docs: DataFrame) -> Vocabulary:
    """All tokens of a least count by the corpus's size, and the FREQUENT most frequent in any case; of equal ones the first by name."""
    counts = stable(docs.select("text").mapInArrow(_count, "token string, n bigint").groupBy("token").agg(F.sum("n").alias("n")))
    total, types = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    total = total or 0
    least = max(LEAST_COUNT, round(total**0.5 / ROOT_SHARE))
    rows = counts.filter(F.col("n") >= least).collect()
    if len(rows) < FREQUENT:
        rows = counts.orderBy(F.desc("n"), "token").limit(FREQUENT).collect()
    rows.sort(key=lambda r: (-r["n"], r["token"]))
    own = np.array([r["n"] for r in rows], np.float64)
    rare = size(len(rows)) - len(rows)
    return Vocabulary([r["token"] for r in rows], np.concatenate((own, np.full(rare, (total - own.sum()) / rare))), max(1.0, (types - len(rows)) / rare))


def _encoder(frequent, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = Ids(frequent.value)
        for batch in slices(batches):
            yield append(batch, keep, ids=pa.array([packed(ids.of(t)) for t in column(batch, "text").to_pylist()], pa.binary()))

    return run


def _encoded(docs: DataFrame, frequent: list[str]) -> DataFrame:
    keep = [c for c in docs.columns if c not in ("text", "ids")]
    return docs.select(*keep, "text").mapInArrow(_encoder(docs.sparkSession.sparkContext.broadcast(frequent), keep), with_fields(docs.select(*keep).schema, "ids binary"))


def _ids(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [unpacked(x) for x in column(batch, "ids").to_pylist()]


def shards(words: Vocabulary) -> int:
    """How many, by the vocabulary and the corpus alone."""
    return int(words.counts.sum() // max(LEAST_SHARD, SHARE * len(words.counts))) + 1


def dealt(docs: DataFrame, words: Vocabulary) -> DataFrame:
    """The columns of docs but text, and ids, shard, nth; kept in the shared folder, since training and scoring both read it.

    Shards and the order in them follow from the hash of a row's id and tokens.
    Rows alike in both stand in one shard, one after the other: it is streamed,
    and no task holds it.
    """
    n = shards(words)
    rows = _encoded(docs, words.frequent)
    key = F.xxhash64("doc_id", "ids") if "doc_id" in docs.columns else F.xxhash64("ids")
    rows = rows.withColumn("nth", key).withColumn("shard", F.pmod("nth", F.lit(n)).cast("int"))
    return stable(rows.repartitionById(n, "shard").sortWithinPartitions("nth"))


_SENT = "piece int, shard int, ids binary, met binary, moved binary"


def _replica(state):
    """Rows of whole shards, each in its order -> what its replica moved: a row for each piece of the ids that it met, and one (piece -1) for places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        shard, trainer, line, met = -1, None, None, None
        for batch in slices(batches, "ids", 1 << 20):
            if trainer is None:
                shard = column(batch, "shard")[0].as_py()
                trainer, met = Trainer(state.value), np.zeros(state.value.pad + 1)
                line = np.full(_REACH, trainer.net.pad, np.int32)
            line = np.concatenate((line, lined(_ids(batch), trainer.net.pad)[_REACH:]))
            while len(line) >= STEP + 2 * _REACH:
                part = line[: STEP + 2 * _REACH]
                trainer.learn(part)
                met += np.bincount(part[_REACH:-_REACH], minlength=len(met))
                line = line[STEP:]
        if trainer is None:
            return
        own = line[_REACH:-_REACH]
        if (own != trainer.net.pad).any():
            trainer.learn(line)
            met += np.bincount(own, minlength=len(met))
        met[-1] = met[:-1].sum()  # the pad stands beside every document
        if not met[-1]:
            return
        net, was = trainer.net, state.value
        yield _sent(-1, shard, np.zeros(1), met[-1:], (net.place - was.place).reshape(1, -1))
        for piece in range(0, len(met), _EACH):
            ids = piece + np.flatnonzero(met[piece : piece + _EACH])
            if len(ids):
                yield _sent(piece // _EACH, shard, ids, met[ids], np.concatenate((net.inner[ids] - was.inner[ids], net.outer[ids] - was.outer[ids]), 1))

    return run


def _sent(piece: int, shard: int, ids: np.ndarray, met: np.ndarray, moved: np.ndarray) -> pa.RecordBatch:
    """Moves travel in half precision: they are small against the weights."""
    values = [pa.array([piece], pa.int32()), pa.array([shard], pa.int32()), *(pa.array([x.astype(k).tobytes()], pa.binary()) for x, k in ((ids, np.int32), (met, np.float64), (moved, np.float16)))]
    return pa.RecordBatch.from_arrays(values, names=["piece", "shard", "ids", "met", "moved"])


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ordered by piece and shard -> one row for each piece: the mean move by how often each id was met."""
    now, moved, met = None, np.empty((0, 0)), np.empty(0)

    def done() -> pa.RecordBatch:
        ids = np.flatnonzero(met)
        return _sent(now, 0, ids + max(now, 0) * _EACH, met[ids], moved[ids] / met[ids, None])

    for batch in batches:
        for row in batch.to_pylist():
            ids, n = np.frombuffer(row["ids"], np.int32) - max(row["piece"], 0) * _EACH, np.frombuffer(row["met"], np.float64)
            part = np.frombuffer(row["moved"], np.float16).astype(np.float64).reshape(len(n), -1)
            if row["piece"] != now:
                if now is not None:
                    yield done()
                now, moved, met = row["piece"], np.zeros((_EACH, part.shape[1])), np.zeros(_EACH)
            moved[ids] += part * n[:, None]
            met[ids] += n
    if now is not None:
        yield done()


def train(rows: DataFrame, words: Vocabulary) -> Network:
    """The network from every token of rows (shard, ids, in order). The driver gets one mean move for each weight and round."""
    n, spark = len(words.counts), rows.sparkSession
    net = Network.start(n)
    rounds = min(ROUNDS, shards(words))
    for k in range(rounds):
        state = spark.sparkContext.broadcast(net)
        sent = rows.filter(F.pmod("shard", F.lit(rounds)) == k).select("shard", "ids").mapInArrow(_replica(state), _SENT)
        means = sent.repartition(min(n // _EACH + 2, 200), "piece").sortWithinPartitions("piece", "shard").mapInArrow(_averaged, _SENT).collect()
        net = Network(*(x.copy() for x in net))
        for r in means:
            ids, moved = np.frombuffer(r["ids"], np.int32), np.frombuffer(r["moved"], np.float16).astype(np.float32)
            if r["piece"] < 0:
                net.place[...] += moved.reshape(net.place.shape)
            else:
                moved = moved.reshape(len(ids), -1)
                net.inner[ids] += moved[:, :WIDTH]
                net.outer[ids] += moved[:, WIDTH:]
    return net


def fit(docs: DataFrame) -> Model:
    """Vocabulary and network from every token of docs."""
    words = vocabulary(docs)
    return Model(words, train(dealt(docs.select(*[c for c in docs.columns if c in ("doc_id", "text")]), words), words))


def _scorer(net, unigrams, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ids", 1 << 20):
            own = _ids(batch)
            yield append(batch, keep, n_tokens=pa.array([len(x) for x in own], pa.int64()), log_likelihood=pa.array(log_likelihoods(own, net.value, unigrams.value)))

    return run


def _scores(ids: DataFrame, model: Model) -> DataFrame:
    keep = [c for c in ids.columns if c not in ("ids", "n_tokens", "log_likelihood")]
    context = ids.sparkSession.sparkContext
    run = _scorer(context.broadcast(model.net), context.broadcast(model.unigrams()), keep)
    return ids.select(*keep, "ids").mapInArrow(run, with_fields(ids.select(*keep).schema, "n_tokens bigint, log_likelihood double"))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of docs but text, n_tokens and log_likelihood (natural logarithm, 0 without tokens); columns of these names, and one named ids, are replaced. Rows stay as they are."""
    return _scores(_encoded(docs, model.vocabulary.frequent), model)


def op2_lm_scoring(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, log_likelihood, and its mean by token (null without tokens), a row for each document."""
    own = docs.select("doc_id", "text")
    words = vocabulary(own)
    rows = dealt(own, words)
    out = _scores(rows.select("doc_id", "ids"), Model(words, train(rows, words)))
    return out.select("doc_id", "n_tokens", "log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")).alias("per_token"))
