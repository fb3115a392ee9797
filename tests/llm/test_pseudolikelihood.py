from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from foldframe.llm import pseudolikelihood as lm
from foldframe.llm.common import packed, unpacked

SF = "/root/testdata/sf0.01"


def _plain(ids, model):
    """Token by token."""
    net, words = model.net, model.vocabulary
    q = np.maximum(words.counts, 0.5)
    total = 0.0
    for t, w in enumerate(ids):
        x = np.zeros(lm.WIDTH)
        for k, off in enumerate(lm.AROUND):
            c = ids[t + off] if 0 <= t + off < len(ids) else net.pad
            x += net.inner[c].astype(float) * net.place[k]
        h = np.append(np.tanh(x)[:-1], 1)
        total += float(net.outer[w].astype(float) @ h) + math.log(q[w] / q.sum()) - (math.log(words.types) if w >= len(words.frequent) else 0)
    return total


def _plain_loss(net, line):
    """Pair by pair: each place's surroundings against its token and, as noise, the others of its block."""
    n = len(line) - 4
    h = np.array([np.append(np.tanh(sum(net.inner[line[2 + t + off]].astype(float) * net.place[k] for k, off in enumerate(lm.AROUND)))[:-1], 1) for t in range(n)])
    total = 0.0
    for i in range(n):
        for j in range(i % (n // lm.BLOCK), n, n // lm.BLOCK):
            if line[2 + i] != net.pad and line[2 + j] != net.pad:
                z = float(h[i] @ net.outer[line[2 + j]]) - math.log(lm.BLOCK - 1)
                total += math.log1p(math.exp(-z)) if i == j else math.log1p(math.exp(z))
    return total


def test_gradient():
    rng = np.random.default_rng(0)
    net = lm.Network(*(x.astype(np.float64) for x in lm.Network.start(50)))
    line = lm.lined([rng.integers(0, 50, m).astype(np.int32) for m in (40, 3, 17)], net.pad)
    line = np.concatenate((line, np.full((4 - len(line)) % lm.BLOCK, net.pad, np.int32)))
    inner, places, outer = lm.Trainer(net).gradients(line)
    whole = [np.zeros_like(x) for x in net]
    np.add.at(whole[0], inner[0], inner[1])
    whole[1] += places
    np.add.at(whole[2], outer[0], outer[1])
    for part in range(3):
        for at in zip(*np.unravel_index(np.argsort(-np.abs(whole[part]), axis=None)[[0, 1, 5, 20]], whole[part].shape), strict=True):
            moved = [lm.Network(*(x.copy() for x in net)) for _ in range(2)]
            moved[0][part][at] += 1e-5
            moved[1][part][at] -= 1e-5
            g = (_plain_loss(moved[0], line) - _plain_loss(moved[1], line)) / 2e-5
            assert abs(g - whole[part][at]) < 1e-4 * max(1, abs(g))


def _plain_trained(shards, words):
    """The same training in double precision, step by step over dense arrays."""
    n = len(words.counts)
    net = lm.Network(*(x.astype(np.float64) for x in lm.Network.start(n)))
    rounds = min(lm.ROUNDS, lm.shards(words))
    for k in range(rounds):
        moves, total = [np.zeros_like(x) for x in net], np.zeros(n + 1)
        for shard in sorted(shards):
            if shard % rounds != k:
                continue
            own, squares = lm.Network(*(x.copy() for x in net)), [np.full(x.shape, 1e-10) for x in net]
            line = np.concatenate([[n, n], *[np.append(x, [n, n]) for x in shards[shard]]]).astype(np.int64)
            for at in range(0, len(line) - 4, lm.STEP):
                part = line[at : at + lm.STEP + 4]
                part = np.concatenate((part, np.full((4 - len(part)) % lm.BLOCK, n)))
                inner, places, outer = lm.Trainer(own).gradients(part)
                g = [np.zeros_like(x) for x in net]
                np.add.at(g[0], inner[0], inner[1])
                g[1] += places
                np.add.at(g[2], outer[0], outer[1])
                for w, s, d in zip(own, squares, g, strict=True):
                    s += d * d
                    w -= lm.RATE * d / np.sqrt(s)
            met = np.bincount(line[line < n], minlength=n + 1)
            met[n] = met.sum()
            total += met
            moves[0] += (own.inner - net.inner) * met[:, None]
            moves[1] += (own.place - net.place) * met[n]
            moves[2] += (own.outer - net.outer) * met[:, None]
        seen = np.maximum(total, 1)
        net.inner[...] += moves[0] / seen[:, None]
        net.place[...] += moves[1] / seen[n]
        net.outer[...] += moves[2] / seen[:, None]
    return net


def test_training_of_the_whole_table(spark, monkeypatch):
    """Scores follow a plain version, and don't follow the table's partitions."""
    monkeypatch.setattr(lm, "LEAST_SHARD", 60_000)
    monkeypatch.setattr(lm, "SHARE", 1)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    words = lm.vocabulary(docs)
    assert lm.shards(words) >= 6 and math.isclose(words.counts.sum(), sum(len(lm.tokens(r.text)) for r in docs.collect()))
    dealt = lm.dealt(docs, words)
    shards = {}
    for r in sorted(dealt.collect(), key=lambda r: (r.shard, r.nth)):
        shards.setdefault(r.shard, []).append(unpacked(r.ids))
    assert len(shards) == lm.shards(words) and max(sum(map(len, x)) for x in shards.values()) < 200_000
    got, want = lm.train(dealt, words), _plain_trained(shards, words)
    own = [x for s in shards.values() for x in s]
    a, b = (lm.log_likelihoods(own, net, lm.Model(words, net).unigrams()) for net in (got, want))
    sizes = np.maximum([len(x) for x in own], 1)
    assert np.abs((a - b) / sizes).max() < 0.02 and np.abs((a - b) / sizes).mean() < 0.002
    few, many = ({r.doc_id: r.log_likelihood for r in lm.op2_lm_scoring(docs.repartition(k)).collect()} for k in (2, 16))
    assert few.keys() == many.keys() and all(abs(few[d] - many[d]) <= 1e-6 * max(1, abs(few[d])) for d in few)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = lm.fit(docs)
    counts = Counter()
    for r in docs.collect():
        counts.update(lm.tokens(r.text))
    words = model.vocabulary
    enough = sum(n >= lm.LEAST_COUNT for n in counts.values())
    assert words.frequent == sorted(counts, key=lambda t: (-counts[t], t))[: max(lm.FREQUENT, enough)]
    rows = {r.doc_id: r for r in lm.scored(docs, model).collect()}
    ids = lm.Ids(words.frequent)
    for r in docs.limit(60).collect():
        assert rows[r.doc_id].n_tokens == len(lm.tokens(r.text))
        assert abs(rows[r.doc_id].log_likelihood - _plain(ids.of(r.text).tolist(), model)) < 1e-3 * max(1, rows[r.doc_id].n_tokens)
    # Order matters, on both sides, and training has found it.
    texts = [ids.of(r.text) for r in docs.limit(200).collect()]
    rng = random.Random(0)
    mixed = [np.array(rng.sample(x.tolist(), len(x)), np.int32) for x in texts]
    n = sum(map(len, texts))
    mean = lambda lines, net: lm.log_likelihoods(lines, net, model.unigrams()).sum() / n
    trained = mean(texts, model.net)
    assert trained > mean(texts, lm.Network.start(len(words.counts))) + 0.5
    assert trained > mean(mixed, model.net) + 0.1
    # Probabilities in one context add up to about one.
    line = lm.lined(texts, model.net.pad)
    h = model.net.hidden(model.net.inner[line])[line[2:-2] != model.net.pad][::500]
    sums = (np.exp(h @ model.net.outer[:-1].T) * words.unigram()).sum(1)
    assert abs(np.log(sums).mean()) < 0.25 and np.log(sums).std() < 0.35


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "word, " * 50_000), (None, "a b c"), (4, "one")]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id bigint, text string, n_tokens string")
    got = sorted([(r.doc_id, r.n_tokens, r.per_token is None) for r in lm.op2_lm_scoring(docs).collect()], key=str)
    assert got == sorted([(1, 0, True), (2, 0, True), (3, 0, True), (4, 1, False), (4, 1, False), (5, 100_000, False), (None, 3, False)], key=str)
    assert lm.op2_lm_scoring(docs.limit(0)).count() == 0
    assert all(r.log_likelihood == 0 for r in lm.op2_lm_scoring(docs.filter("doc_id < 4")).collect())


def test_vocabulary_grows(spark):
    def corpus(n):
        return spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i * 50, i * 50 + 50)) + f" once{i}") for i in range(n)] * lm.LEAST_COUNT, "doc_id bigint, text string")

    few, many = corpus(60), corpus(240)
    assert len(lm.vocabulary(few).frequent) == 60 * 51
    frequent, counts, _ = lm.vocabulary(many)
    assert len(frequent) == 240 * 51 > lm.FREQUENT and len(counts) == lm.size(len(frequent))
    # Every token of the least count is told apart and has a row of its own in the network.
    ids = lm.Ids(frequent)
    assert len({ids[t] for t in frequent}) == len(frequent)
    net = lm.fit(many).net
    assert len(net.outer) == len(net.inner) == len(counts) + 1


def test_rare_words_differ(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").limit(3000)
    model = lm.fit(docs)
    assert model.vocabulary.frequent == lm.vocabulary(docs).frequent and len(model.vocabulary.frequent) > 10_000
    # Tokens far down the vocabulary, in one and the same context, by what stands around them.
    lines = [np.array([5, 6, w, 7, 8], np.int32) for w in range(2000, 4000)]
    got = np.append(lm.contrasts(model.net, lm.lined(lines, model.net.pad)), [0, 0]).reshape(-1, 7)[:, 2]
    assert len(np.unique(got.round(9))) > 0.9 * len(lines) and np.isfinite(got).all()
    # A rare type has a share of its bucket.
    assert model.vocabulary.types > 1


def test_packed():
    ids = np.array([0, 1, 65_535, 65_536, (1 << 24) - 1], np.int32)
    assert (unpacked(packed(ids)) == ids).all() and len(unpacked(b"")) == 0


def test_hash_order_is_the_tables(spark):
    words = lm.Vocabulary(["a", "b"], np.array([1.0, 1.0, 1.0]), 1.0)
    docs = spark.createDataFrame([(i, "a b" * (i % 3)) for i in range(50)], "doc_id bigint, text string")
    got = lm.dealt(docs, words).withColumn("want", F.xxhash64("doc_id", "ids"))
    assert got.filter("nth <> want or shard <> 0").count() == 0
