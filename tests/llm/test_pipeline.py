from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from foldframe.llm import quality, toxicity
from foldframe.llm.decontaminate import WINDOW, words
from tests.llm.test_simhash import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.01"


def _not_toxic(spark, rows):
    """A learner fed row by row on the driver."""
    labels = spark.read.parquet(f"{SF}/labels.parquet").filter(~toxicity.held_out(F.col("doc_id"))).select("doc_id", "toxic", F.xxhash64("doc_id").alias("h"))
    texts = dict(rows)
    learner = toxicity.Learner()
    order = [(r.doc_id, r.toxic) for r in sorted(labels.collect(), key=lambda r: r.h) if r.doc_id in texts]
    for _ in range(toxicity.EPOCHS):
        for d, y in order:
            learner.learn(np.unique(toxicity.buckets(texts[d])), y)
    model = learner.model()
    return [(d, t) for d, t in rows if toxicity.score(t, model.dense(), np.float64(model.bias)) < toxicity.REJECT_AT]


def _good(spark, rows):
    """Vote patterns counted and the scorer trained on the driver, over texts that each stand once."""
    votes = np.array([quality.votes(t) for _, t in rows])
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    labels = quality.estimate(patterns, counts.astype(float))
    hashed = spark.createDataFrame(sorted({t for _, t in rows} and [(t,) for t in {t for _, t in rows}]), "text string").select("text", F.xxhash64(F.lit(7), "text").alias("h")).collect()
    own = [r.text for r in sorted(hashed, key=lambda r: r.h)][: quality.SAMPLE]
    goods = labels.posterior(np.array([quality.votes(t) for t in own]))
    w = quality.train([(at, x.astype(np.float32), float(y)) for (at, x), y in zip(map(quality.features, own), goods, strict=True)])
    return [(d, t) for d, t in rows if quality.score(t, w.astype(np.float32).astype(float)) >= quality.KEEP_AT]


def _one_of_each(spark, rows):
    component = plain_components([d for d, _ in rows], [plain_fingerprint(t) for _, t in rows])
    return [(d, t) for d, t in rows if component[d] == d]


def _clean(spark, rows):
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        own = words(r.text)
        windows |= {tuple(own[i : i + WINDOW]) for i in range(max(len(own) - WINDOW, 0) + 1)} if own else set()
    sizes = {len(w) for w in windows}
    return [(d, t) for d, t in rows if not any(tuple(words(t)[i : i + n]) in windows for n in sizes for i in range(len(words(t)) - n + 1))]


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    assert len(corpus_pipeline.STAGES) == 5
    for (name, stage), plain in zip(corpus_pipeline.STAGES, (_not_toxic, _good, _one_of_each, _clean), strict=False):
        want = plain(spark, rows)
        out = stage(spark, docs.filter(F.col("doc_id").isin([d for d, _ in rows])), SF)
        assert out.columns == docs.columns
        got = sorted((r.doc_id, r.text) for r in out.collect())
        # Sums in another order may move a score by its last digits.
        assert len({d for d, _ in got} ^ {d for d, _ in want}) <= (2 if plain in (_not_toxic, _good) else 0), name
        assert 0 < len(got) < len(rows)
        rows = got
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = dict(rows)
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        data = texts[r.doc_id].encode()
        ids = model.encode(texts[r.doc_id], add_eos=True)
        assert list(r.ids) == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(model.decode(ids).encode()).hexdigest()
        # Spans give the text back, piece by piece.
        assert b"".join(data[a:b] for a, b in zip(r.starts, r.starts[1:], strict=False)) == data


def test_edges_through_all_stages(spark, tmp_path):
    """Null and repeated ids, null, empty and repeated texts, and an empty table, through run()."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()}
    one = docs.filter(F.col("doc_id") == min(known)).first()
    kind = "doc_id bigint, text string"
    other = " ".join(f"{a} {b}" for a, b in zip(one.text.split()[::2], one.text.split()[1::2][::-1], strict=False))
    extra = spark.createDataFrame([(None, None), (900_001, None), (900_002, ""), (900_003, " \n"), (one.doc_id, one.text), (None, other)], kind)
    rows = docs.unionByName(extra.withColumns({c: F.lit(None).cast(t) for c, t in docs.dtypes if c not in extra.columns}).select(docs.columns))
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    rows.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    for name in ("labels", "benchmark"):
        for folder in (tmp_path, tmp_path / "none"):
            spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(str(folder / f"{name}.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    ids = [r.doc_id for r in out.collect()]
    assert len([d for d in ids if d is not None]) == len({d for d in ids if d is not None})
    assert not {900_001, 900_002, 900_003} & set(ids) and ids.count(None) <= 1
    assert len(known - set(ids)) <= 2
    assert out.columns == corpus_pipeline.run(spark, SF).columns
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
