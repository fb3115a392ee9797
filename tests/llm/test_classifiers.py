from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import functions as F

from foldframe.llm import quality, toxicity

SF = "/root/testdata/sf0.1"


def test_quality_against_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.op6_quality_classifier(docs).join(labels, "doc_id").select("quality", "keep").collect()
    good = [r.keep for r in rows if r.quality]
    bad = [r.keep for r in rows if not r.quality]
    assert sum(good) / len(good) > 0.995 and sum(bad) / len(bad) < 0.05


def test_expectation_maximisation_finds_accuracies():
    rng = np.random.default_rng(3)
    truth = rng.random(20_000) < 0.8
    right = np.array([0.95, 0.85, 0.7, 0.9, 0.6])
    cast = rng.random((20_000, 5)) < 0.8
    votes = np.where(cast, np.where(rng.random((20_000, 5)) < right, truth[:, None], ~truth[:, None]), 2).astype(int)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    found = quality.estimate(patterns, counts.astype(float))
    assert abs(found.prior - 0.8) < 0.03
    assert np.abs(found.votes[:, quality.GOOD, quality.GOOD] - right).max() < 0.04


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.op7_toxicity(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    s, y = np.array([r.score for r in held]), np.array([r.toxic for r in held])
    rank = np.argsort(np.argsort(s, kind="stable"))
    assert (rank[y == 1].mean() - (y.sum() - 1) / 2) / (len(y) - y.sum()) > 0.97
    clean = [r.predicted for r in held if not r.toxic]
    assert sum(clean) / len(clean) < 0.02
    assert sum(r.predicted for r in held if r.toxic) / y.sum() > 0.85
    assert all(r.predicted == (r.score >= 0.3) for r in rows)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "!!! ??"), (4, "word " * 60_000), (None, "a b"), (5, "a"), (5, "a")]
    docs = spark.createDataFrame([(*r, "k", 1.0) for r in rows], "doc_id bigint, text string, toxicity string, quality_score double")
    labels = spark.createDataFrame([(1, 1), (2, None), (3, 0), (None, 1), (4, 0), (4, 1), (9, 1)], "doc_id bigint, toxic int")
    assert toxicity.op7_toxicity(docs, labels).count() == len(rows)
    assert toxicity.op7_toxicity(docs, labels.limit(0)).agg(F.max("score"), F.min("score")).first()[:] == (0.5, 0.5)
    assert toxicity.op7_toxicity(docs.limit(0), labels).count() == 0
    assert toxicity.accepted(docs, labels).columns == docs.columns
    assert quality.op6_quality_classifier(docs).count() == len(rows)
    assert quality.op6_quality_classifier(docs.limit(0)).count() == 0
    assert quality.kept(docs).columns == docs.columns


def test_scores_do_not_follow_partitions(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    for query in (lambda d: toxicity.op7_toxicity(d, labels), quality.op6_quality_classifier):
        few, many = ({r.doc_id: r.score for r in query(docs.repartition(n)).collect()} for n in (2, 9))
        assert few == many and len(few) == docs.count() and len(set(few.values())) > 100


def test_edge_scores(spark):
    """Null and empty texts score alike, as do repeated rows; a word learned as toxic is scored above one learned as clean."""
    rows = [(i, "vile words here" if i % 2 else "kind words here") for i in range(400)] + [(1000, None), (1001, ""), (1002, "vile words here"), (1002, "vile words here"), (1003, "kind words here"), (None, "vile")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id bigint, toxic int")
    got = [(r.doc_id, r.score) for r in toxicity.op7_toxicity(docs, labels).collect() if r.doc_id is None or r.doc_id >= 1000]
    by = dict(got)
    assert len(got) == 6 and by[1000] == by[1001] and len({s for d, s in got if d == 1002}) == 1
    assert by[1002] > 0.7 > 0.3 > by[1003] and all(0 <= s <= 1 for _, s in got)
    scores = {r.doc_id: r.score for r in quality.op6_quality_classifier(docs).collect()}
    assert scores[1000] == scores[1001] and all(0 <= s <= 1 for s in scores.values())
