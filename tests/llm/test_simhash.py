from __future__ import annotations

import re

import numpy as np
import xxhash

from foldframe.llm import components, simhash
from foldframe.llm.simhash import fingerprint, near_duplicates, op3_simhash_near_dedup

SF = "/root/testdata/sf0.01"


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def plain_components(ids, fps):
    """doc_id -> smallest doc_id reachable, by all pairs."""
    fps, root = np.array(fps, np.uint64), list(range(len(ids)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 3) + i + 1:
            root[find(i)] = find(int(j))
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(ids[i])
    return {d: min(g) for g in groups.values() for d in g}


def test_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = [(r.doc_id, plain_fingerprint(r.text)) for r in rows]
    comp = plain_components([d for d, _ in want], [f for _, f in want])
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in op3_simhash_near_dedup(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert got == {(d, f"{f:016x}", comp[d]) for d, f in want}


def test_links_of_a_dense_cloud(spark, monkeypatch):
    """Fingerprints near to each other, in pieces cut small: no link lost."""
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = {int(c) for c in centres}
    for c in centres:
        for _ in range(120):
            x = int(c)
            for b in rng.choice(64, rng.integers(1, 9), replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    want = plain_components(fps, fps)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    df = spark.createDataFrame(signed, "fp bigint")
    for block in (simhash.BLOCK, 16):
        monkeypatch.setattr(simhash, "BLOCK", block)
        roots = {r.node % (1 << 64): r.root for r in simhash.connected_components(simhash.links(df)).collect()}
        groups = {}
        for x in fps:
            groups.setdefault(roots.get(x, x), []).append(x)
        assert {x: min(g) for g in groups.values() for x in g} == want


def test_edges(spark):
    df = spark.createDataFrame(
        [(3, None, "x"), (2, "", "x"), (7, " \t", "x"), (4, "One", "x"), (5, "one", "x"), (5, "one", "x"), (6, "one two", "x"), (None, "one", "x")], "doc_id bigint, text string, fp string"
    )
    got = sorted(((r.doc_id, r.component_id) for r in near_duplicates(df).collect()), key=str)
    assert got == sorted([(3, 2), (2, 2), (7, 2), (4, 4), (5, 4), (5, 4), (6, 6), (None, 4)], key=str)
    assert fingerprint("a b c") == plain_fingerprint("A B  c")
    assert near_duplicates(df.limit(0)).count() == 0
    long = "word " * 50_000 + "end"
    assert fingerprint(long) == plain_fingerprint(long)


def test_components_without_broadcasts_and_in_one_task(spark, monkeypatch):
    rng = np.random.default_rng(3)
    ends = [(int(a) - 500, int(b) - 500) for a, b in rng.integers(0, 1200, (700, 2))] + [(i, i + 1) for i in range(2000, 2300)] + [(9, 9), (None, 4)]
    edges, least = spark.createDataFrame(ends, "src bigint, dst bigint"), {}
    for _ in range(400):
        for a, b in ends:
            if None not in (a, b) and a != b:
                least[a] = least[b] = min(least.get(a, a), least.get(b, b))
    for most in (components.ONE_TASK, 0):
        monkeypatch.setattr(components, "ONE_TASK", most)
        before = spark.sparkContext._jsc.sc().dagScheduler().nextJobId()
        assert {r.node: r.root for r in components.connected_components(edges).collect()} == least
        jobs = spark.sparkContext._jsc.sc().dagScheduler().nextJobId() - before
        assert jobs <= 12 or not most
    docs = spark.createDataFrame([(i, f"some words of {i % 40}") for i in range(100)], "doc_id bigint, text string")
    found = near_duplicates(docs)
    found.collect()
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
