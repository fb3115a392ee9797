from __future__ import annotations

import zlib
from collections import defaultdict

import pytest

from foldframe.llm.sharding import SlotMap, op10_sharding, placed, slotted, totals, write_shards

SF = "/root/testdata/sf0.01"


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = op10_sharding(docs).collect()
    texts = {r.doc_id: r.text.encode() for r in docs.collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    held, places = defaultdict(int), defaultdict(list)
    for r in rows:
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(texts[r.doc_id]) + 1, zlib.crc32(texts[r.doc_id]), "bytes", None)
        held[r.shard] += r["size"]
        places[r.shard].append(r.slot)
    assert sorted(held) == list(range(8))
    assert max(held.values()) - min(held.values()) <= 0.02 * sum(held.values()) / 8
    assert all(sorted(x) == list(range(len(x))) for x in places.values())


def test_edits_of_the_map(spark, tmp_path):
    sizes = [(i * 7919) % 1000 + 1 for i in range(4096)]
    first = SlotMap.balanced(sizes, 8)
    assert max(first.loads(sizes)) - min(first.loads(sizes)) <= max(sizes)
    # Balanced sizes need no edit but a version; a shard more takes slots only into itself.
    assert first.rebalanced(sizes).shard == first.shard
    grown = first.rebalanced(sizes, 9)
    assert grown.version == 2 and max(grown.loads(sizes)) - min(grown.loads(sizes)) <= 0.02 * sum(sizes) / 9
    assert {b for a, b in zip(first.shard, grown.shard, strict=True) if a != b} == {8}
    drifted = [s * 5 if to == 3 else s for s, to in zip(sizes, first.shard, strict=True)]
    again = first.rebalanced(drifted)
    assert max(again.loads(drifted)) - min(again.loads(drifted)) <= 0.02 * sum(drifted) / 8
    assert all(a == 3 for a, b in zip(first.shard, again.shard, strict=True) if a != b)
    with pytest.raises(ValueError):
        grown.rebalanced(sizes, 8)
    path = str(tmp_path / "map")
    first.save(spark, path)
    grown.save(spark, path)
    assert SlotMap.load(spark, path) == grown and SlotMap.load(spark, path, 1) == first


def test_edges(spark, tmp_path):
    rows = [(1, "ä"), (1, "ä"), (2, None), (3, ""), (None, "a"), (None, "b"), (None, None), (4, "x" * 100_000)]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id bigint, text string, shard string")
    out = op10_sharding(docs).collect()
    assert sorted((r.doc_id, r["size"]) for r in out if r.doc_id) == [(1, 3), (1, 3), (2, 1), (3, 1), (4, 100_001)]
    assert len(out) == len(rows)
    assert op10_sharding(docs.limit(0)).count() == 0
    plan = SlotMap.balanced(totals(slotted(docs))[0], 3)
    write_shards(docs, plan, str(tmp_path / "out"))
    back = {(r.doc_id, r.text): r.shard for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.doc_id, r.text_crc32): r.shard for r in placed(slotted(docs), plan, totals(slotted(docs))[1]).collect()}
    assert {(d, zlib.crc32((t or "").encode())): s for (d, t), s in back.items()} == want


def _balanced(sizes, shards):
    """By falling size, each slot to the lightest shard, found by looking at all."""
    held, out = [0] * shards, {}
    for slot in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        to = min(range(shards), key=lambda s: (held[s], s))
        out[slot] = to
        held[to] += sizes[slot]
    return out


def test_whole_table_by_a_plain_version(spark):
    """Shard and slot of every row, from each row's virtual slot alone; that is the hash of id and text."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = op10_sharding(docs).collect()
    hashed = {r.doc_id: r.h % 4096 for r in docs.selectExpr("doc_id", "xxhash64(doc_id, text) AS h").collect()}
    assert all(r.vslot == hashed[r.doc_id] for r in rows)
    sizes = [0] * 4096
    for r in rows:
        sizes[r.vslot] += r["size"]
    to = _balanced(sizes, 8)
    places = {}
    for shard in range(8):
        own = sorted((r.vslot, r.doc_id, r.text_crc32, r["size"]) for r in rows if to[r.vslot] == shard)
        places |= {x[1]: (shard, i) for i, x in enumerate(own)}
    assert {r.doc_id: (r.shard, r.slot) for r in rows} == places


def test_hot_groups_are_spread(spark):
    """One id, and one text, with a third of all rows each."""
    rows = [(7, f"text {i}") for i in range(3000)] + [(i + 10_000, "the same text") for i in range(3000)] + [(i + 20_000, f"own {i}") for i in range(3000)]
    held = defaultdict(int)
    for r in op10_sharding(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        held[r.shard] += r["size"]
    assert max(held.values()) - min(held.values()) <= 0.02 * sum(held.values()) / 8
