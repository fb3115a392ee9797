"""SimHash near-duplicates by anchor-point covering.

A 64-bit fingerprint is taken as two halves of 32 bits. Two fingerprints that
differ in at most 3 bits differ in at most 1 bit in one of the halves. The first
31 bits of each half are covered by the [31, 26] Hamming code, whose 2^26 code
words are the anchors: the code is perfect, so that every half lies within the
covering radius 1 of exactly one anchor, its home. Every fingerprint is copied
to all anchors within covering radius plus threshold, 1 + 1 = 2 bits (at most
16 for each half); at an anchor those at home are compared, over all 64 bits,
with all that were copied there. A pair within 1 bit in a half meets at the home
of either side, so no link is lost.

Comparison happens over distinct fingerprints only. A crowded anchor is cut
into blocks of at most BLOCK fingerprints, and each pair of blocks is one piece
of work; a piece gives links that span what it found connected, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldframe.llm.common import append, column, shared_dir, slices, stable
from foldframe.llm.components import connected_components

SHINGLE = 3
THRESHOLD = 3
SEED = 42
BLOCK = 4096

_CODE_BITS = 31
#: Parity masks of the Hamming code: bit i of a half stands at position i + 1.
_PARITY = [sum(1 << i for i in range(_CODE_BITS) if (i + 1) >> k & 1) for k in range(5)]


def _shifts(syndrome: int) -> list[int]:
    """Differences of a half from each anchor within 2 bits; the first leads to its home."""
    if not syndrome:
        return [0]
    pairs = [(i, i ^ syndrome) for i in range(1, _CODE_BITS + 1) if i < i ^ syndrome]
    return [1 << syndrome - 1] + [1 << i - 1 | 1 << j - 1 for i, j in pairs]


def fingerprint(text: str | None) -> int:
    """The unsigned fingerprint of one text; 0 for null or for a text without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - SHINGLE + 1].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounds the unpacked bits of a very long text
        part = np.array(hashes[at : at + (1 << 16)], np.uint64)
        counts += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        fps = np.fromiter(map(fingerprint, column(batch, "text").to_pylist()), np.uint64, batch.num_rows)
        yield append(batch, ["doc_id"], fp=pa.array(fps.view(np.int64)))


def simhash(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, fp): the fingerprint as a signed long. A null text counts as empty; rows stay as they are, repeated ones too."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_fingerprints, f"doc_id {kind}, fp bigint")


def _half(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, 32 * k).bitwiseAND(F.lit(0xFFFFFFFF))


def anchors(fps: DataFrame) -> DataFrame:
    """Distinct fp -> (half, anchor, fp, home): a row for each anchor to which fp is copied."""
    table = F.array(*[F.array(*[F.lit(x).cast("long") for x in _shifts(s)]) for s in range(32)])
    parts = []
    for k in range(2):
        code = _half(F.col("fp"), k).bitwiseAND(F.lit((1 << _CODE_BITS) - 1))
        syndrome = sum(((F.bit_count(code.bitwiseAND(F.lit(m))) % 2) * (1 << i) for i, m in enumerate(_PARITY)), F.lit(0))
        parts.append(F.struct(F.lit(k).alias("half"), code.alias("code"), F.element_at(table, (syndrome + 1).cast("int")).alias("shifts")))
    out = fps.select("fp", F.explode(F.array(*parts)).alias("p"))
    out = out.select("fp", "p.half", "p.code", F.posexplode("p.shifts").alias("nth", "shift"))
    return out.select("half", F.col("code").bitwiseXOR(F.col("shift")).alias("anchor"), "fp", (F.col("nth") == 0).alias("home"))


def _span(home: np.ndarray, other: np.ndarray) -> list[tuple[int, int]]:
    """Links that span the components of {home x other within THRESHOLD}; at most one per fingerprint."""
    links, left_h, left_o = [], home, other
    while len(left_h):
        queue, left_h = [(left_h[0], True)], left_h[1:]
        while queue:
            at, is_home = queue.pop()
            if is_home and len(left_o):
                near = np.bitwise_count(left_o ^ at) <= THRESHOLD
                found, left_o = left_o[near], left_o[~near]
                queue += [(x, False) for x in found]
                links += [(int(at), int(x)) for x in found if x != at]
            elif not is_home and len(left_h):
                near = np.bitwise_count(left_h ^ at) <= THRESHOLD
                found, left_h = left_h[near], left_h[~near]
                queue += [(x, True) for x in found]
                links += [(int(at), int(x)) for x in found if x != at]
    return links


def _work(key: np.ndarray, fp: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of whole pieces of work; key numbers the pieces, whose rows stand together."""
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(key)])))
    src, dst = [], []
    small = sizes <= 12
    in_small = np.repeat(small, sizes)
    k, f, h = key[in_small], fp[in_small], home[in_small]
    for shift in range(1, int(sizes[small].max(initial=0))):
        a, b = f[:-shift], f[shift:]
        near = (k[:-shift] == k[shift:]) & (h[:-shift] != h[shift:]) & (a != b)
        near[near] = np.bitwise_count(a[near] ^ b[near]) <= THRESHOLD
        src.append(a[near])
        dst.append(b[near])
    for at, n in zip(starts[~small].tolist(), sizes[~small].tolist(), strict=True):
        piece, is_home = fp[at : at + n], home[at : at + n]
        links = np.array(_span(piece[is_home], piece[~is_home]), np.uint64).reshape(-1, 2)
        src.append(links[:, 0])
        dst.append(links[:, 1])
    none = np.empty(0, np.uint64)
    return np.concatenate([none, *src]), np.concatenate([none, *dst])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by piece of work -> links. A piece is held until its last row is read: at most 2 * BLOCK rows on average."""
    held: list[pa.RecordBatch] = []

    def links(rows: pa.Table) -> pa.RecordBatch:
        key = rows["piece"].to_numpy()
        src, dst = _work(key, rows["fp"].to_numpy().view(np.uint64), rows["home"].to_numpy())
        return pa.RecordBatch.from_arrays([pa.array(src.view(np.int64)), pa.array(dst.view(np.int64))], names=["src", "dst"])

    for batch in batches:
        if not batch.num_rows:
            continue
        piece = column(batch, "piece").to_numpy()
        earlier = np.flatnonzero(piece != piece[-1])
        last = int(earlier[-1]) + 1 if len(earlier) else 0
        if last or (held and column(held[-1], "piece")[-1].as_py() != piece[0]):
            yield links(pa.Table.from_batches([*held, batch.slice(0, last)]))
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield links(pa.Table.from_batches(held))


def links(fps: DataFrame) -> DataFrame:
    """Distinct fp -> (src, dst): links within THRESHOLD bits that join all that all such links join."""
    copied = anchors(fps)
    # Counted by partial sums and joined back, so that a crowded anchor's rows never stand in one task.
    crowds = copied.groupBy("half", "anchor").agg(F.count(F.lit(1)).alias("n"), F.count_if("home").alias("homes")).filter("n > 1 and homes > 0")
    met = copied.join(crowds.drop("homes").hint("merge"), ["half", "anchor"])
    met = met.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("fp"), "blocks").cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    as_home = F.transform(every, lambda j: F.struct(F.col("own").alias("i"), j.alias("j"), F.lit(True).alias("home")))
    as_other = F.transform(every, lambda i: F.struct(i.alias("i"), F.col("own").alias("j"), F.lit(False).alias("home")))
    roles = F.when(F.col("home"), F.concat(as_home, as_other)).otherwise(as_other)
    pieces = met.select("half", "anchor", "fp", F.explode(roles).alias("r"))
    # The number of a piece: anchors have 31 bits, so that it is exact for up to 65,536 blocks.
    piece = F.shiftleft(F.col("anchor"), 33).bitwiseXOR(F.shiftleft(F.col("r.i").cast("long"), 17)).bitwiseXOR(F.shiftleft(F.col("r.j").cast("long"), 1)).bitwiseXOR(F.col("half").cast("long"))
    pieces = pieces.select(piece.alias("piece"), "fp", F.col("r.home").alias("home"))
    return pieces.repartition("piece").sortWithinPartitions("piece").mapInArrow(_compare, "src bigint, dst bigint").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, fp, component_id), a row for each row.

    component_id: the smallest doc_id that chains of fingerprints within
    THRESHOLD bits reach, itself included. Texts without words have fingerprint
    0 and are linked like any other. A row with a null doc_id takes part and
    gets its component's id, null if the component has no other; repeated rows
    give repeated rows; an empty table gives none. Further columns are ignored.
    """
    shared_dir(docs.sparkSession)
    fps = stable(simhash(docs))
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = connected_components(links(nodes.select("fp"))).withColumnRenamed("node", "fp")
    # Merged, not broadcast: the driver would hold each table that it sends, and these grow with the documents.
    rooted = nodes.join(roots.hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return fps.join(rooted.join(ids.hint("merge"), "root").select("fp", "component_id").hint("merge"), "fp").select("doc_id", "fp", "component_id")


def op3_simhash_near_dedup(docs: DataFrame) -> DataFrame:
    """The digest of near_duplicates: fingerprint as 16 lowercase hex digits."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
