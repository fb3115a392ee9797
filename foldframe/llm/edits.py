"""Document fingerprints by randomised edit embedding.

A walk shared by all texts reads a text from its first character to its last: at
each step a random bit, a function of the step and the character read, says
whether to go on to the next character. The characters seen at the steps are the
embedding; after an edit two walks fall into step again, so that few edits leave
most steps alike, and edit distance shows as Hamming distance. A fingerprint
holds the embedding at sampled steps, the same for all texts: up to SAMPLES in
each octave of steps, so that texts of any length are sampled over their whole.
Bands of sampled steps give candidates; likeness of the fingerprints verifies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldframe.llm.common import append, column, slices, with_fields

SAMPLES = 64
OCTAVES = 44
PERIOD = 4096
#: Bands of a fingerprint, and the sampled steps in each; both in its last full octave and in the one before.
BANDS, BAND_STEPS = 16, 4
#: Text of a piece of the ordered documents at most (but for rows of one id), and the least that makes a further piece worth while to give every core one. A piece is streamed by one task and never held; the driver has a cut and a highest id for each.
PIECE_BYTES, LEAST_PIECE_BYTES = 256 << 20, 4 << 20

#: Symbols of fingerprints; a character is one of 256 classes, of which four share a symbol.
ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: the walk's source of random bits."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _dwells() -> list[bytes]:
    """For each class of character and step (modulo PERIOD) of arrival: steps until the walk goes on, 1 at least."""
    at = np.arange(256 * PERIOD, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    go = (_mixed(at) >> np.uint64(63)).astype(bool).reshape(256, PERIOD)
    go[:, -1] = True
    out = np.ones((256, PERIOD), np.uint8)
    for step in range(PERIOD - 2, -1, -1):
        out[:, step] = np.where(go[:, step], 1, np.minimum(out[:, step + 1], 254) + 1)
    return [row.tobytes() for row in out]


def _samples() -> tuple[list[int], np.ndarray]:
    """The sampled steps in order, and how many steps each stands for."""
    steps, weights = [0, 1], [1.0, 1.0]
    for octave in range(1, OCTAVES):
        first = size = 1 << octave
        # One step in each of SAMPLES equal parts.
        n = min(size, SAMPLES)
        part = size // n
        within = _mixed(np.arange(n, dtype=np.uint64) + np.uint64(octave << 32)) % np.uint64(part)
        steps += (first + np.arange(n) * part + within.astype(np.int64)).tolist()
        weights += [float(part)] * n
    return steps, np.array(weights)


_DWELL = _dwells()
_STEPS, _WEIGHTS = _samples()
_SYMBOL = bytes(ALPHABET[c & 63] for c in range(256))


def classes(text: str) -> bytes:
    """The class of each code point."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
    return (_mixed(points * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.uint8).tobytes()


def walk(data: bytes, step: int, seen: bytearray) -> int:
    """Reads data from the given step on; adds what stands at sampled steps to seen; returns the step after the last character."""
    dwell, symbol, steps, mask = _DWELL, _SYMBOL, _STEPS, PERIOD - 1
    at = len(seen)
    due = steps[at]
    for c in data:
        step += dwell[c][step & mask]
        if due < step:
            s = symbol[c]
            while due < step:
                seen.append(s)
                at += 1
                due = steps[at]
    return step


def fingerprint(text: str | None) -> str:
    """Empty for a null or empty text."""
    seen = bytearray()
    walk(classes(text or ""), 0, seen)
    return seen.decode()


def likeness(a: str, b: str) -> float:
    """Share of steps alike, by the samples, of the steps of the longer walk: 1 for equal fingerprints, empty ones too."""
    if a == b:
        return 1.0
    n = min(len(a), len(b))
    x, y = np.frombuffer(a.encode(), np.uint8), np.frombuffer(b.encode(), np.uint8)
    return float(_WEIGHTS[:n][x[:n] == y[:n]].sum() / _WEIGHTS[: max(len(a), len(b))].sum())


def bands(fp: str) -> list[int]:
    """Hashes of the bands of a fingerprint: of its last two full octaves, or of its first samples.

    Below the first octave of which only a part is taken, bands are drawn from
    the longest beginnings of 2^k samples, two of them, so that fingerprints
    near in length have one in common across every boundary. Fewer than four
    samples, of which none may differ in a near pair, are a single band.
    """
    first = 2 * SAMPLES  # samples below the first octave of which only a part is taken
    octaves = max((len(fp) - first) // SAMPLES, 0)
    # Each part: a number for its draws, and where it lies.
    parts = [(octave, first + octave * SAMPLES, SAMPLES) for octave in range(max(octaves - 2, 0), octaves)]
    if octaves < 2:
        longest = min(len(fp), first).bit_length() - 1
        parts += [(OCTAVES + k, 0, 1 << k) for k in range(longest, max(longest - 2 + octaves, 1), -1)]
    if not parts:
        return [xxhash.xxh64_intdigest(fp) >> 1]
    out = []
    for number, start, size in parts:
        own = fp[start : start + size]
        # Steps drawn for each band from all of the part.
        drawn = _mixed(np.arange(BANDS * BAND_STEPS, dtype=np.uint64) + np.uint64(number << 40)) % np.uint64(size)
        for band in range(BANDS):
            key = "".join(own[i] for i in drawn[band * BAND_STEPS : (band + 1) * BAND_STEPS].tolist())
            out.append(xxhash.xxh64_intdigest(f"{number} {band} {key}") >> 1)
    return out


def _fingerprints(keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield append(batch, keep, fingerprint=pa.array([fingerprint(t) for t in column(batch, "text").to_pylist()], pa.string()))

    return run


def fingerprints(docs: DataFrame) -> DataFrame:
    """The columns of docs and fingerprint; a column of that name is replaced. Rows stay as they are."""
    keep = [c for c in docs.columns if c != "fingerprint"]
    return docs.select(*keep).mapInArrow(_fingerprints(keep), with_fields(docs.select(*keep).schema, "fingerprint string"))


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "fingerprint"):
        yield append(batch, ["fingerprint"], band=pa.array([bands(x) for x in column(batch, "fingerprint").to_pylist()], pa.list_(pa.int64())))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "found"):
        both = zip(column(batch, "query").to_pylist(), column(batch, "found").to_pylist(), strict=True)
        yield append(batch, ["query", "found"], likeness=pa.array([likeness(a, b) for a, b in both], pa.float64()))


def search(queries: DataFrame, fps: DataFrame, least: float = 0.8) -> DataFrame:
    """Distinct fingerprints of queries against all of fps (both with a column fingerprint): query, found, likeness of at least `least`.

    Candidates share a band. Rows that have a fingerprint are found by a join on
    it; equal fingerprints are one row here, however many texts have them. An
    empty fingerprint is like empty ones alone; null fingerprints are left out;
    no rows on a side give none. Short texts are found like long ones: every
    length of fingerprint has bands of its own. A crowded band is split by the
    skew handling of the join, and a pair is verified where it is met, so that
    only near pairs travel on.
    """
    sides = [df.select("fingerprint").filter("fingerprint is not null").distinct().mapInArrow(_banded, "fingerprint string, band array<bigint>").select("fingerprint", F.explode("band").alias("band")) for df in (queries, fps)]
    pairs = sides[0].withColumnRenamed("fingerprint", "query").join(sides[1].withColumnRenamed("fingerprint", "found"), "band").select("query", "found")
    return pairs.mapInArrow(_verified, "query string, found string, likeness double").filter(F.col("likeness") >= least).distinct()


def _piece(key: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts are at most key, by bisection."""
    if not cuts:
        return F.lit(0)
    held = F.lit(cuts)
    powers = F.array(*[F.lit(1 << k) for k in range(len(cuts).bit_length() - 1, -1, -1)])
    return F.aggregate(powers, F.lit(0), lambda n, p: F.when(F.get(held, n + p - 1).cast("long") <= key, n + p).otherwise(n))


def _ordered(docs: DataFrame) -> DataFrame:
    """doc_id, text, last by falling doc_id within pieces; after a piece's rows the first row of the next piece stands with last true.

    A null doc_id comes after all others; equal ids are ordered by text. One
    shuffle of the texts; the driver holds a cut and a highest id for each piece.
    """
    rows = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("key"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(size // PIECE_BYTES), min(docs.sparkSession.sparkContext.defaultParallelism * 4, int(size // LEAST_PIECE_BYTES))) + 1
    cuts = rows.agg(F.percentile_approx("key", [i / n for i in range(1, n)], max(10_000, 20 * n))).first()[0] if n > 1 else None
    cuts = sorted(set(cuts or []))
    rows = rows.withColumn("piece", _piece(F.col("key"), cuts))
    tops = sorted((r["piece"], r["key"]) for r in rows.groupBy("piece").agg(F.max("key").alias("key")).collect())
    after = [(key, tops[(i + 1) % len(tops)][0]) for i, (_, key) in enumerate(tops)]
    small = docs.sparkSession.createDataFrame(after, "key long, before int")
    rows = rows.join(F.broadcast(small), "key", "left")
    own = F.struct(F.col("piece"), F.lit(False).alias("last"))
    lent = F.struct(F.col("before").alias("piece"), F.lit(True).alias("last"))
    rows = rows.select("doc_id", "text", "key", F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, lent))).alias("p"))
    rows = rows.select("doc_id", "text", "key", "p.piece", "p.last")
    # A partition for each piece, by its number: no two pieces meet in one task.
    return rows.repartitionById(len(cuts) + 1, "piece").sortWithinPartitions("piece", "last", F.desc("key"), "text").select("doc_id", "text", "piece", "last")


class _Text:
    """A text with its walk, and with where the walk stood before its last third."""

    def __init__(self, text: str | None) -> None:
        self.text = text or ""
        self.tail = len(self.text) // 3
        self.data = classes(self.text)
        head = len(self.data) - self.tail
        seen = bytearray()
        step = walk(self.data[:head], 0, seen)
        self.at, self.head = step, bytes(seen)
        walk(self.data[head:], step, seen)
        self.fingerprint = seen.decode()

    def edited(self, other: _Text) -> tuple[str, str]:
        """The text whose last third gave way to as much of the other's beginning, and its fingerprint."""
        seen = bytearray(self.head)
        walk(other.data[: self.tail], self.at, seen)
        return self.text[: len(self.text) - self.tail] + other.text[: self.tail], seen.decode()


def _against_next(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "candidate_edited", "candidate_next")
    kinds: list[pa.DataType] = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.bool_(), pa.bool_()]
    held: tuple | None = None
    for batch in slices(batches, most_rows=1024):
        out = []
        for doc_id, text, piece, last in zip(*(column(batch, k).to_pylist() for k in ("doc_id", "text", "piece", "last")), strict=True):
            if last and held is None:
                continue  # a further row of the id that was lent
            now = _Text(text)
            if held is not None and held[1] == piece:
                was: _Text = held[2]
                text2, fp2 = was.edited(now)
                own = set(bands(was.fingerprint))
                out.append(
                    (
                        held[0], len(was.text), hashlib.sha256(text2.encode()).hexdigest(), was.fingerprint, fp2,
                        likeness(was.fingerprint, fp2), likeness(was.fingerprint, now.fingerprint),
                        not own.isdisjoint(bands(fp2)), not own.isdisjoint(bands(now.fingerprint)),
                    )
                )
            held = None if last else (doc_id, piece, now)
        columns = list(zip(*out, strict=True)) if out else [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=list(names))


def op1_edit_fingerprints(docs: DataFrame) -> DataFrame:
    """Each text's fingerprint, that of its edited text, and their likeness; the same against the next text by falling doc_id.

    Null texts count as empty. Repeated ids follow each other in the order of
    their texts. A table of one row is its own next. candidate_*: the two share a band.
    """
    return _ordered(docs).mapInArrow(
        _against_next,
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, candidate_edited boolean, candidate_next boolean",
    )
