"""Benchmark decontamination with one Aho-Corasick automaton.

Texts become words joined by single spaces; a pattern is a window of
consecutive benchmark words with a space on either side, so that it matches
whole words only. One scan of a text finds all windows; the hits are mapped to
word numbers and, on request, to character offsets of the original text.

An automaton has about ten nodes for each byte of the benchmark. A benchmark
beyond AUTOMATON_BYTES is held as a Bloom filter of window hashes instead, a file
in the shared folder: one scan of a text finds the windows that may be of the
benchmark, and a join on hash and words keeps those that are. Both give the same
rows; neither brings a benchmark without a bound to the driver.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import dataset, fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldframe.llm.common import append, column, shared_dir, slices, stable, with_fields

WINDOW = 10
#: Bytes of a benchmark's text up to which it's one automaton: each stands in ten windows at most, and so in ten nodes of the trie.
AUTOMATON_BYTES = 240_000
#: Bits of the filter for each window, of which PROBES are set, and the most bits of all; beyond those more candidates reach the join.
BITS_EACH, PROBES, MOST_BITS = 16, 4, 1 << 31
_PAGE_BITS = 1 << 15

#: A-Z to a-z; every byte that isn't part of a word to a space. All bytes above 0x7F belong to words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
_built: dict[int, tuple] = {}


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def automaton(items: list[tuple[str, str | None]], window: int) -> ahocorasick.Automaton | None:
    """Of (item id, text); each pattern's value is its number of words and the numbers of its items. None without any pattern."""
    patterns: dict[bytes, tuple[int, set[int]]] = {}
    for number, (_, text) in enumerate(items):
        own = words(text)
        for i in range(max(len(own) - window, 0) + 1 if own else 0):
            patterns.setdefault(b" ".join(own[i : i + window]), (min(window, len(own)), set()))[1].add(number)
    if not patterns:
        return None
    built = ahocorasick.Automaton()
    for pattern, (n, found) in patterns.items():
        built.add_word(f" {pattern.decode('latin-1')} ", (n, tuple(sorted(found))))
    built.make_automaton()
    return built


def scan(text: str | None, built: ahocorasick.Automaton | None) -> tuple[int, np.ndarray, set[int]]:
    """Number of words, the numbers of the hit words, the numbers of the items."""
    own = words(text)
    if not own or built is None:
        return len(own), np.empty(0, np.int32), set()
    found = list(built.iter(f" {b' '.join(own).decode('latin-1')} "))
    if not found:
        return len(own), np.empty(0, np.int32), set()
    # A match ends on the space after its last word.
    ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1)
    last = np.searchsorted(ends, [at for at, _ in found])
    edge = np.zeros(len(own) + 1, np.int64)
    np.add.at(edge, last + 1, -1)
    np.add.at(edge, last + 1 - np.array([n for _, (n, _) in found]), 1)
    return len(own), np.flatnonzero(np.cumsum(edge[:-1]) > 0).astype(np.int32), set().union(*(items for _, (_, items) in found))


def spans(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Character offsets in the original text of each run of hit words."""
    at = [m.span() for m in _WORD.finditer(text)]
    runs = np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1)
    return [(at[r[0]][0], at[r[-1]][1]) for r in runs]


def _scanner(items, window: int, keep: list[str], with_spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = items.value
        if id(items) not in _built:
            _built.clear()
            _built[id(items)] = (items, automaton(listed, window))
        built = _built[id(items)][1]
        for batch in slices(batches):
            n, hits, names, places = [], [], [], []
            for text in column(batch, "text").to_pylist():
                count, hit, found = scan(text, built)
                n.append(count)
                hits.append(hit)
                names.append(sorted({listed[x][0] for x in found}))
                if with_spans:
                    places.append(_places(text, hit))
            more = {"n_words": pa.array(n, pa.int64()), "_hit": pa.array(hits, pa.list_(pa.int32())), "_items": pa.array(names, pa.list_(pa.string()))}
            if with_spans:
                more["hit_spans"] = pa.array(places, _SPANS)
            yield append(batch, keep, **more)

    return run


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_FOUND = "n_words bigint, _hit array<int>, _items array<string>"
_WITH_SPANS = "hit_spans array<struct<start:int,end:int>>"


def _places(text: str | None, hit: np.ndarray) -> list[dict[str, int]]:
    return [{"start": a, "end": b} for a, b in spans(text or "", hit)] if len(hit) else []


class _Hashes(dict):
    """Word -> hash. Starts anew when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


_hashes = _Hashes()
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _keys(own: list[bytes], n: int) -> np.ndarray:
    """The hash of every n consecutive words."""
    h = np.fromiter(map(_hashes.__getitem__, own), np.uint64, len(own))
    out = np.full(max(len(own) - n + 1, 0), n, np.uint64)
    for k in range(n):
        out = (out ^ out >> np.uint64(29)) * _MIX + h[k : k + len(out)]
    return out ^ out >> np.uint64(32)


def _probes(keys: np.ndarray, bits: int) -> np.ndarray:
    """Places in a filter of so many bits, a power of two: PROBES of each key."""
    step = (keys * _MIX) >> np.uint64(20) | np.uint64(1)
    return (keys[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) & np.uint64(bits - 1)


def _windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most_bytes=1 << 20):
            rows: list[tuple] = []
            for item, text in zip(column(batch, "id").to_pylist(), column(batch, "text").to_pylist(), strict=True):
                own = words(text)
                n = min(window, len(own))
                if n:
                    rows += [(k, n, b" ".join(own[i : i + n]), item) for i, k in enumerate(_keys(own, n).view(np.int64).tolist())]
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["key", "n", "words", "id"])

    return run


def _paged(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = []
            for places in column(batch, "places").to_pylist():
                page = np.zeros(min(_PAGE_BITS, bits), np.uint8)
                page[places] = 1
                data.append(np.packbits(page).tobytes())
            yield append(batch, ["page"], data=pa.array(data, pa.binary()))

    return run


def _filter(windows: DataFrame, bits: int) -> str:
    """Writes the filter's pages that aren't empty into the shared folder; returns the folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = _probes(column(batch, "key").to_numpy().view(np.uint64), bits).ravel().astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(places)], names=["place"])

    path = f"{shared_dir(windows.sparkSession).rstrip('/')}/windows-{uuid.uuid4().hex}"
    places = windows.select("key").mapInArrow(run, "place bigint")
    pages = places.groupBy(F.floor(F.col("place") / _PAGE_BITS).cast("int").alias("page")).agg(F.collect_set((F.col("place") % _PAGE_BITS).cast("int")).alias("places"))
    pages.mapInArrow(_paged(bits), "page int, data binary").write.parquet(path)
    return path


_loaded: dict[str, np.ndarray] = {}


def _load(path: str, bits: int) -> np.ndarray:
    """The filter, once for each worker."""
    if path not in _loaded:
        _loaded.clear()
        store, folder = fs.FileSystem.from_uri(path if ":" in path.partition("/")[0] else f"file://{path}")
        held = np.zeros((max(bits // _PAGE_BITS, 1), min(_PAGE_BITS, bits) // 8), np.uint8)
        for batch in dataset.dataset(folder, filesystem=store, format="parquet").to_batches():
            for page, data in zip(batch.column("page").to_pylist(), batch.column("data").to_pylist(), strict=True):
                held[page] = np.frombuffer(data, np.uint8)
        _loaded[path] = held.ravel()
    return _loaded[path]


def _sifter(path: str, bits: int, sizes: list[int], keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _load(path, bits)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32()), ("key", pa.int64()), ("words", pa.binary())]))
        for batch in slices(batches):
            counts, found = [], []
            for text in column(batch, "text").to_pylist():
                own, some = words(text), []
                for n in sizes:
                    keys = _keys(own, n)
                    places = _probes(keys, bits).astype(np.int64)
                    maybe = (held[places >> 3] >> (7 - (places & 7)).astype(np.uint8) & 1).all(1)
                    some += [{"start": i, "n": n, "key": int(keys[i : i + 1].view(np.int64)[0]), "words": b" ".join(own[i : i + n])} for i in np.flatnonzero(maybe).tolist()]
                counts.append(len(own))
                found.append(some)
            yield append(batch, keep, n_words=pa.array(counts, pa.int64()), _maybe=pa.array(found, kind))

    return run


def _spanner(keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            both = zip(column(batch, "text").to_pylist(), column(batch, "_hit").to_pylist(), strict=True)
            yield append(batch, keep, hit_spans=pa.array([_places(t, np.array(h, np.int64)) for t, h in both], _SPANS))

    return run


def _by_hash(docs: DataFrame, items: DataFrame, window: int, with_spans: bool) -> DataFrame:
    """contamination of a benchmark of any size, items with distinct id and text."""
    windows = items.mapInArrow(_windows(window), "key bigint, n int, words binary, id string").distinct()
    found = windows.groupBy("n").count().collect()
    total = sum(r["count"] for r in found)
    bits = min(MOST_BITS, 1 << max(10, (BITS_EACH * total - 1).bit_length() if total else 0))
    keep = docs.columns
    run = _sifter(_filter(windows, bits), bits, sorted(r["n"] for r in found), keep)
    maybe = "_maybe array<struct<start:int,n:int,key:bigint,words:binary>>"
    # Kept once: the row's number must not change between its two readers.
    rows = stable(docs.mapInArrow(run, with_fields(docs.schema, "n_words bigint", maybe)).withColumn("_row", F.monotonically_increasing_id()))
    hits = rows.select("_row", F.inline("_maybe")).join(windows.drop("n"), ["key", "words"])
    every = hits.groupBy("_row").agg(F.collect_set(F.struct("start", "n")).alias("at"), F.array_sort(F.collect_set("id")).alias("_items"))
    spread = F.array_sort(F.array_distinct(F.flatten(F.transform("at", lambda h: F.sequence(h["start"], h["start"] + h["n"] - 1)))))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    out = rows.drop("_maybe").join(every.select("_row", spread.alias("_hit"), "_items"), "_row", "left")
    out = out.select(*keep, "n_words", F.coalesce("_hit", none("int")).alias("_hit"), F.coalesce("_items", none("string")).alias("_items"))
    return out.mapInArrow(_spanner(out.columns), with_fields(out.schema, _WITH_SPANS)) if with_spans else out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, with_spans: bool = False) -> DataFrame:
    """The columns of docs, and n_words, _hit (numbers of hit words, sorted), _items (sorted ids as strings) and, if asked for, hit_spans.

    A window is `window` consecutive words of an item; an item of fewer words,
    but not none, is one window. Null or wordless texts hit nothing; items
    without words are never found; a null item_id is listed as an empty string;
    items of the same id count once. Rows of docs stay as they are. Columns of
    docs by the names given here are replaced.

    Up to AUTOMATON_BYTES of benchmark go to the executors as they are, for one
    automaton; of more, a filter of at most MOST_BITS.
    """
    named = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), "text").distinct()
    size = named.agg(F.sum(F.octet_length("text") + F.octet_length("id"))).first()[0] or 0
    keep = [c for c in docs.columns if c not in ("n_words", "_hit", "_items", "hit_spans", "_maybe", "_row")]
    own = docs.select(*keep)
    if size > AUTOMATON_BYTES:
        return _by_hash(own, named, window, with_spans)
    items = docs.sparkSession.sparkContext.broadcast(sorted((r[0], r[1] or "") for r in named.collect()))
    return own.mapInArrow(_scanner(items, window, keep, with_spans), with_fields(T.StructType(own.schema.fields), _FOUND, *[_WITH_SPANS] * with_spans))


def op4_benchmark_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest of contamination, a row for each document."""
    n_hit = F.size("_hit").cast("long")
    return contamination(docs.select("doc_id", "text"), benchmark).select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents no word of which is hit, with the columns they had."""
    return contamination(docs, benchmark).filter(F.size("_hit") == 0).select(*docs.columns)
