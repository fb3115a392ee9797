"""WARC archives compressed record by record with a shared Zstandard dictionary.

An archive begins with a skippable frame that holds the dictionary; every record
is a frame of its own. Records whose payload was seen at a smaller page_id are
written as revisits, without the payload.
"""

from __future__ import annotations

import base64
import hashlib
import io
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldframe.llm.common import column, shared_dir, slices, stable

#: An archive is closed once it holds so many compressed bytes.
ARCHIVE_BYTES = 16 << 20
#: The dictionary is built from at most so many records, of each at most so many bytes; no record is cut by this.
DICTIONARY_RECORDS, RECORD_BYTES, DICTIONARY_BYTES = 512, 16 << 10, 64 << 10
LEVEL = 6

# Fixed values of the format.
SKIPPABLE_MAGIC = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Pages carry no time of capture.
NO_DATE = "1970-01-01T00:00:00Z"
_URN, _NO_ID = "urn:x-page:", "urn:x-no-page"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page: str | None) -> str:
    """A record's name: the page's id with everything escaped that a header can't hold."""
    return _NO_ID if page is None else _URN + urllib.parse.quote(page, safe="")


def _page(urn: str | None) -> str | None:
    """The id that _urn was given."""
    urn = (urn or "").strip("<>")
    return urllib.parse.unquote(urn.removeprefix(_URN)) if urn.startswith(_URN) else None


def record(page: str | None, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """The bytes of one record; refers_to makes it a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{_urn(page)}>",
        f"WARC-Date: {NO_DATE}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + urllib.parse.quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{_urn(refers_to)}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or for too little to train on the samples themselves; empty without any."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:DICTIONARY_BYTES]


class Archive:
    """One archive in memory."""

    def __init__(self, shared: bytes) -> None:
        self.out, self.records = io.BytesIO(), 0
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(shared)) if shared else zstandard.ZstdCompressor(level=LEVEL)
        packed = zstandard.ZstdCompressor(level=LEVEL).compress(shared)
        self.out.write(SKIPPABLE_MAGIC.to_bytes(4, "little") + len(packed).to_bytes(4, "little") + packed)

    def add(self, data: bytes) -> None:
        self.out.write(self.compressor.compress(data))
        self.records += 1


def read_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of an archive."""
    if int.from_bytes(data[:4], "little") != SKIPPABLE_MAGIC:
        raise ValueError("the archive doesn't begin with its dictionary")
    end = 8 + int.from_bytes(data[4:8], "little")
    shared = data[8:end]
    if shared.startswith(ZSTD_MAGIC):
        shared = zstandard.ZstdDecompressor().decompress(shared)
    opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(shared)) if shared else zstandard.ZstdDecompressor()
    with opener.stream_reader(io.BytesIO(data[end:]), read_across_frames=True) as raw, io.BufferedReader(raw, 1 << 16) as stream:
        while line := stream.readline():
            if not line.startswith(b"WARC/"):
                raise ValueError(f"not a record: {line[:40]!r}")
            head = {}
            while (line := stream.readline().rstrip(b"\r\n")):
                name, _, value = line.decode().partition(":")
                head[name.lower()] = value.strip()
            block = stream.read(int(head["content-length"]))
            if stream.read(4) != b"\r\n\r\n":
                raise ValueError("a record isn't closed")
            yield head, block


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _writer(out_dir: str, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _opened(out_dir)
        now: Archive | None = None

        def closed(done: Archive) -> pa.RecordBatch:
            # A name of its own for every attempt: only archives that a finished task lists are read.
            name = f"{folder}/{uuid.uuid4().hex}.warc.zst"
            with store.open_output_stream(name, compression=None) as f:
                f.write(done.out.getbuffer())
            return pa.RecordBatch.from_pydict({"archive": [name.rpartition("/")[2]], "records": [done.records], "bytes": [done.out.tell()]})

        for batch in slices(batches, "payload"):
            for page, url, payload, refers_to in zip(*(column(batch, k).to_pylist() for k in ("page", "url", "payload", "refers_to")), strict=True):
                now = now or Archive(shared.value)
                now.add(record(page, url, payload, refers_to))
                if now.out.tell() >= ARCHIVE_BYTES:
                    yield closed(now)
                    now = None
        if now:
            yield closed(now)

    return run


def _reader(out_dir: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _opened(out_dir)
        for batch in batches:
            for name in column(batch, "archive").to_pylist():
                with store.open_input_stream(f"{folder}/{name}", compression=None) as f:
                    data = f.read()
                rows: list[tuple] = []
                for head, block in read_records(data):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(http.decode().lower().partition("content-length:")[2].split()[0])
                    said = head["warc-payload-digest"].removeprefix("sha1:")
                    kind = head["warc-type"]
                    if kind == "response" and (len(payload) != size or digest(payload) != said):
                        raise ValueError(f"{name}: a payload isn't what its digest says")
                    page, first = _page(head["warc-record-id"]), _page(head.get("warc-refers-to"))
                    rows.append((page, head.get("warc-target-uri"), size, said, kind, first))
                    if len(rows) == 4096:
                        yield _as_batch(rows)
                        rows = []
                yield _as_batch(rows)

    return run


_READ = T.StructType([T.StructField(k, T.LongType() if k == "payload_bytes" else T.StringType()) for k in ("page", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")])


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64() if f.name == "payload_bytes" else pa.string() for f in _READ]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=_READ.names)


def typed(pages: DataFrame, least_bytes: int) -> DataFrame:
    """page, url, payload, refers_to: null for a response, for a revisit the least page_id of that payload.

    Payloads of at least least_bytes that stand in more than one record count as
    seen; all rows that carry the least page_id are responses, as are all rows
    of a payload without any page_id.
    """
    payload = F.coalesce(F.encode(F.col("html"), "UTF-8"), F.lit(b""))
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("sha", F.sha1("payload"))
    again = rows.filter(F.octet_length("payload") >= least_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") > F.col("first")), F.col("first")).cast("string")
    return rows.join(again, "sha", "left").select(F.col("page_id").cast("string").alias("page"), "url", "payload", refers.alias("refers_to"))


def write(pages: DataFrame, out_dir: str, least_bytes: int = 0) -> DataFrame:
    """Write (page_id, url, html) as archives into out_dir, which all executors reach; returns (archive, records, bytes), already made.

    A null html is an empty payload, a null url leaves the target out, a null
    page_id a record id without one (an empty id stays empty); repeated rows give repeated records. No rows
    give no archive. A task holds one archive in memory.
    """
    rows = typed(pages, least_bytes)
    # The least hashes are found first, so that only the chosen payloads travel.
    hashed = pages.withColumn("h", F.xxhash64("html"))
    chosen = hashed.select("h").distinct().orderBy("h").limit(DICTIONARY_RECORDS)
    begun = F.substring(F.encode(F.coalesce("html", F.lit("")), "UTF-8"), 1, RECORD_BYTES)
    sample = hashed.select("url", "h", begun.alias("p")).join(F.broadcast(chosen), "h").dropDuplicates(["h"]).orderBy("h").collect()
    shared = dictionary([record("0", r["url"], bytes(r["p"]), None) for r in sample])
    store, folder = _opened(out_dir)
    store.create_dir(folder, recursive=True)
    return stable(rows.mapInArrow(_writer(out_dir, pages.sparkSession.sparkContext.broadcast(shared)), "archive string, records bigint, bytes bigint"))


def read(archives: DataFrame, out_dir: str) -> DataFrame:
    """(archive) -> a row for each record: page, url, payload_bytes, payload_digest, record_type, refers_to; payloads are held against their digests."""
    return archives.select("archive").repartition("archive").mapInArrow(_reader(out_dir), _READ)


def op9_warc(pages: DataFrame) -> DataFrame:
    """Archives of all pages in the shared folder, read back: the digest of each record."""
    out_dir = f"{shared_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    kind = pages.schema["page_id"].dataType
    return read(write(pages, out_dir), out_dir).select(F.col("page").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
