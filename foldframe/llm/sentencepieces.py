"""SentencePiece encoding that keeps the place of every piece in the original bytes, and decoding.

The model's compiled character map (a double-array trie over UTF-8, followed by
the replacements) is walked here: at each place the longest prefix that it holds
is replaced, anything else is copied, and each normalised byte notes the
original byte it came from. The library splits the normalised text into pieces,
with its own normaliser turned off; their lengths add up to offsets, which the
notes project to spans of original bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from foldframe.llm.common import append, column, slices, with_fields

#: The mark that stands for a space.
_MARK = "▁".encode()
_BYTE, _USER, _UNKNOWN, _CONTROL = 6, 4, 2, 3


class CharacterMap:
    """The compiled character map of a model: uint32 size of the trie, its units, then replacements that end with a zero byte.

    kept: what the model's user says is never touched; it goes before the trie.
    """

    def __init__(self, blob: bytes, kept: list[bytes] | None = None) -> None:
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.text = blob[4 + size :] if size else b""
        self.kept = sorted(kept or [], key=len, reverse=True)
        self.may_start = self._starts()

    def _starts(self) -> np.ndarray:
        """Whether a prefix that is held can begin with two given bytes; the second index 256 stands for the end."""
        out = np.zeros((256, 257), bool)
        for word in self.kept:
            out[word[0]] = True
        if not self.units:
            return out
        offset = lambda unit: unit >> 10 << (unit >> 6 & 8)
        root = offset(self.units[0])
        for c in range(1, 256):
            unit = self.units[root ^ c]
            if unit & 0x800000FF != c:
                continue
            if unit >> 8 & 1:
                out[c] = True
            node = root ^ c ^ offset(unit)
            for d in range(1, 256):
                out[c, d] |= node ^ d < len(self.units) and self.units[node ^ d] & 0x800000FF == d
        return out

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest prefix of data[at:] that is held, and what replaces it."""
        for word in self.kept:
            if data.startswith(word, at):
                return len(word), word
        units, found = self.units, None
        if not units:
            return None
        node = units[0] >> 10 << (units[0] >> 6 & 8)
        for i in range(at, len(data)):
            node ^= data[i]
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= unit >> 10 << (unit >> 6 & 8)
            if unit >> 8 & 1:
                found = i + 1 - at, units[node] & 0x7FFFFFFF
        if not found:
            return None
        return found[0], self.text[found[1] : self.text.index(b"\0", found[1])]


def normalise(data: bytes, chars: CharacterMap, dummy_prefix: bool, squeeze: bool, escape: bool = True, suffix: bool = False) -> tuple[bytes, np.ndarray]:
    """Normalised bytes, and for each of them (and the end) the original byte where its character or prefix starts.

    The walk stops wherever a prefix of the map can begin; what lies between is
    copied at once. suffix: the dummy prefix stands at the end.
    """
    mark = _MARK if escape else b" "
    raw = np.frombuffer(data, np.uint8)
    # Characters that are copied: every byte notes where its character starts.
    place = np.maximum.accumulate(np.where(raw & 0xC0 != 0x80, np.arange(len(raw)), 0)) if len(raw) else np.empty(0, np.int64)
    values, sources, held = [], [], []
    at = 0
    for i in np.flatnonzero(chars.may_start[raw, np.append(raw[1:], 256)] if len(raw) else raw).tolist():
        if i < at or not (found := chars.longest(data, i)):
            continue
        n, new = found
        values += [raw[at:i], np.frombuffer(new, np.uint8)]
        sources += [place[at:i], np.full(len(new), i)]
        # Only the spaces that a replacement begins with can be squeezed.
        held += [np.zeros(i - at, bool), np.arange(len(new)) >= len(new) - len(new.lstrip(b" "))]
        at = i + n
    out, source = np.concatenate([*values, raw[at:]]), np.concatenate([*sources, place[at:]]).astype(np.int64)
    space = out == 32
    if squeeze:
        before = np.concatenate(([True], space[:-1]))[: len(out)]
        stays = ~(space & before) | np.concatenate([*held, np.zeros(len(raw) - at, bool)])
        out, source, space = out[stays], source[stays], space[stays]
    sizes = np.where(space, len(mark), 1)
    source = np.repeat(source, sizes)
    text = out.tobytes().replace(b" ", mark)
    # What is normalised to nothing keeps its prefix, unless spaces at the end go.
    if dummy_prefix and (text or data and not squeeze):
        first = np.full(len(mark), len(data) if suffix or not text else source[0])
        text, source = (text + mark, np.append(source, first)) if suffix else (mark + text, np.append(first, source))
    if squeeze and not suffix:
        ends = len(text)
        while text.endswith(mark, 0, ends):  # the text's own marks, too
            ends -= len(mark)
        text, source = text[:ends], source[:ends]
    return text, np.append(source, len(data))


class Pieces:
    """A model with what the spans need: each id's length in normalised bytes."""

    def __init__(self, path: str) -> None:
        proto = model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        self.model = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        kinds = [p.type for p in proto.pieces]
        self.chars = CharacterMap(spec.precompiled_charsmap, [p.piece.encode() for p in proto.pieces if p.type == _USER])
        self.flags = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces, proto.trainer_spec.treat_whitespace_as_suffix
        self.sizes = np.array([1 if k == _BYTE else 0 if k == _CONTROL else len(p.piece.encode()) for p, k in zip(proto.pieces, kinds, strict=True)], np.int64)
        self.unknown = kinds.index(_UNKNOWN) if _UNKNOWN in kinds else -1
        self.fallback = _BYTE in kinds
        # The same pieces over text that is normalised already.
        spec.precompiled_charsmap, spec.name = b"", "identity"
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = spec.escape_whitespaces = False
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        return normalise(text.encode(), self.chars, *self.flags)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [x.tolist() for x, _ in self.encoded(texts)]

    def encoded(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray | None]]:
        """Ids, the end id last, and spans of each text: it's normalised here, and the library splits what comes out."""
        normal = [self.normalise(t) for t in texts]
        ids = self.plain.encode([n.decode() for n, _ in normal], add_bos=False, add_eos=True, num_threads=1)
        return [(own := np.array(x, np.int32), self._spans(own, t.encode(), *n)) for x, t, n in zip(ids, texts, normal, strict=True)]

    def spans(self, text: str, ids: np.ndarray) -> np.ndarray | None:
        """Where each id's piece starts in the original bytes, and at last the end; the end id is an empty span there. None if the ids are not those of the text."""
        return self._spans(ids, text.encode(), *self.normalise(text))

    def _spans(self, ids: np.ndarray, data: bytes, normal: bytes, source: np.ndarray) -> np.ndarray | None:
        sizes = self.sizes[ids]
        if not self.fallback and (ids == self.unknown).any():
            # An unknown piece covers what lies up to the next known one.
            pieces = self.plain.encode(normal.decode(), return_type="proto").pieces
            sizes = np.array([len(p.piece.encode()) for p in pieces] + [0] * (len(ids) - len(pieces)), np.int64)
        ends = np.cumsum(sizes)
        if (ends[-1] if len(ends) else 0) != len(normal):
            return None
        return _by_byte(normal, source, data)[np.concatenate(([0], ends))]


def _by_byte(normal: bytes, source: np.ndarray, data: bytes) -> np.ndarray:
    """source with each byte of a copied character at its own place, for pieces of one byte."""
    first = np.flatnonzero(np.concatenate(([True], source[1:] != source[:-1])))
    sizes = np.diff(np.append(first, len(source)))
    rank = np.arange(len(source)) - np.repeat(first, sizes)
    width = np.diff(np.append(source[first], len(data)))
    out = source + np.where(np.repeat(sizes == width, sizes), rank, 0)
    # Replaced bytes stay where their prefix starts.
    same = np.frombuffer(data, np.uint8)[np.minimum(out[:-1], max(len(data) - 1, 0))] == np.frombuffer(normal, np.uint8) if data else np.empty(0, bool)
    whole = np.append(same, True)
    copied = np.repeat(np.minimum.reduceat(whole, first), sizes)
    return np.where(copied, out, source)


_loaded: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def _encoder(path: str, keep: list[str], full: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in slices(batches, most_bytes=1 << 20):
            n, shas, decoded, places, ids_out, starts_out = [], [], [], [], [], []
            texts = [x or "" for x in column(batch, "text").to_pylist()]
            for held, at in model.encoded(texts):
                ids = held.tolist()
                n.append(len(ids))
                shas.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(model.model.decode(ids).encode()).hexdigest())
                at = None if at is None else at.astype(np.int32)
                places.append(None if at is None else hashlib.sha256(at.tobytes()).hexdigest())
                if full:
                    ids_out.append(held)
                    starts_out.append(at)
            more = {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(shas), "decoded_sha256": pa.array(decoded), "spans_sha256": pa.array(places, pa.string())}
            if full:
                more |= {"ids": pa.array(ids_out, pa.list_(pa.int32())), "starts": pa.array(starts_out, pa.list_(pa.int32()))}
            yield append(batch, keep, **more)

    return run


def encode(docs: DataFrame, path: str, full: bool = True) -> DataFrame:
    """(doc_id, text) -> doc_id, n_tokens, ids_sha256, decoded_sha256, spans_sha256 and, if full, ids and starts.

    ids end with the end id; starts has one entry more than ids: piece i covers
    the original UTF-8 bytes starts[i] to starts[i + 1]. A null text counts as
    empty and has the end id alone. starts and spans_sha256 are null where the
    pieces don't add up to the normalised text, as no known model's do. Repeated
    rows stay; further columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    ddl = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_sha256 string" + ", ids array<int>, starts array<int>" * full
    return docs.select("doc_id", "text").mapInArrow(_encoder(path, ["doc_id"], full), ddl)


def _decoder(path: str, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in slices(batches, "ids_sha256"):
            yield append(batch, keep, decoded=pa.array([None if x is None else model.model.decode(x) for x in column(batch, "ids").to_pylist()], pa.string()))

    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Rows with ids -> their columns and decoded: the text of the library's decode(ids), null for null ids."""
    keep = [c for c in encoded.columns if c != "decoded"]
    return encoded.select(*keep).mapInArrow(_decoder(path, keep), with_fields(encoded.select(*keep).schema, "decoded string"))


def op8_sentencepiece(docs: DataFrame, path: str) -> DataFrame:
    """The digest of encode: one row for each document."""
    return encode(docs, path, full=False)
