from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from foldframe.llm.sentencepieces import CharacterMap, Pieces, decode, encode, normalise, op8_sentencepiece

SF = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return Pieces(PATH)


def test_whole_table(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in op8_sentencepiece(docs, PATH).collect()}
    for r in docs.collect():
        ids = model.model.encode(r.text, add_eos=True)
        want = len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(model.model.decode(ids).encode()).hexdigest()
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256, got[r.doc_id].decoded_sha256) == want


def test_spans_follow_the_library(model):
    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choice("ab ▁  \n\té日😀\x001 .,-") for _ in range(rng.randint(0, 14)))
        ids = model.encode([text])[0]
        at = model.spans(text, np.array(ids, np.int32))
        assert at[0] == 0 and at[-1] == len(text.encode()) and (np.diff(at) >= 0).all()
        proto = model.model.encode(text, return_type="proto").pieces
        data = text.encode()
        whole = [(p, a, b) for p, a, b in zip(proto, at, at[1:], strict=False) if p.begin != p.end]
        for p, a, b in whole:
            if not p.piece.startswith("<0x") and b > a:
                assert data[a:b].decode() == p.surface


def _trie(pairs):
    """A double array of the compiled form, built by trying every base."""
    keys = sorted((k + b"\0", i) for i, (k, _) in enumerate(pairs))
    units, taken, bases = {0: 0}, {0}, set()
    text, places = b"", []
    for _, new in pairs:
        places.append(len(text))
        text += new + b"\0"

    def build(node, prefix):
        nexts = sorted({k[len(prefix)] for k, _ in keys if k.startswith(prefix) and len(k) > len(prefix)})
        base = next(b for b in range(1, 4096) if b not in bases and all((b ^ c) not in taken for c in nexts) and b ^ node)
        bases.add(base)
        offset = base ^ node
        for c in nexts:
            taken.add(base ^ c)
        units[node] = units.get(node, 0) | offset << 10 | (0x100 if 0 in nexts else 0)
        for c in nexts:
            if c == 0:
                units[base] = 0x80000000 | places[next(i for k, i in keys if k == prefix + b"\0")]
            else:
                units[base ^ c] = c
                build(base ^ c, prefix + bytes([c]))

    build(0, b"")
    size = -(-(max(units) + 257) // 256) * 256  # the library wants whole blocks
    array = b"".join(units.get(i, 0x7F).to_bytes(4, "little") for i in range(size))
    return len(array).to_bytes(4, "little") + array + text


def test_longest_prefix_of_a_compiled_map():
    pairs = [("Ａ".encode(), b"A"), ("ﬁ".encode(), b"fi"), (b"ab", b"x"), (b"abc", b"yz"), ("é".encode(), "é".encode()), (b"\t", b" "), (b"q", b"")]
    chars = CharacterMap(_trie(pairs))
    table = dict(pairs)
    rng = random.Random(1)
    for _ in range(2000):
        data = "".join(rng.choice("ＡﬁabcéeX \tq😀") for _ in range(rng.randint(0, 10))).encode()
        want, at = [], 0
        while at < len(data):
            n = max((len(k) for k in table if data.startswith(k, at)), default=0)
            new = table[data[at : at + n]] if n else data[at : at + 1]
            want += [(b, at + (0 if n else 0)) for b in new]
            at += n or 1
        out, source = normalise(data, chars, False, False, False)
        assert out == bytes(b for b, _ in want)
        # A character that is copied has one source for all of its bytes.
        starts = [i for i in range(len(data)) if data[i] & 0xC0 != 0x80]
        assert source[:-1].tolist() == [max(s for s in starts if s <= a) for _, a in want] and source[-1] == len(data)
    assert normalise(b"  a  b ", chars, True, True)[0] == "▁a▁b".encode()
    assert normalise(b"  a  b ", chars, True, True)[1].tolist() == [2, 2, 2, 2, 3, 3, 3, 5, 7]


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x"), (4, "wörter " * 20_000)]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id bigint, text string, ids string")
    back = decode(encode(docs, PATH), PATH).collect()
    assert sorted(((r.doc_id, r.decoded) for r in back), key=str) == sorted(((d, t or "") for d, t in rows), key=str)
    assert {r.n_tokens for r in back if r.doc_id in (1, 2)} == {1}
    assert encode(docs.limit(0), PATH).count() == 0


def _with_map(tmp_path, **flags):
    """The model with a character map, and the library over it."""
    from sentencepiece import sentencepiece_model_pb2 as model_pb2

    pairs = [("Ａ".encode(), b"A"), ("ﬁ".encode(), b"fi"), (b"ab", b"x"), (b"abc", b"yz"), ("e\u0301".encode(), "é".encode()), (b"\t", b" "), ("\u3000".encode(), b" "), ("…".encode(), b". . ."), (b"qq", b"")]
    proto = model_pb2.ModelProto()
    with open(PATH, "rb") as f:
        proto.ParseFromString(f.read())
    proto.normalizer_spec.precompiled_charsmap = _trie(pairs)
    for name, value in flags.items():
        setattr(proto.normalizer_spec, name, value)
    path = str(tmp_path / "mapped.model")
    with open(path, "wb") as f:
        f.write(proto.SerializeToString())
    return path


@pytest.mark.parametrize("flags", [{}, {"remove_extra_whitespaces": True}, {"remove_extra_whitespaces": True, "add_dummy_prefix": False}, {"add_dummy_prefix": False}])
def test_model_with_a_map(tmp_path, flags):
    """Ids through the own normaliser are the library's, and spans give the original text back."""
    import sentencepiece

    path = _with_map(tmp_path, **flags)
    own, library = Pieces(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(5)
    for _ in range(4000):
        text = "".join(rng.choice(["Ａ", "ﬁ", "a", "b", "c", "e\u0301", "e", "\t", " ", "  ", "\u3000", "…", "q", "qq", "日", "😀", "x", "▁", "\n"]) for _ in range(rng.randint(0, 14)))
        ids, at = own.encoded([text])[0]
        assert ids.tolist() == library.encode(text, add_eos=True), (text, flags)
        data = text.encode()
        assert at[-1] == len(data) and (np.diff(at) >= 0).all()
        normal, source = own.normalise(text)
        assert own.spans(text, ids).tolist() == at.tolist() and len(source) == len(normal) + 1
        # What is copied unchanged stands in the piece's span.
        for piece, a, b in zip(ids.tolist(), at.tolist(), at.tolist()[1:], strict=False):
            if library.id_to_piece(piece) in ("日", "x") and b > a:
                assert library.id_to_piece(piece).encode() in data[a:b] or b"ab" in data[a:b]


def test_bytes_have_places_of_their_own(model):
    text = "a\U0001fae8b"
    ids, at = model.encoded([text])[0]
    spans = [text.encode()[a:b] for a, b in zip(at, at[1:], strict=False)]
    assert b"".join(spans) == text.encode() and sum(len(x) == 1 for x in spans) >= 4


def test_ids_of_another_text(model):
    assert model.spans("abc", np.array(model.encode(["quite another text"])[0], np.int32)) is None
