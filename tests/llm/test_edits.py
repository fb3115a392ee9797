from __future__ import annotations

import hashlib
import random

from foldframe.llm import edits
from foldframe.llm.edits import fingerprint, fingerprints, likeness, op1_edit_fingerprints, search

SF = "/root/testdata/sf0.01"


def _plain(text):
    """The embedding in full, step by step, then sampled."""
    out, step = [], 0
    for c in edits.classes(text):
        n = edits._DWELL[c][step % edits.PERIOD]
        out += [chr(edits._SYMBOL[c])] * n
        step += n
    return "".join(out[s] for s in edits._STEPS if s < len(out))


def _want(rows):
    rows = sorted(rows, key=lambda r: (-r[0] if r[0] is not None else float("inf"), r[1] or ""))
    out = []
    for (d, t), (_, n) in zip(rows, rows[1:] + rows[:1], strict=True):
        t, n = t or "", n or ""
        cut = len(t) - len(t) // 3
        e = t[:cut] + n[: len(t) // 3]
        a, b, c = _plain(t), _plain(e), _plain(n)
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), a, b, round(likeness(a, b), 9), round(likeness(a, c), 9)))
    return sorted(out, key=str)


def _got(df):
    return sorted([(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in df.collect()], key=str)


def test_whole_table(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = _want([(r.doc_id, r.text) for r in docs.collect()])
    for size in (edits.PIECE_BYTES, 100_000):
        monkeypatch.setattr(edits, "PIECE_BYTES", size)
        assert _got(op1_edit_fingerprints(docs)) == want
    assert sum(w[5] > 0.6 for w in want) > 0.97 * len(want) and sum(w[6] < 0.3 for w in want) > 0.97 * len(want)


def test_edges(spark, monkeypatch):
    rows = [(5, "abc"), (9, None), (2, ""), (7, "ünï😀" * 9), (7, "ünï😀" * 9), (7, "other"), (None, "no id"), (1, "z" * 70_000), (-4, "neg ative text")]
    for size in (edits.PIECE_BYTES, 10):
        monkeypatch.setattr(edits, "PIECE_BYTES", size)
        docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id bigint, text string, piece string")
        assert _got(op1_edit_fingerprints(docs)) == _want(rows)
        assert op1_edit_fingerprints(docs.limit(0)).count() == 0
        one = docs.filter("doc_id = 5")
        assert _got(op1_edit_fingerprints(one)) == _want([(5, "abc")])


def test_few_edits_stay_near_and_are_found(spark):
    rng = random.Random(4)
    text = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id = 3").first().text
    copies = []
    for _ in range(20):
        chars = list(text)
        for _ in range(4):
            at = rng.randrange(len(chars))
            chars[at : at + rng.randrange(2)] = rng.choice(["", "q", "xy"])
        copies.append("".join(chars))
    assert sum(likeness(fingerprint(text), fingerprint(c)) for c in copies) / 20 > 0.8
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(10_000 + i, c) for i, c in enumerate(copies)], "doc_id bigint, text string"))
    fps = fingerprints(docs)
    queries = fps.filter("doc_id in (3, 50, 100, 150, 200, 250)")
    got = {(r.query, r.found): r.likeness for r in search(queries, fps).collect()}
    every = {r.fingerprint for r in fps.collect()}
    want = {(q.fingerprint, f) for q in queries.collect() for f in every if likeness(q.fingerprint, f) >= 0.8}
    assert got.keys() <= want and len(got) >= 0.9 * len(want)


def test_short_near_copies_are_found(spark):
    rng = random.Random(9)
    fps = {fingerprint("".join(rng.choice("abcdefghijklmnop ") for _ in range(n))) for n in range(2, 140, 2)}
    # Some symbols changed, some cut: across the boundaries of the bands, too.
    for fp in sorted(fps):
        for _ in range(4):
            own = list(fp)
            for _ in range(rng.randrange(1, 2 + len(own) // 8)):
                own[rng.randrange(len(own))] = rng.choice("XYZ")
            fps.add("".join(own[: len(own) - rng.randrange(1 + len(own) // 10)]))
    table = spark.createDataFrame([(x,) for x in sorted(fps)], "fingerprint string")
    got = {(r.query, r.found) for r in search(table, table).collect()}
    want = {(a, b) for a in fps for b in fps if likeness(a, b) >= 0.8}
    assert got <= want
    both = lambda low, high: {(a, b) for a, b in want if a != b and low <= len(a) < high}
    for low, high in ((1, 16), (16, 64), (64, 192), (192, 400)):
        near = both(low, high)
        assert len(near) > 10 and len(got & near) >= 0.9 * len(near), (low, len(near), len(got & near))
    across = {(a, b) for a, b in want if len(a) < 192 <= len(b)}
    assert across and len(got & across) >= 0.9 * len(across)


def test_recall_by_length(spark):
    """One to a few characters changed in texts of 20 to 20,000: recall of pairs of likeness 0.8 or more, for each length."""
    rng = random.Random(17)
    rows = []
    for n in (20, 40, 60, 80, 100, 130, 200, 1000, 5000, 20_000):
        for i in range(100 if n < 1000 else 20):
            own = [rng.choice("abcdefghijklmnop ") for _ in range(n)]
            other = list(own)
            for _ in range(1 + n // 2000):
                other[rng.randrange(n)] = rng.choice("qrstuvwxyz")
            rows.append((n, fingerprint("".join(own)), fingerprint("".join(other))))
    queries = spark.createDataFrame([(a,) for _, a, _ in rows], "fingerprint string")
    found = spark.createDataFrame([(b,) for _, _, b in rows], "fingerprint string")
    got = {(r.query, r.found) for r in search(queries, found).collect()}
    for n in sorted({n for n, _, _ in rows}):
        near = {(a, b) for m, a, b in rows if m == n and likeness(a, b) >= 0.8}
        assert len(near) >= 5 and len(near & got) >= 0.9 * len(near), (n, len(near), len(near & got))


def test_search_edges(spark):
    made = lambda xs: spark.createDataFrame([(x, "k") for x in xs], "fingerprint string, band string")
    some = made(["", None, "A", "AB", "AB"])
    assert search(some.limit(0), some).count() == search(some, some.limit(0)).count() == 0
    assert sorted((r.query, r.found) for r in search(some, some).collect()) == [("", ""), ("A", "A"), ("AB", "AB")]
    # Many equal bands: one beginning, ends that differ a little.
    head = fingerprint("the same words at the beginning of every text " * 8)
    many = made([head[:-6] + f"{i:06d}" for i in range(300)])
    assert search(many.limit(10), many).count() == 3000
