"""Queries that SQL can't express, held against plain versions over whole tables."""

from __future__ import annotations

import difflib

import numpy as np

from foldframe.functions.lookups import BLOSUM62
from foldframe.operators import superposition
from foldframe.operators.alignment import GAP_EXTEND, GAP_OPEN
from foldframe.plans import derived, registry
from tests.conftest import SF

SMALL = "/root/testdata/sf0.001"


def _best(a, b):
    """The best score of a global alignment, cell by cell."""
    low = float("-inf")
    last = [(0.0, low, low)] + [(low, low, GAP_OPEN + GAP_EXTEND * j) for j in range(len(b))]
    for i, x in enumerate(a):
        now = [(low, GAP_OPEN + GAP_EXTEND * i, low)]
        for j, y in enumerate(b):
            up, left = last[j + 1], now[j]
            now.append((max(last[j]) + BLOSUM62[x, y], max(max(up[0], up[2]) + GAP_OPEN, up[1] + GAP_EXTEND), max(max(left[0], left[1]) + GAP_OPEN, left[2] + GAP_EXTEND)))
        last = now
    return max(last[-1])


def _own_score(a, b):
    """The score of two aligned strings as they stand."""
    total, gap = 0.0, None
    for x, y in zip(a, b, strict=True):
        kind = "a" if x == "-" else "b" if y == "-" else None
        total += BLOSUM62[x, y] if kind is None else GAP_EXTEND if kind == gap else GAP_OPEN
        gap = kind
    return total


def test_alignment_scores(spark):
    rows = registry.QUERIES["global_alignment_score"](spark, SMALL).collect()
    names = {r.reference_id for r in rows} | {r.target_id for r in rows}
    assert len(rows) == len(names) * (len(names) - 1) // 2 > 100
    for r in rows:
        assert (r.aligned_reference.replace("-", ""), r.aligned_target.replace("-", "")) == (r.reference_id, r.target_id)
        assert abs(r.score - _own_score(r.aligned_reference, r.aligned_target)) < 1e-9
    for r in rows[:: max(1, len(rows) // 4000)]:  # every row up to 4,000, evenly spread ones beyond
        assert abs(r.score - _best(r.reference_id, r.target_id)) < 1e-9


def test_refined_rmsd(spark):
    pairs = {}
    for r in registry._analysis(spark, SF).correspondence().collect():
        if r.reference_x is not None and r.target_x is not None:
            pairs.setdefault(r.pair_id, []).append((r.alignment_index, [r.reference_x, r.reference_y, r.reference_z], [r.target_x, r.target_y, r.target_z]))
    got = {r.pair_id: r for r in registry.QUERIES["refined_rmsd"](spark, SF).collect()}
    assert got.keys() == pairs.keys() and len(got) > 400
    for pair, rows in pairs.items():
        rows.sort()
        a, b = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
        kept = list(range(len(rows)))
        for _ in range(superposition.REFINED_ITERATIONS if len(rows) >= 3 else 0):
            turn, shift = superposition.kabsch(a[kept], b[kept])
            near = [i for i in range(len(rows)) if np.sqrt(((b[i] @ turn + shift - a[i]) ** 2).sum()) <= superposition.REFINED_CUTOFF]
            same, kept = near == kept, near
            if same or not kept:
                break
        assert got[pair].refined_count == len(kept)
        assert [x for x in got[pair].excluded.split(",") if x] == [str(rows[i][0]) for i in range(len(rows)) if i not in kept]
        if kept:
            turn, shift = superposition.kabsch(a[kept], b[kept])
            want = np.sqrt(((b[kept] @ turn + shift - a[kept]) ** 2).sum() / len(kept))
            assert abs(got[pair].refined_rmsd - want) < 1e-6
        else:
            assert got[pair].refined_rmsd is None


def test_msa_rows(spark):
    """Each family's rows by walking the matching blocks with its first sequence."""
    names = {r.structure_id: r for r in registry._structures(spark, SF).collect()}
    families = {}
    for r in derived.rows_of_structures(spark, SF).collect():
        own = names[r.structure_id]
        families.setdefault(str(own.group_id), []).append((own.ord, r.structure_id, r.row.replace("-", "")))
    want = set()
    for family, rows in families.items():
        rows.sort()
        first, made = rows[0][2], []
        for _, _, s in rows:
            out, i, j = "", 0, 0
            for block in difflib.SequenceMatcher(None, first, s, autojunk=False).get_matching_blocks():
                width = max(block.a - i, block.b - j)
                out += s[j : block.b].ljust(width, "-") + s[block.b : block.b + block.size]
                i, j = block.a + block.size, block.b + block.size
            made.append(out)
        width = max(map(len, made))
        want |= {(family, o, name, row.ljust(width, "-")) for (o, name, _), row in zip(rows, made, strict=True)}
    assert {tuple(r) for r in registry.QUERIES["msa_rows"](spark, SF).collect()} == want and len(want) > 400
