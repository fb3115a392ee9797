"""Global affine-gap alignment of sequences."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldframe.functions.lookups import BLOSUM62

GAP_OPEN, GAP_EXTEND = -10.0, -0.5
_LETTERS = "ARNDCQEGHILKMFPSTWYVBZX*"
_MATRIX = np.array([[BLOSUM62[a, b] for b in _LETTERS] for a in _LETTERS], float)
_INDEX = {c: i for i, c in enumerate(_LETTERS)}
#: States of a cell: two letters, a gap in the target, a gap in the reference.
_MATCH, _UP, _LEFT = range(3)
_LOW = -1e30


def gotoh(reference: str, target: str, gap_open: float = GAP_OPEN, gap_extend: float = GAP_EXTEND) -> tuple[str, str, float]:
    """Best global alignment and its score; end gaps cost as inner ones do, symbols outside the matrix count as X.

    Of equal paths the one that, read from the end, prefers a match, then a gap
    in the target, then one in the reference. Work goes along anti-diagonals, of
    which three are held; a cell keeps one byte, the steps that led to it.
    """
    n, m = len(reference), len(target)
    a = np.array([_INDEX.get(c, _INDEX["X"]) for c in reference.upper()], int)
    b = np.array([_INDEX.get(c, _INDEX["X"]) for c in target.upper()], int)
    steps = np.zeros((n + 1, m + 1), np.uint8)
    # Gaps at the beginning go on from themselves, but for the first.
    steps[2:, 0] = _UP << 2
    steps[0, 2:] = _LEFT << 4
    cost = np.full((3, 3), gap_open)  # from a state (column) into a gap of a kind (row)
    cost[_UP, _UP] = cost[_LEFT, _LEFT] = gap_extend
    # Scores on a diagonal by state and place in the reference.
    before, last = (np.full((3, n + 1), _LOW) for _ in range(2))
    last[_MATCH, 0] = 0.0
    for d in range(1, n + m + 1):
        now = np.full((3, n + 1), _LOW)
        if d <= n:
            now[_UP, d] = gap_open + gap_extend * (d - 1)
        if d <= m:
            now[_LEFT, 0] = gap_open + gap_extend * (d - 1)
        low, high = max(1, d - m), min(n, d - 1) + 1
        if low < high:
            i, found = np.arange(low, high), np.zeros(high - low, np.uint8)
            for state, held, more in (
                (_MATCH, before[:, low - 1 : high - 1], _MATRIX[a[i - 1], b[d - i - 1]]),
                (_UP, last[:, low - 1 : high - 1] + cost[_UP, :, None], 0.0),
                (_LEFT, last[:, low:high] + cost[_LEFT, :, None], 0.0),
            ):
                found |= (held.argmax(0) << 2 * state).astype(np.uint8)
                now[state, low:high] = held.max(0) + more
            steps[i, d - i] = found
        before, last = last, now
    i, j = n, m
    state = int(last[:, n].argmax())
    score = float(last[state, n])
    out_a, out_b = [], []
    while i or j:
        came = int(steps[i, j]) >> 2 * state & 3
        if state != _LEFT:
            i -= 1
        if state != _UP:
            j -= 1
        out_a.append("-" if state == _LEFT else reference[i])
        out_b.append("-" if state == _UP else target[j])
        state = came
    return "".join(out_a[::-1]), "".join(out_b[::-1]), score


def align_pairs(pairs: DataFrame, gap_open: float = GAP_OPEN, gap_extend: float = GAP_EXTEND) -> DataFrame:
    """(pair_id, reference_id, target_id, reference_sequence, target_sequence) -> aligned_reference, aligned_target, score.

    Each distinct pair of sequences is aligned once. Empty or null sequences give nulls.
    """

    @F.pandas_udf("aligned_reference string, aligned_target string, score double")
    def run(reference: pd.Series, target: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([gotoh(a, b, gap_open, gap_extend) if a and b else (None, None, None) for a, b in zip(reference, target, strict=True)], columns=["aligned_reference", "aligned_target", "score"])

    key = ["reference_sequence", "target_sequence"]
    done = pairs.select(*key).dropna().distinct().withColumn("a", run(*key)).select(*key, "a.*")
    return pairs.join(done, key, "left").select("pair_id", "reference_id", "target_id", "aligned_reference", "aligned_target", "score")
