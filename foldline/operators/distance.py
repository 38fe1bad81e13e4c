"""Global sequence distances: end-free affine alignment, one pair a row, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldline.functions.alphabet import PAM250_SCORES, RESIDUES, score_table

SCORES = np.array(score_table(PAM250_SCORES), float)
OPEN, EXTEND = 10.0, 0.2


def numbers(seq: str) -> np.ndarray:
    return np.array([max(RESIDUES.find(c), 0) if c in RESIDUES else 22 for c in seq], np.int64)


def identical(a: str, b: str) -> int:
    """Equal letters on the best alignment, ends free.

    The table is filled by anti-diagonals; each cell carries the number of equal letters on the way
    to it. Matching goes before a gap in b, that before a gap in a.
    """
    x, y = numbers(a), numbers(b)
    m, n = len(x), len(y)
    if not m or not n:
        return 0
    low = -1e9
    # Indexed by i; best, gap in b (moves along a) and gap in a, of the last two diagonals.
    s1, s2 = np.zeros(m + 1), np.zeros(m + 1)
    k1, k2 = np.zeros(m + 1, int), np.zeros(m + 1, int)
    d1, d1k, r1, r1k = np.full(m + 1, low), np.zeros(m + 1, int), np.full(m + 1, low), np.zeros(m + 1, int)
    top, best = low, 0
    for t in range(2, m + n + 1):
        i = np.arange(max(1, t - n), min(m, t - 1) + 1)
        j = t - i
        same = x[i - 1] == y[j - 1]
        match, match_k = s2[i - 1] + SCORES[x[i - 1], y[j - 1]], k2[i - 1] + same
        down_new = s1[i - 1] - OPEN >= d1[i - 1] - EXTEND
        down, down_k = np.where(down_new, s1[i - 1] - OPEN, d1[i - 1] - EXTEND), np.where(down_new, k1[i - 1], d1k[i - 1])
        right_new = s1[i] - OPEN >= r1[i] - EXTEND
        right, right_k = np.where(right_new, s1[i] - OPEN, r1[i] - EXTEND), np.where(right_new, k1[i], r1k[i])
        use_m = (match >= down) & (match >= right)
        use_d = ~use_m & (down >= right)
        cell, cell_k = np.where(use_m, match, np.where(use_d, down, right)), np.where(use_m, match_k, np.where(use_d, down_k, right_k))
        edge = (i == m) | (j == n)
        if edge.any():
            e = int(np.argmax(np.where(edge, cell, low)))
            if cell[e] > top:
                top, best = float(cell[e]), int(cell_k[e])
        s2, k2 = s1, k1
        s1, k1 = np.zeros(m + 1), np.zeros(m + 1, int)
        d1, d1k, r1, r1k = np.full(m + 1, low), np.zeros(m + 1, int), np.full(m + 1, low), np.zeros(m + 1, int)
        s1[i], k1[i], d1[i], d1k[i], r1[i], r1k[i] = cell, cell_k, down, down_k, right, right_k
    return best


@F.pandas_udf(T.DoubleType())
def sequence_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """1 - equal letters / longer length; 0 for equal sequences, null where either is null."""

    def one(s, t):
        if s is None or t is None:
            return None
        return 0.0 if s == t else 1 - identical(s, t) / max(len(s), len(t), 1)

    return pd.Series([one(s, t) for s, t in zip(a, b)], dtype="float64")


def _crc_table() -> list[int]:
    out = []
    for v in range(256):
        for _ in range(8):
            v = v >> 1 ^ (0xD800000000000000 if v & 1 else 0)
        out.append(v)
    return out


CRC_TABLE = _crc_table()


@F.pandas_udf(T.StringType())
def crc64(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The ISO 64-bit checksum as 16 hexadecimal digits."""
    for t in texts:
        out = []
        for s in t:
            v = 0
            for byte in (s or "").encode():
                v = CRC_TABLE[(v ^ byte) & 0xFF] ^ v >> 8
            out.append(f"{v:016X}")
        yield pd.Series(out)
