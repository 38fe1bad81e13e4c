"""Kernels for one pair of sequences: ungapped extension along diagonals, and gapped extension from a seed with a drop-off."""

from __future__ import annotations

import numpy as np

from foldline.functions.alphabet import MATRIX, RESIDUES, score_table

SCORES = np.array(score_table(MATRIX))
LOW = -(10**6)
NUMBER = np.full(256, 22, np.int64)
NUMBER[[ord(c) for c in RESIDUES]] = np.arange(len(RESIDUES))


def coded(seq: str) -> np.ndarray:
    """Residue numbers; other letters count as X."""
    return NUMBER[np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)]


def promising(query: np.ndarray, target: np.ndarray, diagonals: np.ndarray, least: int) -> np.ndarray:
    """Which diagonals (q - t) have a stretch of at least this score: without one no extension reaches it."""
    out = np.zeros(len(diagonals), bool)
    m, n = len(query), len(target)
    size = max(1, 2_000_000 // m)
    for at in range(0, len(diagonals), size):
        d = diagonals[at : at + size, None]
        t = np.arange(m)[None, :] - d
        inside = (t >= 0) & (t < n)
        cells = np.where(inside, SCORES[query[None, :], target[np.clip(t, 0, n - 1)]], 0)
        run = np.cumsum(cells, 1)
        below = np.minimum.accumulate(np.minimum(run, 0), 1)
        out[at : at + size] = np.maximum(run[:, 0], (run[:, 1:] - below[:, :-1]).max(1, initial=0)) >= least
    return out


def extended(cells: list[int], start: int, end: int, drop: int) -> tuple[int, int, int]:
    """(score, first, end) of a stretch of a diagonal's scores, grown on either side until it falls more than drop below the best."""
    score = sum(cells[start:end])
    best, first, last = score, start, end
    run = score
    for i in range(end, len(cells)):
        run += cells[i]
        if run > best:
            best, last = run, i + 1
        elif run < best - drop:
            break
    run = best
    for i in range(start - 1, -1, -1):
        run += cells[i]
        if run > best:
            best, first = run, i
        elif run < best - drop:
            break
    return best, first, last


def ungapped_hsps(query: np.ndarray, target: np.ndarray, diagonals: np.ndarray, places: np.ndarray, word: int, window: int, drop: int, least: int) -> list[tuple[int, int, int, int]]:
    """(q_start, q_end, t_start, t_end) of stretches that reach a score, in order of the seeds' places in the target; ends are behind the
    last letter. Seeds come sorted by diagonal and place in the query.

    On a diagonal, a seed that follows the last one seen, or the last extension's end, closer than the window and without
    overlap is extended from there; one beyond the window is the new last one."""
    kinds, begins = np.unique(diagonals, return_index=True)
    good = promising(query, target, kinds, least)
    ends = np.append(begins[1:], len(diagonals))
    out = []
    for d, a, b in zip(kinds[good].tolist(), begins[good].tolist(), ends[good].tolist()):
        low, high = max(0, d), min(len(query), len(target) + d)
        cells = SCORES[query[low:high], target[low - d : high - d]].tolist()
        last = -window
        for q in places[a:b].tolist():
            if q - last >= window:
                last = q
            elif q - last > word:
                score, first, end = extended(cells, last - low, q + word - low, drop)
                if score >= least:
                    out.append((q - d, q, first + low, end + low, first + low - d, end + low - d))
                last = end + low
    return [x[2:] for x in sorted(out)]


def extension(a: np.ndarray, b: np.ndarray, opening: int, extend: int, drop: int, trace: bool = False) -> tuple[int, int, int, list[tuple[int, np.ndarray]]]:
    """The best gapped extension along a and b: (score, letters of a, letters of b, ways).

    It begins with the first letters of both as a pair; without letters on one side it is empty. A row has a cell for each place in b of a band: from the first
    cell of the row before that is within `drop` of the best so far to where cells fall below that for good. ways has each row's band
    start and one byte a cell: 0 for a pair, 1 for a gap in b, -1 for a gap in a; pairs go before gaps.
    """
    m, n = len(a), len(b)
    if not m or not n:
        return 0, 0, 0, []
    reach = drop // max(extend, 1) + 2
    # The first row: a pair, then a gap in a.
    best, best_i, best_j = int(SCORES[a[0], b[0]]), 1, 1
    width = min(n, reach)
    cell = best - opening - extend * np.arange(-1, width - 1)
    cell[0] = best
    gap_b = np.full(width, LOW)  # runs along a
    gap_b[0] = best - opening
    low = 0
    ways = [(0, np.where(np.arange(width) == 0, 0, 10).astype(np.int8))] if trace else []
    steps = extend * np.arange(n + 1)
    for i in range(1, m):
        alive = cell >= best - drop
        first = int(alive.argmax())
        if not alive[first]:
            break
        stop = low + len(alive) - int(alive[::-1].argmax())
        start = low + first
        size = min(n, stop + reach) - start
        # Pairs come from the cell before, on the diagonal; gaps in b from the same place.
        many = min(stop - start, size - 1)
        pair = np.empty(size, np.int64)
        pair[0] = LOW
        pair[1 : 1 + many] = cell[first : first + many]
        pair[1 : 1 + many] += SCORES[a[i]].take(b[start + 1 : start + 1 + many])
        pair[1 + many :] = LOW
        down = np.empty(size, np.int64)
        down[: stop - start] = gap_b[first : stop - low]
        down[stop - start :] = LOW
        lift = pair + steps[:size]
        np.maximum.accumulate(lift, out=lift)
        right = np.empty(size, np.int64)
        right[0] = LOW
        right[1:] = lift[:-1]
        right[1:] -= steps[: size - 1] + opening
        row = np.maximum(pair, down)
        np.maximum(row, right, out=row)
        opened = pair - opening
        longer = down - extend
        if trace:
            kind = np.where(pair >= row, 0, np.where(down >= row, 1, 2))
            ways.append((start, (kind + 4 * (longer > opened) + 8 * (right - extend > opened)).astype(np.int8)))
        gap_b = np.maximum(opened, longer)
        j = int(row.argmax())
        if row[j] > best:
            best, best_i, best_j = int(row[j]), i + 1, start + j + 1
        cell, low = row, start
    return best, best_i, best_j, ways


def path(ways: list[tuple[int, np.ndarray]], i: int, j: int) -> list[int]:
    """The steps to the first i and j letters, from the first on: 0 a pair, 1 a letter of a alone, -1 one of b."""
    out, kind = [], None
    while i and j:
        low, cells = ways[i - 1]
        cell = int(cells[j - 1 - low])
        if kind is None:
            kind = cell & 3
        elif kind == 1:  # a gap that goes on behind this cell
            kind = cell >> 2 & 1
        else:
            kind = cell >> 2 & 2
        out.append((0, 1, -1)[kind])
        i, j = i - (kind != 2), j - (kind != 1)
        if kind == 0:
            kind = None
    return out[::-1]


def from_seed(query: np.ndarray, target: np.ndarray, q: int, t: int, opening: int, extend: int, drop: int) -> int:
    """The score of the gapped alignment through a pair of places."""
    after = extension(query[q + 1 :], target[t + 1 :], opening, extend, drop)[0]
    before = extension(query[:q][::-1], target[:t][::-1], opening, extend, drop)[0]
    return int(SCORES[query[q], target[t]]) + after + before


def traced(query: np.ndarray, target: np.ndarray, q: int, t: int, opening: int, extend: int, drop: int) -> tuple[int, int, int, int, int, list[int]]:
    """(score, q_start, q_end, t_start, t_end, steps) of that alignment; ends are behind the last letter."""
    after, ai, aj, ways = extension(query[q + 1 :], target[t + 1 :], opening, extend, drop, True)
    right = path(ways, ai, aj)
    before, bi, bj, ways = extension(query[:q][::-1], target[:t][::-1], opening, extend, drop, True)
    left = path(ways, bi, bj)[::-1]
    return int(SCORES[query[q], target[t]]) + after + before, q - bi, q + 1 + ai, t - bj, t + 1 + aj, [*left, 0, *right]
