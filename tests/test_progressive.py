"""The progressive alignment against loops, and what its rows, paths and columns have to agree on."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldline.functions import alphabet
from foldline.operators import gapped, msa

LETTERS = "ACDEFGHIKLMNPQRSTVWY"
P = alphabet.PAM250_SCORES


def sequence(rng, n):
    return "".join(rng.choice(LETTERS) for _ in range(n))


def edited(rng, seq, n):
    out = list(seq)
    for _ in range(n):
        at = rng.randrange(len(out))
        out[at : at + rng.randrange(3)] = [rng.choice(LETTERS) for _ in range(rng.randrange(4))]
    return "".join(out)


def slow_path(profile, seq):
    """The same table, a cell at a time."""
    m, n = len(profile.letters), len(seq)
    open_x, more_x, open_y, more_y = profile.costs(seq)
    total = profile.weights.sum(1)
    score = [[sum(P[a, alphabet.RESIDUES[y]] * profile.weights[x, k] for k, a in enumerate(alphabet.RESIDUES)) / total[x] for y in seq] for x in range(m)]
    cell, down, right, way = {}, {}, {}, {}
    best, at = 0.0, (0, 0)
    for x in range(m):
        for y in range(n):
            a, b = down.get((x - 1, y), 0.0), right.get((x, y - 1), 0.0)
            pair = score[x][y] + cell.get((x - 1, y - 1), 0.0)
            ox, oy = open_x[x] if x < m - 1 else 0.0, open_y[y] if y < n - 1 else 0.0
            if pair >= a and pair >= b:
                way[x, y], cell[x, y], down[x, y], right[x, y] = 0, pair, pair - ox, pair - oy
                if pair > best and profile.letters[x] >= 0:
                    best, at = pair, (x, y)
            elif a >= b:
                way[x, y], cell[x, y], down[x, y], right[x, y] = 1, a, a - more_x[x], max(pair - oy, b - more_y[y])
            else:
                way[x, y], cell[x, y], down[x, y], right[x, y] = -1, b, max(pair - ox, a - more_x[x]), b - more_y[y]
    out, (x, y) = [], at
    while best > 0 and x >= 0 and y >= 0 and cell[x, y] > 0:
        out.append((x, y, way[x, y]))
        x, y = x - (way[x, y] >= 0), y - (way[x, y] <= 0)
    return out


def test_paths_by_loops():
    rng = random.Random(3)
    for case in range(12):
        query = sequence(rng, rng.randrange(12, 40))
        profile = msa.Profile(query, "HHHHGGGG  TT" * 3)
        for k in range(6):
            hit = gapped.coded(edited(rng, query, rng.randrange(1, 7)) or "A")
            assert profile.path(hit) == slow_path(profile, hit), case
            profile.add(hit, rng.random() * 0.4)
        assert profile.entries or case


def family(rng, n):
    query = sequence(rng, 90)
    rows = [(1, query, k, edited(rng, query, rng.randrange(1, 8)), 0.0) for k in range(n)]
    rows += [(1, query, 500, sequence(rng, 90), 0.9), (1, query, 501, query[:30], 0.7), (1, query, 502, None, 0.5), (1, query, 503, "", None)]
    rows = [(q, s, h, t, d if d else 0.01 * (h % 37) + 0.001) if t else (q, s, h, t, d) for q, s, h, t, d in rows]
    other = sequence(rng, 40)
    return rows + [(2, other, 7, other, 0.0), (3, None, 8, other, 0.1)]


SCHEMA = "query_id long, query string, hit_id long, seq string, distance double"


def test_rows_agree_with_paths_and_columns(spark):
    rng = random.Random(8)
    rows = family(rng, 60)
    got = msa.progressive(spark.createDataFrame(rows, SCHEMA), 0).collect()
    by_query = defaultdict(dict)
    for r in got:
        by_query[r.query_id][r.hit_id] = r
    assert {k: len(v) for k, v in by_query.items()} == {1: 65, 2: 2, 3: 2}
    own, query = by_query[1], rows[0][1]
    whole = own[None].aligned
    accepted = {h: r for h, r in own.items() if r.accepted and h is not None}
    assert whole.replace(".", "") == query and len(accepted) > 10 and not {500, 501, 502, 503} & set(accepted)
    assert "." in whole and len(own[None].inserted) == len(own[None].deleted) == len(whole) and sum(own[None].deleted) > 0
    # Insertions are counted at the column before which they start, once a run and hit.
    assert all(n == 0 for n, c in zip(own[None].inserted, whole) if c == ".")
    texts = {h: t for q, _, h, t, _ in rows if q == 1}
    place = np.cumsum([c != "." for c in whole])
    for h, r in accepted.items():
        assert len(r.aligned) == len(whole)
        letters = r.aligned.replace(".", "")
        assert letters == texts[h][r.jfir - 1 : r.jlas]
        assert r.identical == sum(a == b for a, b in zip(r.aligned, whole) if a != ".")
        assert r.similar >= r.identical and r.identical >= r.length * (msa.curve(r.length) + 0.05)
        filled = [k for k, c in enumerate(r.aligned) if c != "."]
        assert (place[filled[0]], place[filled[-1]]) == (r.ifir, r.ilas)
        # What isn't opposite something counts as gaps: letters over inserted columns and columns passed over.
        span = range(filled[0], filled[-1] + 1)
        assert r.gapn == sum((r.aligned[k] != ".") != (whole[k] != ".") for k in span)
    assert by_query[2][7].aligned == by_query[2][None].aligned and by_query[3][8].aligned is None


def test_earlier_rows_stay(spark):
    """What the first hits fill doesn't depend on those that come later, which only add columns."""
    rng = random.Random(15)
    rows = [r for r in family(rng, 30) if r[0] == 1 and r[4] is not None]
    rows.sort(key=lambda r: (r[4], r[2]))
    full = {r.hit_id: r for r in msa.progressive(spark.createDataFrame(rows, SCHEMA), 0).collect()}
    part = {r.hit_id: r for r in msa.progressive(spark.createDataFrame(rows[:12], SCHEMA), 0).collect()}
    assert len(full[None].aligned) > len(part[None].aligned)
    for h, r in part.items():
        if h is None:
            continue
        assert r.accepted == full[h].accepted
        if r.accepted:
            at, short, long = 0, r.aligned, full[h].aligned
            assert short.replace(".", "") == long.replace(".", "") and (r.identical, r.gapn, r.ifir) == (full[h].identical, full[h].gapn, full[h].ifir)


def test_states_and_limit(spark):
    rng = random.Random(2)
    rows = family(rng, 40)
    df = spark.createDataFrame(rows, SCHEMA)
    plain = {(r.query_id, r.hit_id): r.aligned for r in msa.progressive(df, 0).collect()}
    helix = {(r.query_id, r.hit_id): r.aligned for r in msa.progressive(df.withColumn("states", F.expr("repeat('G', length(query))")), 0).collect()}
    assert plain.keys() == helix.keys() and plain != helix
    few = msa.progressive(df, 5).filter("query_id = 1 and accepted").collect()
    assert len(few) == 5 and {r.hit_id for r in few} <= {h for (q, h), a in plain.items() if a and q == 1} | {r.hit_id for r in few}


@pytest.mark.parametrize("n", [1, 3])
def test_nearly_nothing(spark, n):
    df = spark.createDataFrame([(1, "A" * n, 2, "A" * n, 0.0)], SCHEMA)
    assert {r.hit_id for r in msa.progressive(df).collect()} <= {2, None}
    assert msa.progressive(df.limit(0)).count() == 0
