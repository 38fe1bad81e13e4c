"""Databank search against plain Python: words, seeds, extensions, alignments, databanks."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldline.functions import alphabet
from foldline.operators import gapped, search, seeds

LETTERS = "ACDEFGHIKLMNPQRSTVWY"
M = alphabet.MATRIX


def sequence(rng, n, letters=LETTERS):
    return "".join(rng.choice(letters) for _ in range(n))


def edited(rng, seq, n):
    out = list(seq)
    for _ in range(n):
        at = rng.randrange(len(out))
        out[at : at + rng.randrange(3)] = [rng.choice(LETTERS) for _ in range(rng.randrange(3))]
    return "".join(out)


def slow_extension(a, b, opening, extend):
    """The best path from the pair of first letters on, over the whole table, a cell at a time."""
    low = -(10**9)
    pair, down, right = {}, {}, {}
    best = low
    for i in range(len(a)):
        for j in range(len(b)):
            ends = max(d.get((i - 1, j - 1), low) for d in (pair, down, right)) if i and j else 0 if not i and not j else low
            pair[i, j] = ends + M[a[i], b[j]]
            down[i, j] = max(pair.get((i - 1, j), low) - opening, down.get((i - 1, j), low) - extend)
            right[i, j] = max(pair.get((i, j - 1), low) - opening, right.get((i, j - 1), low) - extend)
            best = max(best, pair[i, j], down[i, j], right[i, j])
    return best


def slow_drop(a, b, opening, extend, drop):
    """The same, but only from cells within `drop` of the best of the rows so far on, between the first and last of a row."""
    low = -(10**9)
    best, row = low, {}
    first, last = 0, 0
    for i in range(len(a)):
        new, right = {}, low
        for j in range(len(b)):
            cell = lambda x: row.get(x, (low, low, low)) if first <= x <= last else (low, low, low)
            pair = (max(cell(j - 1)) if i and j else 0 if not i and not j else low) + M[a[i], b[j]]
            down = max(cell(j)[0] - opening, cell(j)[1] - extend)
            right = max(new.get(j - 1, (low, low, low))[0] - opening, right - extend)
            new[j] = (pair, down, right)
        best = max(best, max(max(v) for v in new.values()))
        alive = [j for j, v in new.items() if max(v) >= best - drop]
        if not alive:
            return best
        row, first, last = new, alive[0], alive[-1]
    return best


def rescored(a, b, steps, opening, extend):
    total, i, j, before = 0, 0, 0, 0
    for step in steps:
        total += M[a[i], b[j]] if step == 0 else -extend if step == before else -opening
        i, j, before = i + (step >= 0), j + (step <= 0), step
    return total, i, j


def test_extension_equals_full_tables():
    rng = random.Random(5)
    for case in range(60):
        a = sequence(rng, rng.randrange(1, 45))
        b = edited(rng, a, rng.randrange(8)) or "A"
        x, y = gapped.coded(a), gapped.coded(b)
        score, i, j, ways = gapped.extension(x, y, 12, 1, 10_000, True)
        assert score == slow_extension(a, b, 12, 1)
        steps = gapped.path(ways, i, j)
        assert len(steps) and steps[0] == 0 and rescored(a, b, steps, 12, 1) == (score, i, j)
        for drop in (0, 3, 9, 20):
            assert gapped.extension(x, y, 12, 1, drop)[0] == slow_drop(a, b, 12, 1, drop), (a, b, drop)
    assert gapped.extension(gapped.coded(""), gapped.coded("A"), 12, 1, 9) == (0, 0, 0, [])


def test_drop_bounds_the_band():
    """Two long sequences take memory for a band, not a table; the score is that of the whole table near the diagonal."""
    rng = random.Random(9)
    a = sequence(rng, 6000)
    x, y = gapped.coded(a), gapped.coded(edited(rng, a, 60))
    score, i, j, ways = gapped.extension(x, y, 12, 1, 64, True)
    assert i > 5900 and sum(len(w) for _, w in ways) < 6000 * 300
    steps = gapped.path(ways, i, j)
    assert rescored(a, "".join(alphabet.RESIDUES[c] for c in y), steps, 12, 1)[0] == score


def test_through_the_seed():
    rng = random.Random(11)
    a = sequence(rng, 80)
    b = sequence(rng, 11) + a[:40] + "WW" + a[40:] + sequence(rng, 5)
    q, t = 20, 31
    score, q_start, q_end, t_start, t_end, steps = gapped.traced(gapped.coded(a), gapped.coded(b), q, t, 12, 1, 64)
    assert score == gapped.from_seed(gapped.coded(a), gapped.coded(b), q, t, 12, 1, 64)
    total, i, j = rescored(a[q_start:], b[t_start:], steps, 12, 1)
    assert (total, q_start + i, t_start + j) == (score, q_end, t_end) and q_start <= 20 and q_end >= 78


def test_ungapped_and_promising():
    rng = random.Random(3)
    for _ in range(40):
        cells = [rng.randrange(-4, 6) - 1 for _ in range(50)]
        start = rng.randrange(45)
        got = gapped.extended(cells, start, start + 4, 10)

        def way(run):
            total = best = n = 0
            for k, c in enumerate(run):
                total += c
                if total > best:
                    best, n = total, k + 1
                if total < best - 10:
                    break
            return best, n

        (right, n), (left, m) = way(cells[start + 4 :]), way(cells[:start][::-1])
        assert got == (sum(cells[start : start + 4]) + right + left, start - m, start + 4 + n)
    a, b = sequence(rng, 60), sequence(rng, 90)
    b = b[:30] + a[10:30] + b[50:]
    x, y = gapped.coded(a), gapped.coded(b)
    d = np.arange(-89, 60)
    best = [max(sum(M[a[k], b[k - e]] for k in range(i, j)) for i in range(max(0, e), min(60, 90 + e)) for j in range(i + 1, min(60, 90 + e) + 1)) for e in d.tolist()]
    assert (gapped.promising(x, y, d, 41) == (np.array(best) >= 41)).all() and gapped.promising(x, y, d, 41).any()


def seeds_by_hand(queries, bank):
    out = set()
    for k, a in queries:
        for t, b in bank:
            for q in range(len(a) - 2):
                out |= {(k, t, q, p) for p in range(len(b) - 2) if "X" not in b[p : p + 3] and sum(M[a[q + x], b[p + x]] for x in range(3)) >= 11}
    return out


def test_seeds_by_hand(spark):
    rng = random.Random(6)
    queries = [(k, sequence(rng, n, "ACDEFWX")) for k, n in enumerate((30, 18, 3, 2, 25))]
    bank = [(k, sequence(rng, n, "ACDEFWXB")) for k, n in enumerate((60, 50, 2, 0, 40))] + [(9, None)]
    q, b = (spark.createDataFrame(rows, "id long, seq string") for rows in (queries, bank))
    want = seeds_by_hand(queries, [x for x in bank if x[1]])
    for letters in (None, 80):  # shuffled by salted words, and broadcast
        found = seeds.second_hits(seeds.seeds(q, seeds.word_index(b), letters)).collect()
        assert Counter((r.query_id, r.target_id, r.q, r.t) for r in found) == Counter(want) and len(want) > 100
        second = {(k, t, i, p) for k, t, i, p in want if any((k, t, i - x, p - x) in want for x in range(4, 40))}
        assert {(r.query_id, r.target_id, r.q, r.t) for r in found if r.second} == second
    lists = {(r.query_id, r.target_id): list(zip(r.diagonals, r.places, r.second)) for r in seeds.pair_seeds(seeds.seeds(q, seeds.word_index(b), 80)).collect()}
    pairs = {(k, t) for k, t, _, _ in second}
    expected = defaultdict(list)
    for k, t, i, p in sorted(want, key=lambda s: (s[2] - s[3], s[2])):
        if (k, t) in pairs:
            expected[k, t].append((i - p, i, (k, t, i, p) in second))
    assert lists == dict(expected)


def test_index_by_bucket(spark, tmp_path):
    rng = random.Random(8)
    bank = spark.createDataFrame([(k, sequence(rng, 50)) for k in range(30)], "id long, seq string")
    spark.sql("create database if not exists words_db location '" + str(tmp_path / "db") + "'")
    try:
        index = seeds.write_word_index(bank, "words_db.word_index", 8)
        assert Counter(map(tuple, index.collect())) == Counter(map(tuple, seeds.word_index(bank).collect()))
        plan = index.groupBy("word").count()._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan  # dealt by word already
    finally:
        spark.sql("drop database words_db cascade")


def slow_search(query, target):
    """Parts of one pair as defined, by loops: seeds, diagonals, stretches, gapped scores of their middles."""
    hits = sorted({(q, p) for _, _, q, p in seeds_by_hand([(0, query)], [(0, target)])}, key=lambda s: (s[1], s[0]))
    last, boxes = {}, []
    for q, p in hits:
        d = q - p
        at = last.get(d, -40)
        if q - at >= 40:
            last[d] = q
        elif q - at > 3:
            low, high = max(0, d), min(len(query), len(target) + d)
            cells = [M[query[k], target[k - d]] for k in range(low, high)]
            score, first, end = gapped.extended(cells, at - low, q + 3 - low, 16)
            if score >= 41:
                boxes.append((first + low, end + low, first + low - d, end + low - d))
            last[d] = end + low
    return boxes


def test_search_by_hand(spark):
    rng = random.Random(7)
    query = sequence(rng, 120)
    targets = {1: query, 2: query[:50] + "G" + query[53:], 3: sequence(rng, 150), 6: sequence(rng, 40) + query[70:] + sequence(rng, 60) + query[:60], 4: "", 5: "AC", 7: edited(rng, query, 12)}
    q = spark.createDataFrame([(1, query)], "id long, seq string")
    bank = spark.createDataFrame(list(targets.items()), "id long, seq string")
    got = defaultdict(list)
    for r in sorted(search.search(q, bank, masked=False).collect(), key=lambda r: r.nr):
        got[r.target_id].append(r)
    assert {1, 2, 6, 7} <= set(got) and not {3, 4, 5} & set(got) and len(got[6]) == 2
    assert got[1][0].score == sum(M[c, c] for c in query) and got[1][0].identical == 120
    for t, rows in got.items():
        boxes = slow_search(query, targets[t])
        x, y = gapped.coded(query), gapped.coded(targets[t])
        final = sorted((gapped.traced(x, y, (a + b) // 2, (c + d) // 2, 12, 1, 64)[0] for a, b, c, d in boxes), reverse=True)
        assert rows[0].score == final[0]
        for r in rows:
            assert len(r.aligned_query) == len(r.aligned_target) and r.aligned_query.replace("-", "") == query[r.q_start - 1 : r.q_end] and r.aligned_target.replace("-", "") == targets[t][r.t_start - 1 : r.t_end]
            assert r.bits == math.floor((0.267 * r.score - math.log(0.041)) / math.log(2))
            assert r.identical == sum(a == b for a, b in zip(r.aligned_query, r.aligned_target))


def test_ungapped_stages_agree(spark):
    rng = random.Random(21)
    for _ in range(5):
        a = sequence(rng, 90)
        b = sequence(rng, 20) + edited(rng, a, 9) + sequence(rng, 30)
        x, y = gapped.coded(a), gapped.coded(b)
        hits = sorted((q - p, q) for _, _, q, p in seeds_by_hand([(0, a)], [(0, b)]))
        got = gapped.ungapped_hsps(x, y, np.array([h[0] for h in hits]), np.array([h[1] for h in hits]), 3, 40, 16, 41)
        assert got == slow_search(a, b)


def test_databanks_and_limit(spark):
    rng = random.Random(13)
    query = sequence(rng, 100)
    q = spark.createDataFrame([(5, query), (6, None), (7, "")], "id long, seq string")
    one = spark.createDataFrame([(k, edited(rng, query, 3 * k)) for k in range(1, 6)] + [(8, None)], "id long, seq string")
    two = spark.createDataFrame([(1, query), (2, sequence(rng, 300))], "id long, seq string")
    both = {(r.databank, r.target_id): r for r in search.search(q, one, two, masked=False).collect() if r.nr == 1}
    assert (1, 1) in both and (0, 1) in both and (1, 2) not in both
    # Expectations are of all letters and sequences together.
    union = one.unionByName(two.select(F.col("id") + 100, "seq").toDF("id", "seq"))
    single = {r.target_id: r for r in search.search(q, union, masked=False).collect() if r.nr == 1}
    assert {(r.score, r.expect) for r in both.values()} == {(r.score, r.expect) for r in single.values()}
    best = search.search(q, one, two, masked=False, most=2).filter("nr = 1").collect()
    assert sorted((r.score for r in best), reverse=True) == sorted((r.score for r in both.values()), reverse=True)[:2]
    bank = one.select(F.struct(F.lit(0).alias("databank"), "id").alias("id"), "seq").unionByName(two.select(F.struct(F.lit(1).alias("databank"), "id").alias("id"), "seq"))
    stored = seeds.word_index(bank)
    assert {(r.databank, r.target_id) for r in search.search(q, one, two, masked=False, index=stored).collect()} == set(both)
    assert search.search(q, one.limit(0)).count() == 0 and search.search(q.limit(0), one).count() == 0


def test_first_rows_in_parts(spark):
    rng = random.Random(4)
    rows = [(rng.choice("aab"), k, rng.randrange(40)) for k in range(600)]
    df = spark.createDataFrame(rows, "g string, id int, v int")
    got = {(r.g, r.id) for r in search.first_rows(df, "g", [F.desc("v"), "id"], 25, "id").collect()}
    assert got == {(g, k) for x in "ab" for g, k, _ in sorted((r for r in rows if r[0] == x), key=lambda r: (-r[2], r[1]))[:25]}
