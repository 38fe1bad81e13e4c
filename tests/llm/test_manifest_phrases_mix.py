"""The Merkle manifest, phrase collocations and the mix of sources against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foldline.llm import collocations, merkle, mixing
from foldline.llm.ordering import ordered

DOCS = "doc_id long, text string, lang string, source string, n_chars int, path string, idx int, size int, rank int"


def put(spark, rows, tmp_path):
    """A documents table with extra columns whose names clash with those used inside."""
    spark.createDataFrame([(*r, "p", 1, 2, 3) for r in rows], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def corpus(rng, n):
    langs, vocabulary = ["en", "de", "É", "", None], ["Aa", "b", "cC", "d", "é", "the", "of", "x y"]
    out = []
    for i in range(n):
        text = None if i % 23 == 0 else "" if i % 29 == 0 else "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ", "]) for _ in range(rng.randrange(1, 60)))
        out.append((i * 3, text, "en" if i % 3 else rng.choice(langs), None if i % 9 == 0 else f"s{i % 5}" if i % 2 else "hot", None if i % 17 == 0 else i))
    return out


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def tree(digests):
    """Root of a list of digests, and for each the (left, right) of its levels."""
    paths, at, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        runs = [level[i : i + 8] for i in range(0, len(level), 8)]
        for k, place in enumerate(at):
            run, own = runs[place // 8], place % 8
            paths[k].append(("".join(run[:own]), "".join(run[own + 1 :])))
        level, at = [h(*run) for run in runs], [place // 8 for place in at]
    return level[0], paths


def merkle_by_hand(rows):
    def leaf(r, text):
        return h(*map(field, (r[0], r[3], r[2], r[4], text)))

    groups = defaultdict(list)
    for r in rows:
        small = r[1] and re.sub("[A-Z]", lambda m: m[0].lower(), r[1])
        other = leaf(r, small) if zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 3 == 0 else None
        groups[r[2]].append((r[0], leaf(r, r[1]), other))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = tree([x[1] for x in groups[g]])
    root, upper = tree([trees[g][0] for g in order])
    out = []
    for g, up in zip(order, upper):
        for (doc, own, other), path in zip(groups[g], trees[g][1]):
            node = other or own
            for left, right in [*path, *up]:
                node = h(left, node, right)
            out.append((doc, own, trees[g][0], root, h(*[x for pair in [*path, *up] for x in pair]), node, node == root))
    return out


@pytest.mark.parametrize("n", [1, 8, 9, 300])
def test_manifest_by_hand(spark, tmp_path, n):
    rows = corpus(random.Random(n), n)
    if n == 300:
        rows += [rows[5], rows[5], (None, "Null", "en", None, None), (None, "nuLL", None, "s", 1), (None, "Null", "en", None, None)]
    got = merkle.op11(spark, put(spark, rows, tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = merkle_by_hand(rows)
    assert Counter(map(tuple, got.collect())) == Counter(want)
    if n == 300:
        assert len({r[-1] for r in want}) == 2  # some proofs fail, some of the tampered texts are the same in small letters


def test_manifest_of_nothing_and_of_other_columns(spark, tmp_path):
    assert merkle.op11(spark, put(spark, [], tmp_path)).count() == 0
    leaves = spark.createDataFrame([(k, "a", f"{k:064x}", k, "r", "p") for k in range(20)], "id int, of string, d string, idx int, root string, path string")
    got = merkle.manifest(leaves, "id", "of", "d", fan_out=3).collect()
    assert {r["row"]["idx"] for r in got} == set(range(20)) and len({r["root"] for r in got}) == 1
    assert all(len(r["path"]) == 3 for r in got)


def test_running_sums_of_one_group_over_many_ranges(spark):
    rng = random.Random(5)
    rows = [(f"g{rng.random() < 0.2}", rng.randrange(50), rng.randrange(9)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "g string, k int, v long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ordered(df, "g", [F.col("k")], "v").collect()
        places = ordered(df, "g", [F.col("k")]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for g in ("gTrue", "gFalse"):
        own = sorted((r["before"], r["k"], r["v"]) for r in got if r["g"] == g)
        total = 0
        for before, _, v in sorted(own, key=lambda x: (x[1], x[0])):
            assert before <= total
            total += v
        assert total == sum(r[2] for r in rows if r[0] == g)
        assert sorted(r["before"] for r in places if r["g"] == g) == list(range(len(own)))
        by_place = [r["k"] for r in sorted((r for r in places if r["g"] == g), key=lambda r: r["before"])]
        assert by_place == sorted(by_place)


def phrases_by_hand(rows, least=10, top=2000, most=3):
    counts, totals = defaultdict(Counter), Counter()
    for r in rows:
        lang = "und" if r[2] is None else r[2]
        text = re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            words = re.findall(r"[^ \t]+", piece)
            totals[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, most + 1):
                    if i + k <= len(words):
                        counts[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        cands = {p: a for p, a in f.items() if len(p) >= 2 and a >= least}
        found = []
        for p, a in cands.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cands.items()):
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, totals[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return out


def test_phrases_by_hand(spark, tmp_path):
    rng = random.Random(3)
    rows = corpus(rng, 250) + [(1, "San Francisco bay area " * 30, "en", "s", 1)] * 3 + [(2, "q w e r " * 500, None, None, None)]
    got = collocations.op12(spark, put(spark, rows, tmp_path))
    want = phrases_by_hand(rows)
    assert len(want) > 40 and sorted(map(tuple, got.collect())) == sorted(want)
    assert dict(got.dtypes)["score"] == dict(got.dtypes)["rank"] == "bigint"


def test_phrases_of_nothing(spark, tmp_path):
    assert collocations.op12(spark, put(spark, [(1, None, None, None, None), (2, "", "en", None, None), (3, "one two", "en", None, 1)], tmp_path)).count() == 0
    assert collocations.op12(spark, put(spark, [], tmp_path / "e")).count() == 0


def test_longer_phrases_small_bitmap_and_small_shards(spark, tmp_path, monkeypatch):
    """Four words; a bitmap that is nearly full and automata that cut texts anywhere change nothing."""
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("abcdef") for _ in range(200)), "en", "s", 1) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n int")
    for name, value in (("MAP_BITS", 15), ("SHARD_WORDS", 37), ("SHARD_BYTES", 500)):
        monkeypatch.setattr(collocations, name, value)
    got = {(r["lang"], r["phrase"]): r["n"] for r in collocations.counts(df, "text", "lang", 3, 4).collect()}
    want = Counter()
    for r in rows:
        words = r[1].split()
        want.update({("en", " ".join(words[i : i + k])): 0 for i in range(200) for k in range(1, 5)})
        for i in range(200):
            for k in range(1, 5):
                if i + k <= 200:
                    want["en", " ".join(words[i : i + k])] += 1
    want = {k: n for k, n in want.items() if n >= 3} | {("en", ""): 2400}
    assert got == want
    scored = {r["phrase"] for r in collocations.scored(spark.createDataFrame([(a, p, len(p.split()), n) for (a, p), n in want.items()], "lang string, phrase string, words int, n long")).collect()}
    assert scored == {r[2] for r in phrases_by_hand([(0, r[1], "en") for r in rows], 3, 10**6, 4)}


def test_exact_products(spark):
    big = 3 * 10**12 + 7
    known = spark.createDataFrame([("en", "", 0, 9 * big), ("en", "a", 1, big + 2), ("en", "b", 1, big + 5), ("en", "a b", 2, big)], "lang string, phrase string, words int, n long")
    assert collocations.scored(known).first()["score"] == 10**6 * big * big // ((big + 2) * (big + 5)) == 999999


def test_automaton_states(spark):
    """Counts of all phrases against loops; phrases of a state have the same ends, and links go to the longest suffix with others."""
    rng = np.random.default_rng(4)
    words, pieces = rng.integers(1, 4, 300), np.sort(rng.integers(0, 40, 300))
    automaton = collocations.SuffixAutomaton(words, pieces, 3)
    ends = defaultdict(set)
    for i in range(300):
        for k in range(1, 4):
            if i - k + 1 >= 0 and pieces[i - k + 1] == pieces[i]:
                ends[tuple(words[i - k + 1 : i + 1].tolist())].add(i)
    for k in range(1, 4):
        at, n = automaton.phrases(k)
        assert {tuple(words[e - k + 1 : e + 1].tolist()): c for e, c in zip(at.tolist(), n.tolist())} == {p: len(x) for p, x in ends.items() if len(p) == k}
    assert len({frozenset(x) for x in ends.values()}) == len(automaton.count)
    for s, link in enumerate(automaton.link.tolist()):
        p = tuple(words[automaton.end[s] - automaton.longest[s] + 1 : automaton.end[s] + 1].tolist())
        assert all(ends[p[-k:]] == ends[p] for k in range(automaton.shortest[s], len(p) + 1))
        assert (link == -1) == (automaton.shortest[s] == 1)
        if link >= 0:
            assert automaton.longest[link] == automaton.shortest[s] - 1 and ends[p[-automaton.longest[link] :]] > ends[p]


def test_words_and_shards():
    words, piece = collocations.words_of(pa.array(["A\tb  c. D\x0be", "", " , ", "f"], pa.large_string()))
    assert words.to_pylist() == ["a", "b", "c", " d", "e", "f"]
    assert [piece.tolist().index(p) for p in piece.tolist()] == [0, 0, 0, 3, 4, 5]
    batch = pa.RecordBatch.from_arrays([pa.array(["x", None, "x", "y"] * 50), pa.array(["ab", None, "c" * 900, "d"] * 50)], ["lang", "text"])
    found = Counter()
    for lang, texts in collocations._shards(iter([batch, batch])):
        found.update((lang, t) for t in texts.to_pylist())
    assert found == {("x", "ab"): 100, ("x", "c" * 900): 100, ("y", "d"): 100}


def filled_by_hand(sizes, weights, share=1.5, most=2.0):
    total, stopped = share * sum(sizes), set()
    while True:
        left = total - sum(most * sizes[i] for i in stopped)
        weight = sum(w for i, w in enumerate(weights) if i not in stopped)
        shares = [most * s if i in stopped else weights[i] * left / weight if weight else 0.0 for i, s in enumerate(sizes)]
        over = {i for i, s in enumerate(sizes) if i not in stopped and shares[i] > most * s}
        if not over:
            return shares
        stopped |= over


def test_water_filling_against_rounds(spark):
    rng = random.Random(2)
    for case in range(6):
        sizes = [rng.choice([0, 1, 5, 50, 1000, 10**6]) * rng.randrange(1, 9) for _ in range(rng.randrange(1, 12))]
        df = spark.createDataFrame([(f"s{i:02d}", s) for i, s in enumerate(sizes)], "source string, source_size long")
        got = {r["source"]: r["target"] for r in mixing.water_filled(mixing.cyclic_weights(df), 1.5, 2.0).collect()}
        want = filled_by_hand(sizes, [[3, 1, 2][i % 3] for i in range(len(sizes))])
        assert [got[f"s{i:02d}"] for i in range(len(sizes))] == pytest.approx(want), case


def test_mix(spark, tmp_path):
    rows = corpus(random.Random(6), 900)
    rows += [(5000 + i, "word " * 9, "en", "hot", 1) for i in range(300)] + [rows[7]] * 4 + [(None, "a b", "en", "s1", 1)] * 3
    rows += [(9000, "long " * 30_000, "en", "s2", 1), (9001, None, "en", "none", 1)]
    d = put(spark, rows, tmp_path)
    got = mixing.op13(spark, d).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.op13(spark, d).collect()), key=repr)
    size = {(r[0], r[1]): len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], size[r[0], r[1]]) for r in rows)
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(size[r[0], r[1]] for r in rows if r[3] == s) for s in sources]
    targets = filled_by_hand(sizes, [[3, 1, 2][i % 3] for i in range(len(sources))])
    assert sum(t == 2 * s for s, t in zip(sizes, targets)) >= 2
    # The rows of a source are known by its size and target.
    for s, n, target in zip(sources, sizes, targets):
        own = [r for r in got if r["source_size"] == n and r["target"] == pytest.approx(target)]
        assert len(own) == sum(r[3] == s for r in rows)
        largest = max(r["size"] for r in own)
        assert abs(sum(r["taken"] for r in own) - target) <= largest / 2 + 1e-6
        assert all(r["taken"] <= 2 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0) for r in own)
    assert {r["taken"] for r in mixing.op13(spark, put(spark, [(1, None, None, None, None)], tmp_path / "one")).collect()} == {0}
    assert mixing.op13(spark, put(spark, [], tmp_path / "none")).count() == 0
