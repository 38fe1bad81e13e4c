"""Operators over whole corpora: shards, models, joins, the pipeline."""

import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from foldline.llm import components, decontamination, jaccard, lm, quality, sharding, toxicity

pipeline = pytest.importorskip("corpus_pipeline")


def words(rng, n, size=400):
    return [f"w{int(rng.paretovariate(0.7)) % size}" for _ in range(n)]


def plain(rng, n):
    """A third are the same few words, as in prose."""
    return [f"the{rng.randrange(9)}" if rng.random() < 0.33 else f"w{rng.randrange(3000)}" for _ in range(n)]


def test_templates_that_do_not_link_share_no_block(spark):
    """24 equal words and two own ones: any two texts have a similarity of about 0.7, below 0.8. And the same with texts that do link."""
    template = [f"t{i}" for i in range(24)]

    def texts(n, own):
        out = []
        for k in range(n):
            words = list(template)
            for j in range(own):
                words.insert(12, f"own{k}x{j}") if own == 2 else words.append(f"own{k}")
            out.append((k, " ".join(words)))
        return spark.createDataFrame(out, "doc_id long, text string")

    def keyed(df):
        common = jaccard.common_shingles(jaccard.outlines(df, 5).filter("times is not null").select("shingle", "times"))
        return jaccard.signatures(8, 10, 5, common, spark)(df.select(F.col("doc_id").alias("node"), "text"))

    far, near = texts(6000, 2), texts(500, 1)
    a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (r.text.split() for r in far.limit(2).collect()))
    assert 0.5 < len(a & b) / len(a | b) < 0.8
    assert jaccard.blocks_of(keyed(far), 8, 10).count() == 0
    assert jaccard.jaccard_components(far, 5, 8, 10).filter("doc_id <> component_id").count() == 0
    assert {r.component_id for r in jaccard.jaccard_components(near, 5, 8, 10).collect()} == {0}


def test_store_keeps_rows_and_merges(spark, tmp_path):
    schema = "doc_id long, text string, path string"
    df = spark.createDataFrame([(i, None if i % 7 == 0 else f"t{i % 5}", "p") for i in range(200)] + [(None, None, None), (1, "t1", "p")], schema)
    store = sharding.ShardStore(spark, str(tmp_path / "s"), df.schema, target_bytes=1 << 20)
    assert store.version() == 0 and store.read().count() == 0
    first = store.append(df, F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(9)))
    before = store.manifest()
    assert before.select("run").distinct().count() == 9 and before.agg(F.sum("rows")).first()[0] == 202
    want = Counter(map(tuple, df.collect()))
    last = store.compact()
    assert last > first and store.manifest().select("run").distinct().count() < 9
    assert Counter(map(tuple, store.read().select(*df.columns).collect())) == want
    assert Counter(map(tuple, store.read(last).select(*df.columns).collect())) == want
    assert not store._commit(last - 1, store.manifest())  # that version is taken
    assert store.append(df.limit(0), F.lit(0)) == last + 1 and store.read().count() == 202
    with pytest.raises(ValueError):
        sharding.ShardStore(spark, str(tmp_path / "t"), spark.createDataFrame([], "run int").schema)


def test_readers_of_a_superseded_version_can_finish(spark, tmp_path):
    import time

    df = spark.createDataFrame([(i, "x" * 50, i, "t") for i in range(120)], "doc_id long, text string, path int, bytes string")
    store = sharding.ShardStore(spark, str(tmp_path / "s"), df.schema, target_bytes=1 << 14, grace_s=4.0)
    first = store.append(df, F.pmod("doc_id", F.lit(8)))
    time.sleep(4.5)  # the version is older than the grace time, but still the newest
    reader = store.read(first)
    store.append(df.limit(0), F.lit(0))
    last = store.compact()
    assert last == first + 2
    store.expire()
    assert reader.count() == 120 and {r["doc_id"] for r in reader.collect()} == set(range(120))
    time.sleep(4.5)
    store.append(df, F.lit(0))
    store.expire()
    assert first not in store._versions() and store.read().count() == 240 and store.read(last).count() == 120
    with pytest.raises(Exception):
        reader.collect()


def test_store_survives_dead_and_concurrent_writers(spark, tmp_path):
    df = spark.createDataFrame([(i, "x" * 500) for i in range(300)], "doc_id long, text string")
    store = sharding.ShardStore(spark, str(tmp_path / "a b"), df.schema, target_bytes=1 << 14, grace_s=1.0)
    store.append(df, F.pmod("doc_id", F.lit(4)))
    (tmp_path / "a b" / "manifest" / "v000000000002").write_text("m-half")  # a writer died here
    assert store.version() == 1 and store.read().count() == 300
    assert store.append(df, F.lit(0)) == 2 and store.read().count() == 600
    # Another writer's run, written but not committed, and one that appends while this one merges.
    df.write.parquet(str(tmp_path / "a b" / "t0" / "other-0"))
    other, commit = sharding.ShardStore(spark, store.path, df.schema, grace_s=1.0), store._commit

    def late(base, entries):
        store._commit = commit
        other.append(df, F.lit(0))
        return commit(base, entries)

    store._commit = late
    store.compact()
    store.grace_s = 0.0
    store.append(df.limit(0), F.lit(0))
    store.append(df.limit(0), F.lit(0))
    store.expire()
    assert (tmp_path / "a b" / "t0" / "other-0").exists() and store.read().count() == 900 and other.read().count() == 900
    assert len(store._versions()) == 2 and store.read(store.version() - 1).count() == 900
    df.write.mode("append").parquet(str(tmp_path / "a b" / store.manifest().first()["run"]))  # a stray file isn't read
    assert store.read().count() == 900
    sizes = [r.bytes for r in store.manifest().collect()]
    assert max(sizes) < 2 * (1 << 14)
    for name in ("arrival", "Tier"):
        with pytest.raises(ValueError):
            sharding.ShardStore(spark, str(tmp_path / "t"), spark.createDataFrame([], f"{name} int").schema)
    gone = sharding.ShardStore(spark, str(tmp_path / "n"), df.schema, tries=2)
    gone._commit = lambda base, entries: False
    with pytest.raises(RuntimeError):
        gone.append(df, F.lit(0))


def test_op2(spark, sf):
    got = sharding.op2(spark, sf)
    want = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.md5("text").alias("text_md5"), "lang", "source", "n_chars")
    assert Counter(map(tuple, got.select(want.columns).collect())) == Counter(map(tuple, want.collect()))


def brute_components(texts, k, num, den):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) or (frozenset([tuple(w)]) if w else frozenset())
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if den * n >= num * (len(sets[a]) + len(sets[b]) - n):
                    x, y = top(a), top(b)
                    up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in sets}


@pytest.mark.parametrize("k,num,den", [(3, 90, 100), (5, 8, 10)])
def test_jaccard_brute(spark, k, num, den):
    rng = random.Random(k)
    texts = {0: None, 1: "", 2: " \n", 3: "one", 4: "ONE", 5: "one two", 6: "x " * 3000, 7: "x " * 3001}
    bases = [words(rng, rng.choice([9, 10, 11, 12, 40, 150, 400])) for _ in range(12)]
    for base in bases:
        for _ in range(14):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                at = rng.randrange(len(w))
                w[at : at + rng.choice([0, 1])] = [f"z{rng.randrange(3)}"]
            texts[len(texts)] = " ".join(w)
    df = spark.createDataFrame([(i, t, 1, "c") for i, t in texts.items()] + [(None, "one", 2, "d")], "doc_id long, text string, node int, list string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, k, num, den).collect()}
    assert got.pop(None) == (1, 3)  # takes the component of its text
    assert got == brute_components(texts, k, num, den)


@pytest.mark.parametrize("num,den", [(90, 100), (8, 10)])
def test_linked_sets_share_a_key(num, den):
    """Thousands of pairs that just link, whatever is common: they share a key, and their sketches allow them."""
    import numpy as np

    rng = np.random.default_rng(3)
    pairs, missed = 0, []
    may_link = jaccard.Sketches(num, den).may_link
    for size in [*range(2, 61), 120, 700]:
        for extra in range(1, size):
            for gone in (extra // 2, 0):
                if den * (size - gone) < num * (size + extra - gone):
                    continue
                for turn in range(40):
                    pool = rng.integers(0, 1 << 63, size + extra).astype(np.uint64)
                    x, y = np.sort(pool[:size]), np.sort(pool[gone : size + extra - gone])
                    common = np.sort(rng.choice(pool, turn % 5 * len(pool) // 4, replace=False))
                    keys = jaccard.Prefixes(num, den, common, rng.permutation(len(common)))
                    if den * len(np.intersect1d(x, y)) >= num * len(np.union1d(x, y)):
                        pairs += 1
                        if not np.intersect1d(keys(x), keys(y)).size:
                            missed.append((len(x), len(y)))
                        assert may_link(len(x), jaccard.sketch(x), len(y), jaccard.sketch(y))
    assert pairs > 2000 and not missed, (pairs, Counter(missed))
    far = [np.unique(rng.integers(0, 1 << 63, 300).astype(np.uint64)) for _ in range(2)]
    assert not may_link(300, jaccard.sketch(far[0]), 300, jaccard.sketch(far[1]))


def test_jaccard_short_texts_and_repeated_ids(spark):
    """Texts of 12 words without their last word; ids that occur with two texts or with one text twice."""
    texts = {2 * i + j: " ".join(f"w{i}x{n}" for n in range(12 - j)) for i in range(60) for j in range(2)}
    df = spark.createDataFrame([*texts.items(), (0, texts[0])], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(df, 3, 90, 100).collect()}
    assert got == {i: i - i % 2 for i in texts}
    two = spark.createDataFrame([*texts.items(), (1, texts[4]), (7, texts[5])], "doc_id long, text string")
    rows = jaccard.jaccard_components(two, 3, 90, 100).collect()
    assert len(rows) == 122 and {(r.doc_id, r.component_id) for r in rows} == {(i, 0 if i in (0, 1, 4, 5, 6, 7) else i - i % 2) for i in texts}


def test_common_passages_and_batches(spark, monkeypatch):
    """Small counts per task: shingles of a shared passage are ranked, links stay."""
    passage = [f"p{i}" for i in range(40)]
    texts = {i: " ".join([f"d{i // 3}w{n}" for n in range(20)] + passage + [f"d{i // 3}v{n}" for n in range(20)] + ([f"x{i}"] if i % 3 else [])) for i in range(90)}
    for least, ranked in ((2, 1_000_000), (2, 10), (100, 1_000_000)):
        for name, value in (("BATCH", 300), ("LEAST", least), ("COMMON", 4), ("RANKED", ranked), ("CHUNK", 7)):
            monkeypatch.setattr(jaccard, name, value)
        df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, 3, 90, 100).collect()}
        assert got == brute_components(texts, 3, 90, 100)


def test_jaccard_hub_and_chunks(spark, monkeypatch):
    """Copies that link to their origin but not to each other, over several chunks; and an empty table."""
    base = [f"b{i}" for i in range(122)]
    texts = {i: " ".join(base[: (at := 3 * i + 2)] + ["new%d" % i, "more%d" % i] + base[at + 2 :]) for i in range(1, 38)}
    texts[50] = " ".join(base)
    monkeypatch.setattr(jaccard, "CHUNK", 5)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(df, 3, 90, 100).collect()}
    assert got == {i: c for i, (_, c) in brute_components(texts, 3, 90, 100).items()} and set(got.values()) == {1}
    assert jaccard.jaccard_components(df.limit(0), 3, 90, 100).count() == 0


def test_divide_skip_search():
    import numpy as np

    rng = random.Random(9)
    sets = [np.array(sorted(rng.sample(range(80), rng.randrange(5, 40))), np.uint64) for _ in range(60)]
    lists = jaccard.Lists(sets)
    for q in sets[:20]:
        for least in (1, 3, len(q) // 2, len(q)):
            got = dict(lists.search(q, max(least, 1), lambda d: True))
            want = {i: len(set(q.tolist()) & set(s.tolist())) for i, s in enumerate(sets)}
            assert got == {i: n for i, n in want.items() if n >= max(least, 1)}


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(50)] + [(7, 7), (300, 200), (300, 200)]
    up = {n: n for e in edges for n in e if e[0] != e[1]}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            up[max(top(a), top(b))] = min(top(a), top(b))
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: top(n) for n in up}


def test_decontamination_finds_edited_copies(spark):
    rng = random.Random(4)
    items = [(k, " ".join(plain(rng, 30)) + ".") for k in range(20)] + [(90, None), (91, ""), (92, "two words"), (93, "alpha beta gamma")]
    docs, want = [], set()
    for k, text in items[:20]:
        w = text.split()
        for at in rng.sample(range(30), 5):
            w[at] = "changed"
        del w[3]
        docs.append((k, " ".join(plain(rng, 200) + [x.upper() + "," for x in w] + plain(rng, 100))))
        want.add((k, k))
    docs += [(100 + k, " ".join(plain(rng, 300))) for k in range(30)] + [(200, None), (201, ""), (202, "Alpha, BETA gamma!"), (203, items[0][1]), (203, items[0][1]), (None, items[1][1])]
    want |= {(202, 93), (203, 0), (None, 1)}
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, grams int")
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, words string")
    got = decontamination.contaminated(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    assert all(0.5 <= r.score <= 1 for r in got)
    assert decontamination.contaminated(df.limit(0), bench).count() == 0
    assert decontamination.contaminated(df, bench.limit(0)).count() == 0


def test_decontamination_with_evenly_spaced_edits(spark):
    """Against brute-force alignment of every item to every document; every copy keeps three words in a row."""
    import numpy as np

    rng = random.Random(12)
    items = [(k, " ".join(plain(rng, rng.choice([4, 5, 9, 30])))) for k in range(16)]
    docs = []
    for k, text in items:
        for gap in (4, 5, 6, 7):
            for whole in (text.split(), text.split()[:3]):
                w = [f"new{rng.randrange(99)}" if i % gap == gap - 1 else x for i, x in enumerate(whole)]
                docs.append((len(docs), " ".join(plain(rng, 60) + w + plain(rng, 60))))
    made = decontamination.Items(items)
    want = {}
    for d, text in docs:
        w = np.array([made.vocabulary.get(x, 0) for x in decontamination.words_of(text)])
        for k, item in zip(made.ids, made.words):
            score, end = decontamination.align(item, w)
            if score >= 0.5 * len(item) and np.isin(made.codes(w), made.codes(item)).any():
                want[d, k] = score / len(item)
    got = {(r.doc_id, r.item_id): r.score for r in decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want and len(want) >= 80


def test_decontamination_in_blocks(spark, sf, monkeypatch):
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    one = {(r.doc_id, r.item_id, round(r.score, 9)) for r in decontamination.contaminated(docs, bench).collect()}
    exact = {(d.doc_id, i.item_id) for d in docs.collect() for i in bench.collect() if i.text in (d.text or "")}
    assert exact and exact <= {x[:2] for x in one}
    monkeypatch.setattr(decontamination, "BLOCK", 4000)
    assert {(r.doc_id, r.item_id, round(r.score, 9)) for r in decontamination.contaminated(docs, bench).collect()} == one


def test_align():
    import numpy as np

    a = np.array([1, 2, 3, 4, 5])
    assert decontamination.align(a, np.array([9, 1, 2, 3, 4, 5, 9])) == (5.0, 6)
    assert decontamination.align(a, np.array([1, 2, 9, 4, 5]))[0] == 3.5
    assert decontamination.align(a, np.array([1, 2, 4, 5]))[0] == 3.0
    assert decontamination.align(a, np.array([8, 8]))[0] == 0.0


@pytest.mark.parametrize("op,label,mod,held", [(quality.op8, "quality", 3, 1), (toxicity.op10, "toxic", 4, 2)])
def test_classifiers_on_held_out_rows(spark, op, label, mod, held):
    sf = "/root/testdata/sf0.01"
    got = op(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert got.count() == docs.count()
    rows = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == held) and 0 <= r.score <= 1
    held_rows = [r for r in rows if r.held_out]
    assert sum(r.predicted == r[label] for r in held_rows) / len(held_rows) > 0.95


def test_label_model_finds_accuracies_and_correlations():
    """Voters of known accuracy, two of them copies of a third, labels partly wrong: posteriors follow the truth, not the labels or the copies."""
    import numpy as np

    rng = np.random.default_rng(4)
    truth = (rng.random(6000) < 0.3).astype(int)
    right = [0.9, 0.9, 0.85, 0.85, 0.7]
    votes = np.array([np.where(rng.random(6000) < r, truth, 1 - truth) for r in right]).T
    copies = np.where(rng.random((6000, 2)) < 0.97, votes[:, 4:5], 1 - votes[:, 4:5])
    votes = np.hstack([votes, copies])
    labels = np.where(rng.random(6000) < 0.9, truth, 1 - truth)
    q = toxicity.label_model(votes, labels)
    found = ((q >= 0.5) == truth).mean()
    assert found > 0.965 and found > (labels == truth).mean() + 0.05
    assert q.mean() == pytest.approx(truth.mean(), abs=0.02)
    tree = toxicity.dependency_tree(votes, [1.0 - truth, 1.0 * truth])
    pairs = {frozenset((k, p)) for k, p in enumerate(tree) if p >= 0}
    assert len(pairs) == 6 and {frozenset((4, 5)), frozenset((4, 6))} <= pairs
    # Weights stand for repeated rows.
    rows, back, times = np.unique(np.column_stack([votes, labels]), axis=0, return_inverse=True, return_counts=True)
    assert np.allclose(toxicity.label_model(rows[:, :-1], rows[:, -1], times=times)[back], q, atol=1e-6)


def test_logistic_against_gradient_steps():
    import numpy as np

    rng = np.random.default_rng(6)
    x, times = rng.random((40, 3)), rng.integers(1, 5, 40)
    q = 1 / (1 + np.exp(-(x @ [2.0, -1.0, 0.5] - 0.3)))
    many = np.repeat(np.arange(40), times)
    w = np.zeros(4)
    for _ in range(60_000):
        p = 1 / (1 + np.exp(-(x[many] @ w[:3] + w[3])))
        w -= 0.01 * (np.append(x[many].T @ (p - q[many]), (p - q[many]).sum()) + np.append(0.3 * w[:3], 1e-3 * w[3]))
    assert np.allclose(toxicity.logistic(x, q, times=times), w, atol=1e-3)


def test_toxicity_counts_all_equal_rows(spark):
    """More texts without a vote than any limit on equal rows: the base rate is that of the labels."""
    import numpy as np

    rng = random.Random(6)
    clean = [f"plain text number {i}" for i in range(9000)]
    toxic = [f"{rng.choice(['vilest', 'nastier'])} words number {i}" for i in range(300)] + [f"quiet text number {i}" for i in range(900)]
    rows = [(i, t, int(i >= len(clean))) for i, t in enumerate(clean + toxic)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"), "toxic")
    votes = toxicity.Votes(model.terms)
    x = votes.features([t for _, t, _ in rows])
    q = toxicity.label_model((x > 0).astype(float), np.array([y for _, _, y in rows]))
    want = toxicity.logistic(x, q)
    assert np.allclose(model.weights, want, atol=1e-3)
    assert np.allclose(toxicity.probabilities(votes, model, ["no vote here"]), 1 / (1 + np.exp(-want[-1])), rtol=1e-3)


def test_shapes_read_whole_words():
    assert quality.shape("Abc12-x") == "Aa9-a" and quality.shape("a" * 99 + "1") == "a9"
    assert quality.shape("a1" * 50) == "9a 7" and quality.shape("a1" * 50 + "-") != quality.shape("a1" * 50)


def test_one_text_for_each_label(spark):
    docs = spark.createDataFrame([(1, f"text {i % 3}") for i in range(50)] + [(2, None), (3, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (2, 1), (3, 5)], "doc_id long, y int")
    got = sorted((r.text or "", r.y) for r in quality.labelled(docs, labels, "y", 100).collect())
    assert got == [("", 1), ("text 2", 0), ("text 2", 1)]


def test_ftrl_against_plain_loops():
    """The sparse steps and the batched scores are those of loops over n-grams and dictionaries."""
    rng = random.Random(5)
    rows = [(" ".join(plain(rng, rng.randrange(0, 30)) + (["ZAP!", "b1c"] * 2 if y else [])), y) for y in (0, 1) * 30]
    made = quality.Features()
    weights = quality.ftrl([(*made.of(t), y) for t, y in rows], epochs=2)

    def vector(text):
        words, out = text.split(), Counter()
        out[quality.SLOTS] = out[quality.SLOTS + 1 + len(words).bit_length()] = 1.0
        codes = [quality.word_codes(w) for w in words]
        mask = (1 << 64) - 1
        for k in range(4):
            part = [((c >> 32) + 1) if k < 2 else ((c & 0xFFFFFFFF) + 1) for c in codes]
            if k % 2:
                part = [0 if a >> 32 == b >> 32 else (x * 0xD6E8FEB86659FD93 + y) & mask for a, b, x, y in zip(codes, codes[1:], part, part[1:])]
            for x in part:
                out[((x * 0x9E3779B97F4A7C15 & mask) >> (64 - quality.BITS)) + (k << quality.BITS)] += quality.SCALE / len(part)
        return out

    z, n = Counter(), Counter()

    def weight(i):
        if abs(z[i]) <= quality.L1:
            return 0.0
        return (math.copysign(quality.L1, z[i]) - z[i]) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    for _ in range(2):
        for text, y in rows:
            x = vector(text)
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA * w[i]
                n[i] += g * g
    assert all(weights[i] == pytest.approx(weight(i), abs=1e-9) for i in range(len(weights)) if weights[i] or i in z)
    scores = made.scores([t for t, _ in rows], weights)
    assert scores == pytest.approx([1 / (1 + math.exp(-sum(weight(i) * v for i, v in vector(t).items()))) for t, _ in rows], abs=1e-9)


def test_classifiers_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (3, "x " * 9000, 0.5), (3, "x " * 9000, 0.5), (None, "y", None)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (2, None), (3, 7), (None, 1)], "doc_id long, quality int")
    for module in (quality, toxicity):
        for some in (labels, labels.limit(0)):
            model = module.fit(docs, some, "quality")
            scores = [r.score for r in module.score(docs, model).collect()]
            assert len(scores) == 5 and all(0 <= s <= 1 for s in scores)
            assert docs.filter(module.scorer(spark, model)("text") >= 0).count() == 5
        assert module.score(docs.limit(0), model).count() == 0


def test_language_model(spark):
    rng = random.Random(8)
    texts = {i: " ".join(words(rng, rng.randrange(1, 80))) for i in range(400)}
    texts |= {400: None, 401: "", 402: "W1 w1\n", 403: "never" * 300, 404: "ünseen words"}
    train = {i: t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 10}
    tokens = lambda t: (t or "").encode().lower().split()
    c = Counter(w for t in train.values() for w in tokens(t))
    n, v = sum(c.values()) + len(train), len(c) + 1
    df = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id long, text string, row int")
    model = lm.fit(df.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0).select("text"))
    got = {r.doc_id: r for r in lm.score(df, model).collect()}
    assert len(got) == len(texts)
    for i, t in texts.items():
        w = tokens(t)
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w) + math.log10((len(train) + 0.1) / (n + 0.1 * (v + 1)))
        assert got[i].base_score == pytest.approx(base, rel=1e-9)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(w) + 1, sum(c[x] > 0 for x in w) + 1, n)
        assert got[i].score < 0 and got[i].spelt_score <= got[i].score and got[i].bits_per_byte > 0
    assert lm.score(df.limit(0), model).count() == 0


def test_language_model_beats_counts(spark):
    sf = "/root/testdata/sf0.01"
    held = [r for r in lm.op5(spark, sf).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_long_words_and_texts_are_learnt_whole(spark, monkeypatch):
    """A frequent word of any length is a symbol; the parts of a long text give the decisions of the whole."""
    import numpy as np
    import pyarrow as pa

    long = "q" * 500
    df = spark.createDataFrame([(f"{long} a b c",)] * 20, "text string")
    lex = lm.fit(df).lexicon
    assert lex.codes([long.encode()])[0] >> 16 > 0 and lex.counts[lex.index[lm.key_of(long.encode())]] == 20
    batch = pa.RecordBatch.from_pydict({"text": [" ".join(random.Random(1).choice("abc") for _ in range(50)), "a b", None]})
    made = lm.Decisions(lex.weights, 0)

    def decided(part):
        monkeypatch.setattr(lm, "PART", part)
        got = [made.of(*b) for b in lm.symbol_batches(iter([batch]), lex, 0)]
        return [np.concatenate([g[0] for g in got]), *(np.concatenate([g[1][k] for g in got]) for k in range(lm.ORDERS))]

    for a, b in zip(decided(40_000), decided(7), strict=True):
        assert np.array_equal(a, b)


def test_words_are_found_without_a_python_call_each():
    """Words, their symbols and classes agree with plain Python's, and Python calls don't grow with the words."""
    import sys

    import pyarrow as pa

    rng = random.Random(3)
    many = [bytes(rng.choices(b"abcdefghij", k=rng.randrange(1, 9))).decode() for _ in range(4000)]
    texts = [None, "", " \t\n", "A b\x0bCD\x0cefg\rhijk\n", "Ünseen\xa0Straße\x1c\x85 x", "Q" * 500 + " " + "q" * 64, *(" ".join(many[i : i + 400]) for i in range(0, 4000, 400)), " end"]
    tokens = [(t or "").encode().lower().split() for t in texts]
    counts = Counter(w for t in tokens for w in t)
    hot = [(lm.key_of(w), c, 0) for w, c in counts.most_common(3000)]
    lex = lm.Lexicon(hot, sum(counts.values()), len(counts), len(texts), {})
    calls = []
    batch = pa.RecordBatch.from_pydict({"text": texts})
    sys.setprofile(lambda frame, event, arg: calls.append(event) if event == "call" else None)
    try:
        got = list(lm.symbol_batches(iter([batch]), lex, 0))
    finally:
        sys.setprofile(None)
    place = {w: k for k, (w, _, _) in enumerate(hot)}
    symbol = lambda w: k if (k := place.get(lm.key_of(w), lm.SYMBOLS)) < lm.SYMBOLS else lm.SYMBOLS + zlib.crc32(w[:2] + w[-2:]) % lm.CLASSES
    assert [s for g in got for s in g[0].tolist()] == [s for t in tokens for s in [*map(symbol, t), lm.END]]
    assert [n for g in got for n in g[1].tolist()] == [len(t) + 1 for t in tokens]
    assert [k - 1 for k in (lex.codes([w for t in tokens for w in t]) >> 16).tolist()] == [place.get(lm.key_of(w), -1) for t in tokens for w in t]
    assert len(calls) < len(counts) / 4
    rare = pa.array(sorted(counts), pa.binary())
    got = list(lm.spelling_batches(iter([rare[:7], rare[7:7], rare[7:]])))
    assert len(got) > 1 and [s for g in got for s in g[0].tolist()] == [s for w in sorted(counts) for s in [*w, lm.BYTE_END]]
    assert [n for g in got for n in g[1].tolist()] == [len(w) + 1 for w in sorted(counts)]


def test_language_model_without_words(spark):
    """With no training text, or none that has words, everything is scored."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate([None, "", " ", "a b a", "x" * 200])], "doc_id long, text string")
    for training, n in ((df.select("text").limit(0), 0), (df.filter("doc_id < 3").select("text"), 3)):
        got = {r.doc_id: r for r in lm.score(df, lm.fit(training)).collect()}
        assert [got[i].n_tokens for i in range(5)] == [1, 1, 1, 4, 2]
        for r in got.values():
            assert (r.train_tokens, r.n_known) == (n, n > 0)
            v = n > 0
            base = math.log10((n + 0.1) / (n + 0.1 * (v + 1))) + (r.n_tokens - 1) * math.log10(0.1 / (n + 0.1 * (v + 1)))
            assert r.base_score == pytest.approx(base, rel=1e-9) and math.isfinite(r.score) and math.isfinite(r.bits_per_byte)


def test_mixing_is_a_distribution():
    """Over all symbols, coded probabilities add up to one."""
    import numpy as np

    rng = np.random.default_rng(1)
    made = lm.Decisions(np.array([5.0, 3, 2, 1, 1, 1]), 0)
    text = rng.integers(0, 6, 3000)
    counts, weights, hits, _ = lm.learn(iter([(text[i : i + 300], np.array([300])) for i in range(0, 3000, 300)]), made)
    views = [lm.Mixer.view(x) for x in counts]
    mixer = lm.Mixer([a for a, _ in views], [b for _, b in views], weights.astype(np.float32), np.full(lm.STEPS, 0.5, np.float32))
    total = 0.0
    for s in range(6):
        bits, slots, of = made.of(np.array([2, 4, s]), np.array([3]))
        total += math.exp(float(mixer.bits_cost(bits, slots)[of == 2].sum()))
    assert total == pytest.approx(1, abs=1e-5)


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept, names = docs, docs.columns
    for name, stage in pipeline.STAGES[:-1]:
        before = {r.doc_id for r in kept.collect()}
        out = stage(spark, kept, sf)
        assert out.columns == names, name
        kept = spark.createDataFrame(out.collect(), docs.schema)
        after = {r.doc_id for r in kept.collect()}
        assert after <= before
        if name == "n-gram Jaccard join":
            texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in before}
            assert after == {i for i, (_, c) in brute_components(texts, 5, 8, 10).items() if i == c}
        if name == "benchmark decontamination":
            bench = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
            texts = {r.doc_id: r.text for r in docs.collect()}
            assert before - after == {i for i in before if any(b.text in texts[i] for b in bench)}
    clean = [i for i, r in labels.items() if r.quality == 1 and r.toxic == 0]
    first = {r.doc_id for r in pipeline.STAGES[0][1](spark, docs, sf).collect()}
    assert sum(i in first for i in clean) / len(clean) > 0.95
    final = {r.doc_id for r in pipeline.run(spark, sf).collect()}
    assert final == {r.doc_id for r in kept.collect()}
    assert [c for c in pipeline.run(spark, sf).columns] == ["doc_id", "n_tokens", "n_split", "ids"]


def test_pipeline_odd_rows(spark, sf):
    rows = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (3, "word " * 3000, "en", "s", 1), (3, "word " * 3000, "en", "s", 1), (None, "a b c", None, None, None)], spark.read.parquet(f"{sf}/documents.parquet").schema)
    for docs in (rows, rows.limit(0)):
        for name, stage in pipeline.STAGES:
            assert stage(spark, docs, sf).count() <= docs.count(), name
