"""All queries against their SQL, and operators against plain Python."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window

from foldline.functions import alphabet, geometry
from foldline.operators import distance, helices, msa, profile, search, seeds, sheets, store
from foldline.operators.bonds import likely_bonds
from foldline.operators.range_join import within
from foldline.plans import output, queries
from foldline.sources import mmcif, text
from foldline.streaming.search import column_counts

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, sf, duck, name):
    got = queries.QUERIES[name](spark, sf).toPandas()
    assert len(got.columns)
    if name in queries.SQL:
        want = duck.execute(queries.SQL[name]).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        rows = lambda x: sorted(map(repr, x[columns].astype(object).where(x[columns].notna(), None).values.tolist()))
        assert rows(got) == rows(want)


def same_as_sql(spark, name, folder, **tables):
    """The query and its SQL on the tables given have the same rows; returns the query's, sorted."""
    con = duckdb.connect()
    for t, df in tables.items():
        df.write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    df = queries.QUERIES[name](spark, str(folder))
    columns = sorted(df.columns)
    got, want = (sorted(map(tuple, rows), key=repr) for rows in (df.select(columns).collect(), con.execute(f"select {', '.join(columns)} from ({queries.SQL[name]})").fetchall()))
    assert got == want
    return got


def test_label_remap_many_parts(spark, tmp_path):
    rows = [(1, 1, 1_500_000, 7), (1, 2, 10, 8), (2, 1, 10, 9), (2, 2, 1_500_000, 10), (3, 1, None, 11), (3, 2, 5, None), (4, 3, 5, 12), (4, 3, 5, 13), (6, 1, 1, 1)]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long")
    orders = spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 5)], "o_orderkey long")
    assert same_as_sql(spark, "label_remap_last_wins", tmp_path, lineitem=lines, orders=orders) == [(10, 2), (13, 4), (7, 1), (None, 3)]


def close_residues(spark, n, chains=2):
    """Embeddings of residues that nearly all see each other; some are copies, some have no label or miss numbers."""
    rng = random.Random(n)
    rows = [[k, [rng.gauss(0, 0.03) for _ in range(12)], k % chains] for k in range(n)]
    for k in range(10, n, 10):
        rows[k][1] = rows[10][1]
    rows[5][2], rows[7][1], rows[9][1][11] = None, None, None
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_two_best_bonds(spark, tmp_path):
    n = 300
    assert len(same_as_sql(spark, "hbond_top2", tmp_path, embeddings=close_residues(spark, n))) > 3 * n
    # Whatever the blocks, a few rows a residue are ranked, not all that are near.
    residues = queries.chain_residues(spark, str(tmp_path)).cache()
    every = queries._bonds(spark, str(tmp_path)).filter("energy < 0").cache()
    best = [(F.col(x), F.row_number().over(Window.partitionBy(x).orderBy("energy", y))) for x, y in (("donor", "acceptor"), ("acceptor", "donor"))]
    want = [{(r.donor, r.acceptor, r.energy) for r in every.withColumn("k", k).filter("k <= 2").collect()} for _, k in best]
    for block, most in ((4096, 5), (40, 20)):
        likely = likely_bonds(residues, both=True, block=block)
        got = [{(r.donor, r.acceptor, r.energy) for r in likely.filter(f"for_{side} and energy < 0").withColumn("k", k).filter("k <= 2").collect()} for side, (_, k) in zip(("donor", "acceptor"), best)]
        assert got == want and likely.count() < most * n < every.count()


@pytest.mark.parametrize("name", ["beta_bridges", "ladder_histograms", "sheet_components", "strand_partners"])
def test_bridges_of_best_bonds(spark, tmp_path, monkeypatch, name):
    """From all near pairs the same comes out as without listing them."""
    close_residues(spark, 300, 1).write.parquet(f"{tmp_path}/embeddings.parquet")
    every = queries._bonds(spark, str(tmp_path)).cache()
    assert every.count()
    query = queries.QUERIES[name]

    def rows():
        return sorted(map(repr, query(spark, str(tmp_path)).collect()))

    monkeypatch.setattr(queries, "within", None)
    got = rows()
    monkeypatch.setattr(queries, "likely_bonds", lambda residues: every)
    assert got == rows() and got


def test_word_seeds_stay(spark, tmp_path, monkeypatch):
    """Rows of one id count together; texts of one row are counted where they are."""
    rng = random.Random(8)

    def text(n):
        return "".join(rng.choice("acdefghiklmnpqrstvwyABCDEFGHIKLMNPQRSTVWXYZ uj-0é") for _ in range(n))

    items = [(k, text(n)) for k, n in ((0, 90), (100, 160), (200, 2), (300, 60), (7, 50))]
    long = text(3000) + items[0][1] + text(40_000)
    docs = [(1, long), (2, items[1][1]), (3, items[0][1] + text(5)), (3, items[0][1]), (4, None), (5, ""), (6, "ac"), (None, items[3][1] * 2), (None, text(80)), *((k, text(70)) for k in range(10, 60))]
    tables = {"documents": spark.createDataFrame(docs, "doc_id long, text string"), "benchmark": spark.createDataFrame(items, "item_id long, text string")}
    assert len(same_as_sql(spark, "word_seeds", tmp_path, **tables)) > 30
    tables["documents"].filter("doc_id <> 3").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(seeds, "second_hits", None)  # no seed is sent to a window
    monkeypatch.setattr(seeds, "SORTED", 500)
    monkeypatch.setattr(seeds, "LETTERS", 1000)
    assert queries.word_seeds(spark, str(tmp_path)).filter("target_id = 1 and seeds > 500").count() == 3


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one first thing\nACD\nEF\n>two\nGG>H\n\n>three x\nK\n>empty\n>\nLL\n")
    got = {(r.id, r.defline, r.seq) for r in text.fasta(spark, str(tmp_path / "a.fa")).collect()}
    assert got == {("one", "first thing", "ACDEF"), ("two", "", "GG>H"), ("three", "x", "K")}


def _atom(serial, name, alt, res, chain, seq, x, element="C"):
    return f"ATOM  {serial:5d}  {name:<3s}{alt}{res:>3s} {chain}{seq:4d}    {x:8.3f}{0:8.3f}{0:8.3f}{1:6.2f}{0:6.2f}          {element:>2s}  "


def test_residues_from_structure_lines(spark):
    lines, k = [], 0
    for seq in (120, 123, 124):
        for alt in {"120": " ", "123": "B", "124": "AB"}[str(seq)]:
            for n in ("N", "CA", "C", "O"):
                k += 1
                lines.append(_atom(k, n, alt, "SER", "A", seq, k))
    lines += [_atom(90, "H", " ", "SER", "A", 125, 1.0, "H"), _atom(91, "CA", " ", "SER", "A", 125, 1.0), _atom(92, "N", " ", "SER", "A", 126, 1.0, "QQ"), "ATOM short", "ENDMDL", _atom(99, "N", " ", "SER", "A", 130, 1.0)]
    df = spark.createDataFrame([("f", i, v) for i, v in enumerate(lines)], "file string, line_no int, value string")
    got = text.residues(text.atoms(df)).orderBy("ord").collect()
    assert [r.resseq for r in got] == [120, 123, 124] and got[2].n.x == 9.0


def test_clusters_and_stockholm(spark):
    lines = [">Cluster 0", "0 30aa, >a... *", "1 29aa, >b... at 100.00%", ">Cluster 1", "0 9aa, >c... *"]
    df = spark.createDataFrame([("f", i, v) for i, v in enumerate(lines)], "file string, line_no int, value string")
    assert {(r.cluster, r.member, r.is_representative) for r in text.clusters(df).collect()} == {(0, "a", True), (0, "b", False), (1, "c", True)}
    sto = ["# STOCKHOLM 1.0", "#=GF ID x", "#=GF RI 1 2", "#=GS h DE name", "//", "#=GF ID y", "//"]
    df = spark.createDataFrame([("f", i, v) for i, v in enumerate(sto)], "file string, line_no int, value string")
    assert [(r.block, r.kind) for r in text.stockholm_profile(df).orderBy("row_no").collect()] == [(0, "ID"), (0, "RI"), (0, "DE"), (1, "ID")]


def test_mmcif(spark, tmp_path):
    (tmp_path / "x.cif").write_text("data_X\n#\n_entry.id 'X y'\n_t.v\n;line 1\nline 2\n;\nloop_\n_a.id\n_a.name\n1 'it's'\n2 \"b c\" # note\n_last.z 9\n")
    cif = mmcif.read(spark, str(tmp_path / "x.cif"))
    got = {(r.category, r.row, r.field): r.value for r in cif.collect()}
    assert got == {("_entry", 0, "id"): "X y", ("_t", 0, "v"): "line 1\nline 2", ("_a", 0, "id"): "1", ("_a", 0, "name"): "it's", ("_a", 1, "id"): "2", ("_a", 1, "name"): "b c", ("_last", 0, "z"): "9"}
    assert mmcif.field(cif, "_a", "name", "; ").first().value == "it's; b c"
    assert {(r.row, r.id, r.name) for r in mmcif.wide(cif, "_a", ["id", "name"]).collect()} == {(0, "1", "it's"), (1, "2", "b c")}
    with pytest.raises(ValueError):
        list(mmcif.rows("data_a\ndata_b\n"))


def test_geometry(spark):
    p = lambda x, y, z: geometry.point(F.lit(float(x)), F.lit(float(y)), F.lit(float(z)))
    df = spark.range(1)
    assert df.select(geometry.dihedral(p(1, 0, 0), p(0, 0, 0), p(0, 1, 0), p(0, 1, 1))).first()[0] == pytest.approx(-90)
    assert df.select(geometry.dihedral(p(1, 0, 0), p(0, 0, 0), p(0, 1, 0), p(0, 1, 0))).first()[0] is None
    assert df.select(geometry.cosine(p(1, 0, 0), p(0, 0, 0), p(0, 1, 0), p(0, 0, 0))).first()[0] == 0
    assert df.select(geometry.hbond_energy(p(0, 0, 0), p(1, 0, 0), p(0, 3, 0), p(0, 0.2, 0))).first()[0] == -9.9


def test_range_join_brute(spark):
    rng = random.Random(1)
    pts = [(i, (rng.uniform(-30, 30), rng.uniform(-30, 30), rng.uniform(-30, 30))) for i in range(300)]
    df = spark.createDataFrame(pts, "id long, at struct<x:double,y:double,z:double>")
    got = {(r.a, r.b) for r in within(df, "id", "at", 9.0).collect()}
    assert got == {(a, b) for a, p in pts for b, q in pts if a < b and sum((u - v) ** 2 for u, v in zip(p, q)) < 81}


def _slow_identical(a, b):
    """The same table, a cell at a time."""
    low, best, top = -1e9, 0, -1e9
    s = {(i, 0): (0.0, 0) for i in range(len(a) + 1)} | {(0, j): (0.0, 0) for j in range(len(b) + 1)}
    down, right = {}, {}
    for t in range(2, len(a) + len(b) + 1):
        for i in range(max(1, t - len(b)), min(len(a), t - 1) + 1):
            j = t - i
            m = (s[i - 1, j - 1][0] + alphabet.PAM250_SCORES[a[i - 1], b[j - 1]], s[i - 1, j - 1][1] + (a[i - 1] == b[j - 1]))
            x, y = s[i - 1, j], down.get((i - 1, j), (low, 0))
            d = (x[0] - 10, x[1]) if x[0] - 10 >= y[0] - 0.2 else (y[0] - 0.2, y[1])
            x, y = s[i, j - 1], right.get((i, j - 1), (low, 0))
            r = (x[0] - 10, x[1]) if x[0] - 10 >= y[0] - 0.2 else (y[0] - 0.2, y[1])
            down[i, j], right[i, j] = d, r
            s[i, j] = m if m[0] >= d[0] and m[0] >= r[0] else d if d[0] >= r[0] else r
            if (i == len(a) or j == len(b)) and s[i, j][0] > top:
                top, best = s[i, j]
    return best


def test_distance_kernel():
    rng = random.Random(6)
    for _ in range(40):
        a, b = ("".join(rng.choice("ACDEGKLX") for _ in range(rng.randrange(1, 25))) for _ in range(2))
        assert distance.identical(a, b) == _slow_identical(a, b)
    assert distance.identical("", "A") == 0 and distance.identical("ACDE", "ACDE") == 4


def test_conservation_invariants(spark):
    df = spark.createDataFrame([(1, "ACDA"), (2, "ACEA"), (3, "ACWC")], "id long, seq string")
    got = {r.pos: r.weight for r in profile.conservation(df, "id", "seq").collect()}
    assert got[1] == got[2] == 1.0 and got[3] < 1 and got[4] < 1
    p = {r.pos: r for r in profile.column_profile(df, "id", "seq").collect()}
    assert p[1].entropy == 0 and p[3].nocc == 3 and p[3].entropy == pytest.approx(1.098612)


def test_tiles_brute(spark, monkeypatch):
    """Many small tiles and strips, gaps, groups and letters without similarity, against loops over all pairs."""
    rng = random.Random(12)
    monkeypatch.setattr(profile, "TILE", 4)
    monkeypatch.setattr(profile, "STRIP", 3)
    rows = [(g, k, "".join(rng.choice("ACDWXB.-") for _ in range(rng.choice((7, 10))))) for g in ("p", None) for k in range(21)] + [("p", 50, ""), ("q", 1, "AC")]
    df = spark.createDataFrame(rows, "g string, id long, seq string")
    sim = {(r.a, r.b): r.score for r in profile.similarity(spark).collect()}
    pairs, s, t = {}, {}, {}
    for g in ("p", None):
        own = [(k, r) for h, k, r in rows if h == g and r]
        for x, (i, a) in enumerate(own):
            for j, b in own[x + 1 :]:
                both = [(c, d) for c, d in zip(a, b) if c not in ".-" and d not in ".-"]
                if both:
                    pairs[g, i, j] = (len(both), sum(c == d for c, d in both) / len(both))
                for p, (c, d) in enumerate(zip(a, b)):
                    if (c, d) in sim:
                        far = 1 - pairs[g, i, j][1]
                        s[g, p + 1] = s.get((g, p + 1), 0) + far * sim[c, d]
                        t[g, p + 1] = t.get((g, p + 1), 0) + far * 1.5
    got = {(r.g, r.pos): r.weight for r in profile.conservation(df, "id", "seq", group="g").collect()}
    assert got.keys() == s.keys() and all(got[k] == pytest.approx(min(1.0, s[k] / t[k]) if t[k] > 0 else 1.0, abs=2e-5) for k in s)
    found = {(r.a, r.b): (r.compared, r.identity) for r in profile.pair_identity(df.filter("g = 'p'"), "id", "seq").collect()}
    want = {(i, j): v for (g, i, j), v in pairs.items() if g == "p"}
    assert found.keys() == want.keys() and all(found[k][0] == want[k][0] and found[k][1] == pytest.approx(want[k][1], abs=1e-6) for k in want)


def test_helix_of_bonds(spark):
    rows = [("a", i, False, i < 6, False, False) for i in range(12)]
    df = spark.createDataFrame(rows, "chain string, ord int, bond3 boolean, bond4 boolean, bond5 boolean, bend boolean")
    got = "".join(r.ss for r in helices.helix_marks(df).orderBy("ord").collect())
    assert got == " HHHHHHHHT  "[:1] + "HHHHHHHH" + "  " + " " or got.count("H") == 8
    flags = "".join(r.helix4 for r in helices.turn_flags(df).orderBy("ord").collect())
    assert flags == ">>>>XX<<<<  "


def _ladder(kind, i, j, n, segments=(1, 1)):
    return ("p", kind, i, i + n - 1, j, j + n - 1, n, *segments)


def test_sheets(spark):
    schema = "protein string, kind string, first_i long, last_i long, first_j long, last_j long, n long, segment_i int, segment_j int"
    rows = [_ladder("antiparallel", 2, 40, 3), _ladder("antiparallel", 6, 34, 2), _ladder("parallel", 41, 60, 2), _ladder("parallel", 90, 99, 1), _ladder("parallel", 44, 66, 1, (1, 2))]
    df = spark.createDataFrame(rows, schema)
    got = [(r.sheet, r.ladder, r.kind, r.first_i, r.last_i, r.first_j, r.last_j, r.n) for r in sheets.sheets(df).orderBy("sheet", "ladder").collect()]
    # The second goes on after the first with a bulge of one residue and four; the fifth is beyond a break.
    assert got[0] == (1, 0, "antiparallel", 2, 7, 34, 42, 5) and got[1] == (1, 1, "parallel", 41, 42, 60, 61, 2)
    assert [g[0] for g in got] == [1, 1, 2, 3] and len(got) == 4
    of = {r.ord: r for r in sheets.strands(df).collect()}
    assert (of[2].partner1, of[4].partner1, of[6].partner1, of[5].partner1) == (42, 40, 35, None) and of[5].ss == "E" and of[90].ss == "B"
    assert (of[41].partner1, of[41].partner2, of[41].parallel2, of[60].partner1) == (3, 60, True, 41)
    far = spark.createDataFrame([_ladder("parallel", 1, 30, 2), _ladder("parallel", 8, 37, 2), _ladder("parallel", 5, 37, 1)], schema)
    assert sorted(r.n for r in sheets.sheets(far).collect()) == [2, 3]  # only the later two are near enough


def test_bridges_brute(spark):
    rng = random.Random(3)
    n, segment = 60, lambda k: 1 if k <= 25 else 2
    bonds = {(d, d + k) for d in range(1, n + 1) for k in rng.sample([-9, -8, -7, 7, 8, 9, 10], 2) if 1 <= d + k <= n}
    got = {(r.i, r.j): r.kind for r in sheets.bridges(spark.createDataFrame([("p", d, a) for d, a in bonds], "protein string, donor long, acceptor long"), spark.createDataFrame([("p", k, segment(k)) for k in range(1, n + 1)], "protein string, ord long, segment int")).collect()}
    inner = [k for k in range(2, n) if segment(k - 1) == segment(k + 1)]
    want = {}
    for i in inner:
        for j in inner:
            if j >= i + 3:
                if {(i + 1, j), (j, i - 1)} <= bonds or {(j + 1, i), (i, j - 1)} <= bonds:
                    want[i, j] = "parallel"
                elif {(i + 1, j - 1), (j + 1, i - 1)} <= bonds or {(i, j), (j, i)} <= bonds:
                    want[i, j] = "antiparallel"
    assert got == want and len(want) > 5


def test_free_surface(spark):
    import math

    atoms = spark.createDataFrame([(0, 1, 0.0, 0.0, 0.0, 1.87), (0, 2, 50.0, 0.0, 0.0, 1.0), (0, 3, 50.0, 0.5, 0.0, 1.0), (1, 4, 0.1, 0.0, 0.0, 1.87), (0, 5, None, 0.0, 0.0, 1.0)], "protein int, atom long, x double, y double, z double, radius double")
    got = {r.atom: r.area for r in sheets.surface(atoms).collect()}
    assert sorted(got) == [1, 2, 3, 4] and got[1] == got[4] == pytest.approx(4 * math.pi * (1.87 + 1.4) ** 2, rel=1e-6)
    assert 0 < got[2] < 4 * math.pi * 2.4**2 and got[2] == pytest.approx(got[3], rel=0.05)
    # Many atoms, cubes of any size: against all pairs.
    rng = random.Random(5)
    rows = [(k % 2, k, *(rng.uniform(-9, 9) for _ in range(3)), rng.choice((1.4, 1.65, 1.87))) for k in range(150)]
    dots, weight = sheets.sphere()
    want = {}
    for p, k, *at, r in rows:
        free = 0
        for dot in dots.tolist():
            spot = [a + (r + 1.4) * x for a, x in zip(at, dot)]
            free += all(sum((a - b) ** 2 for a, b in zip(spot, o[2:5])) > (o[5] + 1.4) ** 2 for o in rows if o[0] == p and o[1] != k)
        want[k] = free * weight * (r + 1.4) ** 2
    df = spark.createDataFrame(rows, atoms.schema)
    for side in (3.0, 16.0, 100.0):
        got = {r.atom: r.area for r in sheets.surface(df, side).collect()}
        assert got == pytest.approx(want, abs=weight * 12)  # a dot on a border


def test_search_and_alignment(spark):
    rng = random.Random(7)
    seq = "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(120))
    near = seq[:50] + "G" + seq[53:]
    other = "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(150))
    bank = spark.createDataFrame([(1, seq), (2, near), (3, other), (4, ""), (5, "AC")], "id long, seq string")
    hits = bank.filter("id in (2, 3)").select(F.lit(1).cast("long").alias("query_id"), F.lit(seq).alias("query"), F.col("id").alias("hit_id"), "seq", F.when(F.col("id") == 2, 0.1).otherwise(0.9).alias("distance"))
    rows = {r.hit_id: r for r in msa.progressive(hits).collect()}
    assert rows[2].accepted and not rows[3].accepted and rows[2].aligned.replace(".", "") == near
    assert search.low_complexity("ACDEFGHIKLMNPQRSTVWY" * 2) == []
    ((a, b),) = search.low_complexity("ACDEFGHIKLMNPQRSTVWY" + "Q" * 20 + "ACDEFGHIKLMNPQRSTVWY")
    assert a <= 21 and b >= 39


def test_checksum_and_store(spark):
    got = spark.createDataFrame([("",), (None,), ("A",)], "s string").select(distance.crc64("s")).collect()
    assert got[0][0] == got[1][0] == "0" * 16 and got[2][0] != "0" * 16
    known = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    new = spark.createDataFrame([("b",), ("d",), ("c",), ("c",), (None,)], "name string")
    assert {(r.id, r.name) for r in store.get_or_create(known, new, "name").collect()} == {(1, "a"), (2, "b"), (3, "c"), (4, "d")}


def test_output_lines(spark):
    rows = spark.createDataFrame([("A", n, n + 10, "C", "H", 5, 0.25, 3.6) for n in (1, 2, 4)], "chain string, seq_nr int, pdb_nr int, letter string, ss string, nocc int, weight double, accessibility double")
    lines = [r.line for r in output.residue_lines(rows).orderBy("seq_nr").collect()]
    assert len(lines) == 4 and "!" in lines[2] and lines[0].endswith("   4     5   75")
    assert spark.range(1).select(output.fixed_length(F.lit("123456"), 4)).first()[0] == "--->"
    assert spark.range(1).select(output.disulfide_letter(F.lit("C"), F.lit(27))).first()[0] == "a"


def test_matrix_text(spark):
    lines = ["# note", "   A  R", "A  4 -1", "R -1  5"]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no int, value string")
    assert {(r.a, r.b): r.score for r in alphabet.substitution_text(df).collect()} == {("A", "A"): 4, ("A", "R"): -1, ("R", "A"): -1, ("R", "R"): 5}


def test_streamed_counts(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:00:00", "AC"), ("2024-01-01 00:10:00", "AD"), ("2024-01-01 05:00:00", "A")], "ts string, seq string").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = column_counts(stream, "ts", "seq").writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("counts").filter("pos = 1 and res = 'A'").agg(F.max("n")).first()[0] == 2
