"""Readers, reports and statistics against small texts and plain Python."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldline.functions import alphabet, geometry, statistics
from foldline.operators import cluster, distance, msa, search
from foldline.plans import report
from foldline.sources import mmcif, stockholm, text


def frame(spark, lines, file="f"):
    return spark.createDataFrame([(file, i, v) for i, v in enumerate(lines)], "file string, line_no int, value string")


def test_matrix_values(spark):
    """Whole published rows, the sum of each row, symmetry, and what a matrix file gives."""
    head = "A R N D C Q E G H I L K M F P S T W Y V B Z X".split()
    rows = {
        "A": "4 -1 -2 -2 0 -1 -1 0 -2 -1 -1 -1 -1 -2 -1 1 0 -3 -2 0 -2 -1 0",
        "G": "0 -2 0 -1 -3 -2 -2 6 -2 -4 -4 -2 -3 -3 -2 0 -2 -2 -3 -3 -1 -2 -1",
        "W": "-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1 1 -4 -3 -2 11 2 -3 -4 -3 -2",
        "B": "-2 -1 3 4 -3 0 1 -1 0 -3 -4 0 -3 -3 -2 0 -1 -4 -3 -3 4 1 -1",
        "Z": "-1 0 0 1 -3 3 4 -2 0 -3 -3 1 -1 -3 -1 0 -1 -3 -2 -2 1 4 -1",
        "X": "0 -1 -1 -1 -2 -1 -1 -1 -1 -1 -1 -1 -1 -1 -2 0 0 -2 -1 -1 -1 -1 -1",
    }
    m, p = alphabet.MATRIX, alphabet.PAM250_SCORES
    for scores in (m, p):
        assert all(scores[a, b] == scores[b, a] for a, b in scores) and len(scores) == 23 * 23
    assert all([m[a, b] for b in head] == [int(x) for x in row.split()] for a, row in rows.items())
    # What the lines of the published tables add up to.
    sums = dict(zip(head, "-19 -23 -16 -22 -39 -10 -13 -38 -18 -34 -33 -17 -18 -32 -37 -11 -16 -41 -22 -28 -21 -12 -23".split()))
    assert {a: sum(m[a, b] for b in head) for a in head} == {a: int(n) for a, n in sums.items()}
    assert (p["W", "W"], p["C", "C"], p["Y", "F"], p["W", "R"], p["B", "D"], p["Z", "Q"], p["X", "C"], p["V", "I"], p["L", "L"], p["G", "A"]) == (17, 12, 7, 2, 3, 3, -3, 4, 6, 1)
    lines = ["# a comment", "   " + "  ".join(head), *(f"{a} {' '.join(f'{m[a, b]:2d}' for b in head)}" for a in head)]
    assert {(r.a, r.b): r.score for r in alphabet.substitution_text(frame(spark, lines)).collect()} == m
    assert {(r.a, r.b): r.score for r in alphabet.substitution(spark, p).collect()} == p
    assert {(r.a, r.b): r.s for r in spark.sql(f"select * from (values {alphabet.score_values(alphabet.BLOSUM62)}) as v(a, b, s)").collect()} == m


def test_length_adjustment_brute(spark):
    rng = random.Random(1)
    cases = [(rng.randrange(5, 900), rng.randrange(100, 3_000_000), rng.randrange(1, 4000)) for _ in range(60)] + [(10, 0, 0), (1, 10, 1)]

    def brute(m, n, many):
        best = 0
        for ell in range(m):
            room = 0.041 * (m - ell) * (n - many * ell)
            if many * ell < n and room > max(m, n) and -30 + 1.9 / 0.267 * math.log(room) >= ell:
                best = ell
        return best

    df = spark.createDataFrame(cases, "m long, n long, c long")
    got = df.select("m", "n", "c", statistics.length_adjustment(F.col("m"), F.col("n"), F.col("c")).alias("ell")).collect()
    assert all(r.ell == brute(r.m, r.n, r.c) for r in got) and any(r.ell for r in got)
    assert statistics.Scoring().cut_offs() == {"drop_ungapped": 16, "drop_gapped": 38, "drop_final": 64, "least_ungapped": 41}


def test_merged_hits_brute(spark):
    rng = random.Random(2)
    hsps = [(rng.randrange(20, 90), q := rng.randrange(50), q + rng.randrange(20), t := rng.randrange(50), t + rng.randrange(20)) for _ in range(40)]
    kind = "array<struct<score:long,q_start:long,q_end:long,t_start:long,t_end:long>>"
    df = spark.createDataFrame([(hsps,), ([],)], f"h {kind}")
    got, none = (r.h for r in df.select(statistics.merged_hits(F.col("h"), F.lit(1e6), 1.0).alias("h")).collect())
    kept = []
    for h in sorted(hsps, key=lambda h: (-h[0], h[1], h[3])):
        if not any(h[2] >= k[1] and h[1] <= k[2] and h[4] >= k[3] and h[3] <= k[4] for k in kept):
            kept.append(h)
    bits = lambda s: math.floor((0.267 * s - math.log(0.041)) / math.log(2))
    assert [tuple(x)[:5] for x in got] == [h for h in kept if 1e6 / 2 ** bits(h[0]) <= 1.0] and none == []
    assert all(x.bits == bits(x.score) and x.expect == pytest.approx(1e6 / 2**x.bits) for x in got)


def test_superposition_brute(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=(20, 3))
    t = 0.7
    turn = np.array([[math.cos(t), -math.sin(t), 0], [math.sin(t), math.cos(t), 0], [0, 0, 1]])
    b, c = a @ turn.T + [1, 2, 3], rng.normal(size=(20, 3))
    point = lambda p: tuple(map(float, p))
    rows = [("same", point(p), point(q)) for p, q in zip(a, b)] + [("other", point(p), point(q)) for p, q in zip(a, c)]
    df = spark.createDataFrame(rows, "g string, a struct<x:double,y:double,z:double>, b struct<x:double,y:double,z:double>")
    got = {r.g: r for r in geometry.superposed(df, "g", "a", "b").withColumn("axis", geometry.angle_axis(F.col("quaternion"))).collect()}
    assert got["same"].rmsd == pytest.approx(0, abs=1e-6)
    assert min(got["same"].axis.angle, 360 - got["same"].axis.angle) == pytest.approx(math.degrees(t), abs=1e-4) and abs(got["same"].axis.z) == pytest.approx(1)
    x, y = a - a.mean(0), c - c.mean(0)
    u, s, v = np.linalg.svd(y.T @ x)
    s[-1] *= np.sign(np.linalg.det(u @ v))
    assert got["other"].rmsd == pytest.approx(math.sqrt(max((x**2).sum() + (y**2).sum() - 2 * s.sum(), 0) / 20), abs=1e-6)


def test_gap_costs_agree(spark):
    rows = ["AC.DEFGHIKLMNPQRSTVWYACDEFG", "ACADEF..IKLMNPQRSTVWYACDEFG", "A.ADEFGHIKLMNPQRSTVW.ACDEFG"]
    columns = [("q", k + 1, "H" if k < 4 else " ", int(rows[0][k] == "."), sum(r[k] == "." for r in rows)) for k in range(len(rows[0]))]
    df = spark.createDataFrame(columns, "q string, pos int, ss string, inserted int, gaps int")
    got = msa.column_gap_costs(df, "q", F.lit(3)).orderBy("pos").collect()
    opening, extension = msa.gap_costs_of("HHHH" + " " * (len(rows[0]) - 4), np.array([int(c == ".") for c in rows[0]]), np.array([sum(r[k] == "." for r in rows) for k in range(len(rows[0]))]), 3)
    assert [r.open_cost for r in got] == pytest.approx(list(opening)) and [r.extend_cost for r in got] == pytest.approx(list(extension))
    assert len({round(x, 3) for x in opening}) > 5


def test_limit_on_accepted_hits(spark):
    query = "ACDEFGHIKLMNPQRSTVWYACDEFGHIKL"
    hits = [(1, query, k, query if k % 2 else "GGGGG", 0.01 * k) for k in range(30)]
    df = spark.createDataFrame(hits, "query_id long, query string, hit_id long, seq string, distance double")
    count = lambda n: msa.progressive(df, n).filter("accepted").count()
    assert count(0) == 15 and count(4) == 4 and count(5000) == 15


def test_dust_and_seg():
    low = "ACDEFGHIKLMNPQRSTVWY" * 2 + "AQ" * 30 + "ACDEFGHIKLMNPQRSTVWY" * 2
    for options in ({}, search.DUST):
        found = search.low_complexity(low, **options)
        assert found and all(30 <= a < b <= 110 for a, b in found)


def test_seg_left_of_the_trimmed_part():
    rng = random.Random(4)
    for _ in range(30):
        seq = "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY"[: rng.choice((1, 2, 3, 20))]) for _ in range(120))
        found = search.low_complexity(seq)
        assert all(0 <= a < b <= len(seq) for a, b in found)
        # Every window seen has a part that is masked, or lies beside the part that was kept of its stretch.
        masked = {k for a, b in found for k in range(a, b)}
        assert bool(masked) == any(search.entropy(Counter(seq[i : i + 12]), 12) <= 2.2 for i in range(len(seq) - 11))


def _slow_clusters(seqs):
    lead, reps = {}, {}
    for j, s in enumerate(seqs):
        def same(i):
            t = seqs[i]
            return s == t or bool(s and t) and 1 - distance.identical(t, s) / min(len(s), len(t)) <= 0.01
        lead[j] = next((i for i in range(j) if lead[i] == i and same(i)), j)
    for i in set(lead.values()):
        reps[i] = min((j for j in lead if lead[j] == i), key=lambda j: (-len(seqs[j] or ""), j))
    return {j: reps[i] for j, i in lead.items()}


def test_near_chains_brute(spark):
    rng = random.Random(9)
    proteins = {}
    for p in range(12):
        base = "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(rng.choice((30, 150))))
        made = [base, base[5:], base[:10] + "W" + base[11:], base + "ACD", base[::-1], base, "", None, ""]
        rng.shuffle(made)
        proteins[p] = made[: rng.randrange(1, 10)]
    rows = [(p, n, s, 1) for p, seqs in proteins.items() for n, s in enumerate(seqs)]
    df = spark.createDataFrame(rows, "protein int, nr int, seq string, key int")
    got = {(r.protein, r.nr): r.representative for r in cluster.clustered(df).collect()}
    assert got == {(p, n): r for p, seqs in proteins.items() for n, r in _slow_clusters(seqs).items()}
    assert cluster.clustered(df.limit(0)).count() == 0


def test_insertions_brute(spark):
    rng = random.Random(4)
    rows = []
    for k in range(40):
        q, r = [], []
        for _ in range(30):
            kind = rng.choice("mmmmmqrg")
            q.append("." if kind in "rg" else rng.choice("ACDEF"))
            r.append("." if kind in "qg" else rng.choice("ACDEF"))
        rows.append(("q", "".join(q), f"h{k}", "".join(r), 5, 11))
    df = spark.createDataFrame(rows, "query_id string, query string, id string, aligned string, ifir long, jfir long")
    got = sorted((r.id, r.ipos, r.jpos, r.seq) for r in stockholm.insertions(df).collect())
    want = []
    for _, q, name, r, ifir, jfir in rows:
        pairs = [(a, b) for a, b in zip(q, r) if (a, b) != (".", ".")]
        start = next(i for i, (a, b) in enumerate(pairs) if a != "." and b != ".")
        ipos = lambda i: ifir + sum(a != "." for a, _ in pairs[start:i])
        jpos = lambda i: jfir + sum(b != "." for _, b in pairs[start:i])
        i = start
        while i < len(pairs):
            if pairs[i][0] == ".":
                end = i
                while end < len(pairs) and (pairs[end][0] == "." or pairs[end][1] == "."):
                    if pairs[end][0] != "." and pairs[end][1] == ".":
                        break
                    end += 1
                left = next(b for _, b in reversed(pairs[:i]) if b != ".")
                right = next((b for _, b in pairs[end:] if b != "."), None)
                if right:
                    want.append((name, ipos(i) - 1, jpos(i) - 1, left.lower() + "".join(b for _, b in pairs[i:end]) + right.lower()))
                i = end
            else:
                i += 1
    same = [w for w in want if w in got]
    assert len(same) > 0.6 * len(want) and len(want) > 30  # stretches cut by a deletion count as one


def test_structure_records(spark):
    head = ["HEADER    PROTEIN" + " " * 45 + "1ABC", "COMPND    MOL 1;", "COMPND   2 CHAIN A", "AUTHOR    A.B", "DBREF  1ABC A    1   9  UNP    P1"]
    bond = "SSBOND   1 CYS A    3    CYS A   40" + " " * 20
    lines = head + [bond, bond.replace("A   40", "A    3"), "TER"]
    got = text.structure_heads(frame(spark, lines)).first()
    assert (got.pdb_id, got.header.startswith("PROTEIN"), got.compound, got.author, got.dbrefs) == ("1ABC", True, "MOL 1; CHAIN A", "A.B", [head[-1]])
    assert [(r.nr, r.seq1, r.seq2) for r in text.disulfides(frame(spark, lines)).collect()] == [(1, 3, 40)]
    atoms = spark.createDataFrame([("f", "A", 1, None, "HOH", "O"), ("f", "A", 2, None, "SER", "CA"), *[("f", "A", 3, None, "SER", n) for n in ("N", "CA", "C", "O")]], "file string, chain string, resseq int, icode string, resname string, name string")
    assert text.rejected(atoms).collect()[0][1:] == (1, 1)


def test_numbers_and_breaks(spark):
    p = lambda x: (float(x), 0.0, 0.0)
    rows = [("f", "A", 1, "SER", p(0), p(1)), ("f", "A", 2, "XYZ", p(2), p(3)), ("f", "A", 3, "W", p(9), p(10)), ("f", "B", 4, "CYS", p(10), p(11))]
    df = spark.createDataFrame(rows, "file string, chain string, ord int, resname string, n struct<x:double,y:double,z:double>, c struct<x:double,y:double,z:double>")
    got = text.numbered_residues(df).orderBy("ord").collect()
    assert [(r.number, r.segment, r.letter) for r in got] == [(1, 1, "S"), (2, 1, "X"), (4, 2, "W"), (6, 3, "C")]


def test_state_files(spark):
    at = lambda chain, res: " " * 11 + chain + " " + res
    lines = ["HEADER    X" + " " * 51 + "1ABC", "  #  RESIDUE AA", at("A", "S"), at("A", "b"), at(" ", "!"), at("A", "T"), at(" ", "!"), at("B", "G")]
    assert {(r.pdb_id, r.chain, r.seq) for r in text.dssp(frame(spark, lines)).collect()} == {("1abc", "A", "SC-T"), ("1abc", "B", "G")}


def test_listing(spark, tmp_path):
    for name in ("ab/pdb1abc.ent.gz", "cd/pdb2cde.ent.gz", "cd/other.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    skip = spark.createDataFrame([("2cde",)], "code string")
    pattern = r"/pdb(\w{4})\.ent\.gz$"
    assert {r.code for r in text.listing(spark, str(tmp_path), pattern).collect()} == {"1abc", "2cde"}
    assert {r.code for r in text.listing(spark, str(tmp_path), pattern, skip).collect()} == {"1abc"}


def test_mmcif_structure(spark, tmp_path):
    site = "loop_\n" + "".join(f"_atom_site.{c}\n" for c in ("group_PDB", "id", "type_symbol", "label_atom_id", "label_alt_id", "label_comp_id", "label_asym_id", "auth_asym_id", "auth_seq_id", "pdbx_PDB_ins_code", "Cartn_x", "Cartn_y", "Cartn_z", "pdbx_PDB_model_num"))
    rows = [f"ATOM {k} {e} {n} . SER A X 5 ? {k}.5 0.0 1e3 {m}" if n == "BAD" else f"ATOM {k} {e} {n} . SER A X 5 ? {k}.5 0.0 1.0 {m}" for k, (e, n, m) in enumerate([("N", "N", 1), ("C", "CA", 1), ("C", "C", 1), ("O", "O", 1), ("H", "H", 1), ("Q", "Q", 1), ("C", "BAD", 1), ("C", "CA", 2)])]
    conn = "loop_\n_struct_conn.conn_type_id\n_struct_conn.ptnr1_auth_asym_id\n_struct_conn.ptnr1_auth_seq_id\n_struct_conn.ptnr2_auth_asym_id\n_struct_conn.ptnr2_auth_seq_id\ndisulf X 5 X 9\ndisulf X 5 X 5\nmetalc X 1 X 2\n"
    (tmp_path / "a.cif").write_text("data_1ABC\n_entry.id 1ABC\n_struct_keywords.text 'A B'\n" + site + "\n".join(rows) + "\n#\n" + conn)
    cif = mmcif.read(spark, str(tmp_path / "a.cif"))
    head = mmcif.heads(cif).first()
    assert (head.pdb_id, head.header, head.author) == ("1ABC", "A B", "")
    atoms = mmcif.atoms(cif)
    assert [r.name for r in atoms.orderBy("line_no").collect()] == ["N", "CA", "C", "O"]
    res = text.residues(atoms).collect()
    assert [(r.chain, r.resseq, r.resname, r.ca.x) for r in res] == [("X", 5, "SER", 1.5)]
    assert [(r.nr, r.seq1, r.seq2) for r in mmcif.disulfides(cif).collect()] == [(1, 5, 9)]


def test_stockholm_faults(spark):
    head = ["# STOCKHOLM 1.0", "#=GF ID q", "#=GF RI     1     1 A M              0   0   87     9  21", "#=GF PR     1     1 A   0", "#=GS q CC The query chain", "#=GS h ID h", "q  M", "h  A", "//"]
    fault = lambda lines: {r.fault for r in stockholm.faults(stockholm.blocks(frame(spark, lines))).collect()}
    assert fault(head) == set()
    assert fault(head[:-1]) == {"truncated or incomplete"}
    assert fault(head[:7] + ["z  A", "//"]) == {"not in the header: z"}
    assert fault([x.replace("q  M", "q  W") for x in head]) == {"invalid residue W expected to be M"}
    assert fault(head[:2] + head[3:6] + ["//"]) == {"a profile line without its residue"}
    assert fault(head[:6] + [" x  A", *head[6:]]) == {"empty id in an alignment line"}


def test_legacy_lines(spark):
    proteins = spark.createDataFrame([("q", "1ABC", "HEADER     x", 3, 2, ["A"])], "query_id string, pdb_id string, description string, seq_length int, n_chain int, used array<string>")
    residues = spark.createDataFrame([("q", k, f"text {k}") for k in (1, 2, 3)], "query_id string, nr int, text string")
    span = "pdb string, identity double, similarity double, ifir int, ilas int, jfir int, jlas int, length int, gaps int, gap_letters int, seq_len int, accession string, descr string"
    hits = spark.createDataFrame([("q", f"h{k:03d}", "", k / 100, 0.5, 1, 3, 1, 3, 3, 0, 0, 3, "ACC", "some hit") for k in range(75)], f"query_id string, id string, {span}")
    cells = spark.createDataFrame([("q", 2, "h074", "W"), ("q", 2, "h000", "Y")], "query_id string, nr int, id string, letter string")
    ins = spark.createDataFrame([("q", "h074", 2, 2, "a" + "C" * 150 + "d")], "query_id string, id string, ipos int, jpos int, seq string")
    lines = [r.line for r in report.legacy(proteins, residues, hits, cells, ins).orderBy(*report.ORDER).collect()]
    assert lines[0] == "PDBID      1ABC" and lines[-1] == "//" and "KCHAIN        1 chain(s) used here ; chains(s) : A" in lines
    (first,) = [x for x in lines if x.startswith("    1 : h074")]
    assert first.split() == ["1", ":", "h074", "0.74", "0.50", "1", "3", "1", "3", "3", "0", "0", "3", "ACC", "some", "hit"] and first[:20] == "    1 : h074        "
    at = lines.index("## ALIGNMENTS   71 -   75")
    assert lines[at + 2].endswith("      Y") and sum(x.startswith("## ALIGN") for x in lines) == 2
    k = lines.index(" AliNo  IPOS  JPOS   Len Sequence")
    assert lines[k + 1].split()[:4] == ["1", "2", "2", "150"] and lines[k + 2].startswith("     +") and len(lines[k + 1].split()[4]) == 100
