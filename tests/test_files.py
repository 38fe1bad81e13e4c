"""Data sources of sequence files and reports, and the way from one to the other."""

import bz2
import gzip
import io
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from foldline.plans import homology
from foldline.plans.queries import QUERIES
from foldline.sources import files

TEXT = ">one first thing\nACD\nEF\n>two\nGG>H\n\n>three x\r\nK L\r\n>empty\n>\nLL\n>last\nAC"
WANT = [("one", "first thing", "ACDEF", None), ("two", "", "GG>H", None), ("three", "x", "KL", None), ("empty", "", "", "no letters"), ("", "", "LL", "no id"), ("last", "", "AC", None)]


def read(spark, path, split=None):
    files.register(spark)
    r = spark.read.format("fasta")
    return (r.option("split", str(split)) if split else r).load(str(path))


def test_records_wherever_files_are_cut():
    data = TEXT.encode()
    whole = list(files.records(io.BytesIO(data), 0, 1 << 40))
    assert [(h, s) for _, h, s in whole] == [("one first thing", "ACDEF"), ("two", "GG>H"), ("three x", "KL"), ("empty", ""), ("", "LL"), ("last", "AC")]
    assert all(data[p : p + 1] == b">" for p, _, _ in whole)
    for split in range(1, len(data) + 2):
        found = []
        for a, b in files.ranges(len(data), split):
            stream = io.BytesIO(data)
            stream.seek(max(a - 1, 0))
            found += files.records(stream, a, b)
        assert found == whole, split
    assert files.ranges(0, 10) == [(0, 0)]


def test_fasta_source(spark, tmp_path):
    folder = tmp_path / "bank"
    (folder / "deeper").mkdir(parents=True)
    (folder / "a.fa").write_text(TEXT)
    (folder / "deeper" / "b.fa").write_text("AC\n>b 1\nAA\n")
    (folder / "_hidden").write_text(">no\nA\n")
    (folder / "empty.fa").write_text("")
    with gzip.open(folder / "c.fa.gz", "wt") as f:
        f.write(TEXT)
    with bz2.open(folder / "d.fa.bz2", "wt") as f:
        f.write(TEXT)
    for split in (None, 7):
        got = read(spark, folder, split).collect()
        by_file = defaultdict(list)
        for r in got:
            by_file[r.file.rpartition("/")[2]].append((r.place, r.id, r.defline, r.seq, r.fault))
        assert sorted(by_file) == ["a.fa", "b.fa", "c.fa.gz", "d.fa.bz2"]
        for name in ("a.fa", "c.fa.gz", "d.fa.bz2"):
            assert [x[1:] for x in sorted(by_file[name])] == WANT
        assert sorted(by_file["b.fa"]) == [(0, "", "", "AC", "no record at the beginning"), (3, "b", "1", "AA", None)]
    assert len(read(spark, folder / "a.fa").collect()) == 6 and len(read(spark, f"file://{folder}/a.fa", 20).collect()) == 6
    with pytest.raises(Exception, match="there is no"):
        read(spark, tmp_path / "nothing").count()


def test_fasta_writer(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"s{k}", "a b" if k % 3 else None, "".join(rng.choice("ACDE") for _ in range(rng.choice((0, 1, 71, 72, 73, 300)))) if k % 10 else None) for k in range(60)]
    files.register(spark)
    df = spark.createDataFrame(rows, "id string, defline string, seq string").repartition(5)
    out = str(tmp_path / "out")
    df.write.format("fasta").mode("append").save(out)
    assert {p.name.partition("-")[0] for p in (tmp_path / "out").iterdir()} == {"part", "_SUCCESS", "_temporary"} and not list((tmp_path / "out" / "_temporary").iterdir())
    assert max(len(line) for p in (tmp_path / "out").glob("part*") for line in p.read_text().split("\n")) == 72
    got = Counter((r.id, r.defline, r.seq) for r in read(spark, out, 100).collect())
    assert got == Counter((k, d or "", s) for k, d, s in rows if s is not None)
    two = df.filter("id in ('s1', 's2')")
    two.write.format("fasta").mode("append").save(out)  # adds
    assert read(spark, out).count() == sum(got.values()) + 2
    two.write.format("fasta").mode("overwrite").save(out)
    assert {r.id for r in read(spark, out).collect()} == {"s1", "s2"}

    def fails(batches):
        yield next(batches)
        raise RuntimeError("in the middle")

    broken = df.mapInArrow(fails, df.schema)
    before = sorted(p.name for p in (tmp_path / "out").glob("part*"))
    with pytest.raises(Exception):
        broken.write.format("fasta").mode("append").save(out)
    assert sorted(p.name for p in (tmp_path / "out").glob("part*")) == before and {r.id for r in read(spark, out).collect()} == {"s1", "s2"}


def test_reports_keep_their_order(spark, tmp_path):
    rng = random.Random(1)
    rows = [(q, s, p, r, f"{q} {s} {p} {r}" if r != 2 else "") for q in ("a/b", "q 1", "é", "x") for s in range(3) for p in range(-1, 20) for r in range(3)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "query_id string, section int, place long, row long, line string").repartition(7)
    files.write_reports(df, str(tmp_path / "r"))
    assert len(list((tmp_path / "r").glob("*.sto"))) == 4
    got = defaultdict(list)
    for r in sorted(files.read_lines(spark, str(tmp_path / "r")).collect(), key=lambda r: r.line_no):
        got[r.file].append(r.value)
    assert got == {q: [line for *_, line in sorted(r for r in rows if r[0] == q)] for q in ("a/b", "q 1", "é", "x")}


def test_from_sequences_to_profiles(spark):
    rng = random.Random(9)
    letters = "ACDEFGHIKLMNPQRSTVWY"
    query = "".join(rng.choice(letters) for _ in range(100))

    def edited(n):
        out = list(query)
        for _ in range(n):
            at = rng.randrange(len(out))
            out[at : at + rng.randrange(2)] = [rng.choice(letters) for _ in range(rng.randrange(1, 3))]
        return "".join(out)

    bank = spark.createDataFrame([(k, edited(k)) for k in range(12)] + [(50, "".join(rng.choice(letters) for _ in range(100)))], "id long, seq string")
    other = spark.createDataFrame([(1, edited(3))], "id long, seq string")
    asked = spark.createDataFrame([(0, query), (1, "ACD"), (2, "".join(rng.choice(letters) for _ in range(60)))], "id long, seq string")
    found = homology.homology(asked, bank, other)
    rows = [r for r in found.rows.collect() if r.query_id == 0]
    assert {(r.databank, r.target_id) for r in rows if r.hit_id is not None} >= {(0, k) for k in range(6)} | {(1, 1)} and (0, 50) not in {(r.databank, r.target_id) for r in rows}
    columns = {r.pos: r for r in found.columns.filter("query_id = 0").collect()}
    width = len(rows[0].aligned)
    assert sorted(columns) == list(range(1, width + 1)) and [columns[p].letter for p in sorted(columns)] == list(next(r.aligned for r in rows if r.hit_id is None))
    assert [columns[p].seq_nr for p in sorted(columns) if columns[p].seq_nr] == list(range(1, 101))
    for p, c in columns.items():
        n = Counter(r.aligned[p - 1] for r in rows if r.aligned[p - 1] not in ".X")
        assert c.nocc == sum(n.values()) and c.freq == pytest.approx({k: v / c.nocc for k, v in n.items()})
        assert c.entropy == pytest.approx(-sum(v / c.nocc * math.log(v / c.nocc) for v in n.values()), abs=1e-9) and c.weight <= 1
    assert sum(c.nins for c in columns.values()) > 0
    alone = found.columns.filter("query_id = 2").collect()
    assert len(alone) == 60 and all(r.nocc == 1 and r.entropy == 0 and r.weight == 1 for r in alone) and found.columns.filter("query_id = 1").count() == 0


def test_report_files_say_what_the_profile_says(spark, sf):
    profile = QUERIES["homology_profile"](spark, sf).filter("seq_nr is not null").select(F.concat(F.lit("i"), "query_id").alias("q"), "seq_nr", "letter", "nocc", F.floor(100 * (1 - F.col("weight"))).cast("long").alias("v"))
    said = QUERIES["homology_report"](spark, sf).select("query_id", "seq_nr", "letter", "nocc", "variability")
    assert Counter(map(tuple, profile.collect())) == Counter(map(tuple, said.collect()))
