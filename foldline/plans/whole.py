"""Queries that go through files: sequences written and read back, and all the way from sequence files to report files."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldline.plans import homology as H
from foldline.plans.queries import LETTERS, items, query
from foldline.plans.scratch import scratch, written
from foldline.sources import files
from foldline.sources import stockholm as sto


@query(f"select 'i' || item_id as id, 'item of ' || length({LETTERS}) || ' letters' as defline, {LETTERS} as seq, case when length({LETTERS}) = 0 then 'no letters' end as fault from benchmark")
def fasta_files(spark, d):
    """Items written as FASTA files and read back in pieces of 2 KB, records that lie across their borders included."""
    files.register(spark)
    folder = scratch(spark)
    t = items(spark, d)
    t.select(F.concat(F.lit("i"), "id").alias("id"), F.concat(F.lit("item of "), F.length("seq").cast("string"), F.lit(" letters")).alias("defline"), "seq").write.format("fasta").mode("append").save(folder)
    return spark.read.format("fasta").option("split", "2048").load(folder).select("id", "defline", "seq", "fault")


def _found(spark, d):
    """Items by way of FASTA files, all of them searched in all of them."""
    files.register(spark)
    folder = scratch(spark)
    items(spark, d).select(F.concat(F.lit("i"), "id").alias("id"), F.lit("").alias("defline"), "seq").write.format("fasta").mode("append").save(folder)
    read = written(spark.read.format("fasta").load(folder).filter("fault is null").select(F.substring("id", 2, 20).cast("long").alias("id"), "seq"))
    return read, H.homology(read, read)


@query()
def homology_profile(spark, d):
    """Profiles of all items over their homologues among the items."""
    _, found = _found(spark, d)
    return found.columns.select("query_id", "pos", "seq_nr", "letter", "nocc", "ndel", "nins", F.round("entropy", 6).alias("entropy"), "weight")


@query()
def homology_report(spark, d):
    """Sequence files to report files; the residues and the numbers of the hits that the files say."""
    read, found = _found(spark, d)
    names = read.select("id", F.lit(None).cast("int").alias("databank"), F.concat(F.lit("i"), "id").alias("name"), F.length("seq").alias("seq_len"))
    names = names.unionByName(names.withColumn("databank", F.lit(0)))
    folder = scratch(spark)
    files.write_reports(H.report_lines(found, names), folder)
    rows = sto.blocks(files.read_lines(spark, folder))
    n_hits = sto.hits(rows).groupBy("file").agg(F.count("*").alias("n_hits"))
    residues = sto.residues(rows).filter("not is_break").select("file", "seq_nr", "letter", "nocc", "variability")
    return residues.join(n_hits, "file", "left").na.fill(0, ["n_hits"]).withColumnRenamed("file", "query_id")
