"""Text formats of sequences and structures as DataFrames, read by Spark's text source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from foldline.functions.alphabet import known_element, residue_of
from foldline.functions.geometry import distance


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(id, defline, seq): records begin with > at a line's start; a file's first line must.

    Compressed files are read by their suffix. Records without an id or without letters are left out.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("v"))
    head = F.substring_index(F.regexp_replace("v", "\r", ""), "\n", 1)
    body = F.regexp_replace(F.expr("substring(v, instr(v, '\n') + 1)"), r"\s+", "")
    out = raw.filter(F.col("v").contains("\n")).select(F.regexp_extract(head, r"^(\S*)", 1).alias("id"), F.regexp_extract(head, r"^\S*\s+(.*)$", 1).alias("defline"), body.alias("seq"))
    return out.filter("id <> '' and seq <> ''")


def atoms(lines: DataFrame) -> DataFrame:
    """Atom rows from the lines (file, line_no, value) of PDB files: first model only, no hydrogens, no unknown elements, no short lines."""
    first_end = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = lines.withColumn("ended", F.coalesce(F.max(F.col("value").startswith("ENDMDL")).over(first_end), F.lit(False))).filter(~F.col("ended"))
    v = F.col("value")
    rows = rows.filter((v.startswith("ATOM  ") | v.startswith("HETATM")) & (F.length(v) >= 80))

    def cut(a: int, b: int):
        return F.trim(v.substr(a, b - a + 1))

    parsed = rows.select("file", "line_no", cut(1, 6).alias("record"), cut(7, 11).cast("int").alias("serial"), cut(13, 16).alias("name"), v.substr(17, 1).alias("altloc"), cut(18, 20).alias("resname"), v.substr(22, 1).alias("chain"), cut(23, 26).cast("int").alias("resseq"), F.nullif(cut(27, 27), F.lit("")).alias("icode"), cut(31, 38).cast("double").alias("x"), cut(39, 46).cast("double").alias("y"), cut(47, 54).cast("double").alias("z"), cut(77, 78).alias("element"))
    return parsed.filter(known_element(F.col("element"))).filter("upper(element) <> 'H' and x is not null and y is not null and z is not null")


def residues(atom_rows: DataFrame) -> DataFrame:
    """Complete residues (with N, CA, C and O): first alternative location only, in file order."""
    w = Window.partitionBy("file", "chain", "resseq", "icode").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kept = atom_rows.withColumn("first", F.first(F.when(F.col("altloc") != " ", F.col("altloc")), ignorenulls=True).over(w)).filter("altloc = ' ' or altloc = first")
    at = [F.max(F.when(F.col("name") == n, F.struct("x", "y", "z"))).alias(n.lower()) for n in ("N", "CA", "C", "O")]
    whole = kept.groupBy("file", "chain", "resseq", "icode").agg(F.min("line_no").alias("ord"), F.first("resname").alias("resname"), *at)
    return whole.filter("n is not null and ca is not null and c is not null and o is not null")


def clusters(lines: DataFrame) -> DataFrame:
    """(file, cluster, member, is_representative) from cluster lists; headers number the clusters of a file."""
    w = Window.partitionBy("file").orderBy("line_no")
    v = F.col("value")
    rows = lines.withColumn("cluster", F.sum(v.startswith(">Cluster").cast("int")).over(w) - 1).filter(~v.startswith(">Cluster"))
    return rows.select("file", "cluster", F.regexp_extract(v, r">(.+?)\.\.\.", 1).alias("member"), v.rlike(r"\*\s*$").alias("is_representative")).filter("member <> ''")


def stockholm_profile(lines: DataFrame) -> DataFrame:
    """(file, block, row_no, kind, value) of the annotation lines of Stockholm files; blocks end at //."""
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    v = F.col("value")
    rows = lines.withColumn("block", F.coalesce(F.sum((v == "//").cast("int")).over(w), F.lit(0)))
    kind = F.regexp_extract(v, r"^#=G[FSC]\s+(?:\S+\s+)??([A-Z]{2})\b", 1)
    return rows.filter(v.startswith("#=G")).select("file", "block", F.col("line_no").alias("row_no"), kind.alias("kind"), F.regexp_replace(v, r"^#=G[FSC]\s+", "").alias("value"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value): each file whole, for formats whose lines depend on those before."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value"))
    return whole.filter("value <> ''")


def structure_heads(lines: DataFrame) -> DataFrame:
    """(file, pdb_id, header, compound, source, author, dbrefs) from the head records of PDB files, continued lines joined."""
    v = F.col("value")
    t = lines.withColumn("record", F.trim(v.substr(1, 6))).withColumn("text", F.regexp_replace(F.rtrim(v.substr(11, 70)), r"\s+", " "))

    def joined(record: str):
        parts = F.array_sort(F.collect_list(F.when(F.col("record") == record, F.struct("line_no", F.trim("text").alias("text")))))
        return F.array_join(F.transform(parts, lambda x: x["text"]), " ")

    refs = F.array_sort(F.collect_list(F.when(F.col("record") == "DBREF", F.struct("line_no", F.rtrim(v).alias("text")))))
    return t.groupBy("file").agg(F.max(F.when(F.col("record") == "HEADER", F.trim(v.substr(63, 4)))).alias("pdb_id"), joined("HEADER").alias("header"), joined("COMPND").alias("compound"), joined("SOURCE").alias("source"), joined("AUTHOR").alias("author"), F.transform(refs, lambda x: x["text"]).alias("dbrefs"))


def disulfides(lines: DataFrame) -> DataFrame:
    """(file, nr, chain1, seq1, icode1, chain2, seq2, icode2) of the SSBOND records; bonds of a residue with itself go, the rest is numbered anew."""
    v = F.col("value")
    t = lines.filter(v.startswith("SSBOND")).select("file", "line_no", v.substr(16, 1).alias("chain1"), F.trim(v.substr(18, 4)).try_cast("long").alias("seq1"), v.substr(22, 1).alias("icode1"), v.substr(30, 1).alias("chain2"), F.trim(v.substr(32, 4)).try_cast("long").alias("seq2"), v.substr(36, 1).alias("icode2"))
    t = t.filter("seq1 is not null and seq2 is not null and not (chain1 = chain2 and seq1 = seq2 and icode1 = icode2)")
    return t.select("file", F.row_number().over(Window.partitionBy("file").orderBy("line_no")).alias("nr"), "chain1", "seq1", "icode1", "chain2", "seq2", "icode2")


def rejected(atom_rows: DataFrame) -> DataFrame:
    """(file, waters, incomplete): how many waters, and other residues without a whole backbone, are left out."""
    has = [F.max((F.col("name") == n).cast("int")) for n in ("N", "CA", "C", "O")]
    per = atom_rows.groupBy("file", "chain", "resseq", "icode", "resname").agg(sum(has[1:], has[0]).alias("there")).filter("there < 4")
    return per.groupBy("file").agg(F.count_if(F.col("resname") == "HOH").alias("waters"), F.count_if(F.col("resname") != "HOH").alias("incomplete"))


def numbered_residues(residue_rows: DataFrame, most: float = 2.5) -> DataFrame:
    """Adds letter, segment and number: numbers go on by one, and skip one at each break and each new chain.

    A chain breaks where the next N is more than `most` from the C before.
    """
    chain = Window.partitionBy("file", "chain").orderBy("ord")
    whole = Window.partitionBy("file").orderBy("ord")
    before = F.lag("c").over(chain)
    t = residue_rows.withColumn("is_break", (before.isNotNull() & (distance(before, F.col("n")) > most)).cast("int")).withColumn("starts", before.isNull().cast("int"))
    segment = F.sum(F.col("is_break") + F.col("starts")).over(whole)
    return t.withColumn("segment", segment).withColumn("number", F.row_number().over(whole) - 1 + F.col("segment")).withColumn("letter", residue_of(F.col("resname"))).drop("is_break", "starts")


def dssp(lines: DataFrame) -> DataFrame:
    """(file, pdb_id, chain, seq) of state files: lower-case letters are cysteines, - stands for a break within a chain."""
    w = Window.partitionBy("file").orderBy("line_no")
    v = F.col("value")
    started = F.max(v.startswith("  #  RESIDUE").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    t = lines.withColumn("body", F.coalesce(started, F.lit(0))).withColumn("pdb_id", F.max(F.when(v.startswith("HEADER"), F.lower(F.substring(v, 63, 4)))).over(Window.partitionBy("file")))
    t = t.filter("body = 1").select("file", "line_no", "pdb_id", v.substr(12, 1).alias("chain"), v.substr(14, 1).alias("res"))
    mark = (F.col("chain") == " ") & (F.col("res") == "!")
    t = t.withColumn("is_break", mark).withColumn("after_break", F.coalesce(F.lag("is_break").over(w), F.lit(False))).filter("not is_break")
    res = F.when(F.col("res").rlike("[a-z]"), "C").otherwise(F.col("res"))
    cut = F.when(F.col("after_break") & (F.lag("chain").over(w) == F.col("chain")), "-").otherwise("")
    cells = F.array_sort(F.collect_list(F.struct("line_no", F.concat("cut", "res").alias("text"))))
    t = t.withColumn("cut", cut).withColumn("res", res)
    return t.groupBy("file", "pdb_id", "chain").agg(F.array_join(F.transform(cells, lambda x: x["text"]), "").alias("seq"))


def listing(spark: SparkSession, path: str, pattern: str, skip: DataFrame | None = None) -> DataFrame:
    """(path, code) of the files below a folder, at any depth, whose name has the form of pattern (group 1 is the code), without the codes to skip.

    Only names are read, no contents.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    found = files.select("path", F.regexp_extract("path", pattern, 1).alias("code")).filter("code <> ''")
    return found if skip is None else found.join(skip.select("code"), "code", "left_anti").select("path", "code")
