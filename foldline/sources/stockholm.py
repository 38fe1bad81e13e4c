"""Annotated alignments in the Stockholm format, as tables of what their lines say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from foldline.functions.alphabet import PROFILE_ORDER

SAME = r"^#=GF CC Chain (.+) is considered to be the same as (.+)$"
NUMBERS = ("score", "similarity")
SPANS = r"HSSP score=([\d.]+)/([\d.]+) aligned=(\d+)-(\d+)/(\d+)-(\d+) length=(\d+) ngaps=(\d+) gaplen=(\d+) seqlen=(\d+)"
SPAN_NAMES = ("ifir", "ilas", "jfir", "jlas", "length", "gaps", "gap_letters", "seq_len")


def blocks(lines: DataFrame) -> DataFrame:
    """(file, line_no, block, query_id, value) of lines (file, line_no, value): // ends a block, #=GF ID names its query."""
    before = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file", "block")
    v = F.col("value")
    t = lines.filter(F.length(F.trim(v)) > 0).withColumn("block", F.coalesce(F.sum((v == "//").cast("int")).over(before), F.lit(0)))
    return t.withColumn("query_id", F.max(F.when(v.startswith("#=GF ID "), v.substr(F.lit(9), F.length(v)))).over(whole))


def heads(rows: DataFrame) -> DataFrame:
    """(file, block, query_id, pdb_id, description, same): the header's lines, and the chains that are the same as this one."""
    v = F.col("value")
    known = v.rlike(r"^#=GF CC (HEADER|COMPND|SOURCE|AUTHOR|DBREF ) ")
    text = F.concat(v.substr(9, 7), F.lit("    "), v.substr(F.lit(16), F.length(v)))
    said = F.array_sort(F.collect_list(F.when(known, F.struct("line_no", text.alias("text")))))
    same = F.max(F.when(v.rlike(SAME), F.regexp_extract(v, SAME, 2)))
    out = rows.groupBy("file", "block").agg(F.max("query_id").alias("query_id"), F.max(F.when(v.startswith("#=GF CC PDBID  "), v.substr(F.lit(16), F.length(v)))).alias("pdb_id"), said.alias("said"), same.alias("same"))
    return out.select("file", "block", "query_id", "pdb_id", F.array_join(F.transform("said", lambda x: x["text"]), "\n").alias("description"), F.when(F.col("same").isNull(), F.array().cast("array<string>")).otherwise(F.split("same", r" *(?:\band\b|,) *")).alias("same"))


def residues(rows: DataFrame) -> DataFrame:
    """(file, block, seq_nr, pdb_nr, chain, letter, structure, bp1, bp2, accessibility, nocc, variability, is_break) of the RI lines."""
    v = F.col("value")

    def cut(a: int, n: int, kind: str = "string") -> Column:
        t = F.trim(v.substr(a, n))
        return t if kind == "string" else t.try_cast(kind)

    t = rows.filter(v.startswith("#=GF RI "))
    return t.select("file", "block", cut(9, 5, "long").alias("seq_nr"), cut(15, 5, "long").alias("pdb_nr"), v.substr(21, 1).alias("chain"), v.substr(23, 1).alias("letter"), v.substr(26, 9).alias("structure"), cut(36, 4, "long").alias("bp1"), cut(40, 4, "long").alias("bp2"), cut(44, 5, "long").alias("accessibility"), cut(50, 5, "long").alias("nocc"), cut(55, 4, "long").alias("variability"), (v.substr(23, 1) == "!").alias("is_break"))


def profiles(rows: DataFrame) -> DataFrame:
    """(file, block, seq_nr, pdb_nr, shares, nocc, ndel, nins, entropy, relent, weight) of the PR lines; shares has a per cent for each residue."""
    v = F.col("value")

    def cut(a: int, n: int, kind: str) -> Column:
        return F.trim(v.substr(a, n)).try_cast(kind)

    shares = F.create_map(*[x for k, c in enumerate(PROFILE_ORDER) for x in (F.lit(c), cut(22 + 4 * k, 4, "long"))])
    t = rows.filter(v.startswith("#=GF PR "))
    return t.select("file", "block", cut(9, 5, "long").alias("seq_nr"), cut(15, 5, "long").alias("pdb_nr"), shares.alias("shares"), *[cut(a, 4, "long").alias(n) for a, n in ((104, "nocc"), (109, "ndel"), (114, "nins"))], cut(120, 6, "double").alias("entropy"), cut(129, 4, "long").alias("relent"), cut(134, 5, "double").alias("weight"))


def aligned(rows: DataFrame) -> DataFrame:
    """(file, block, query_id, id, aligned): the alignment's rows, their pieces joined in order; a row is as long as the query."""
    t = rows.filter(~F.col("value").startswith("#") & (F.col("value") != "//"))
    t = t.select("file", "block", "query_id", "line_no", F.regexp_extract("value", r"^(\S*)", 1).alias("id"), F.regexp_extract("value", r"^\S*\s+(.*)$", 1).alias("piece"))
    parts = F.array_sort(F.collect_list(F.struct("line_no", "piece")))
    return t.groupBy("file", "block", "query_id", "id").agg(F.array_join(F.transform(parts, lambda x: x["piece"]), "").alias("aligned"))


def hits(rows: DataFrame) -> DataFrame:
    """(file, block, id, accession, descr, pdb, score, similarity, ifir ... seq_len) of the GS lines, a row a hit."""
    v = F.col("value")
    t = rows.filter(v.startswith("#=GS ")).select("file", "block", "query_id", F.regexp_extract(v, r"^#=GS (\S+)", 1).alias("id"), F.regexp_extract(v, r"^#=GS \S+\s+(.*)$", 1).alias("said")).filter("id <> query_id or said not like 'CC %'")
    said = F.col("said")

    def last(start: str) -> Column:
        return F.max(F.when(said.startswith(start), said.substr(F.lit(len(start) + 1), F.length(said))))

    span = F.max(F.when(said.rlike(SPANS), said))
    out = t.groupBy("file", "block", "id").agg(last("ID ").alias("accession"), last("DE ").alias("descr"), F.substring(last("DR PDB "), 1, 4).alias("pdb"), span.alias("span"))
    numbers = [F.regexp_extract("span", SPANS, k + 1).try_cast("double").alias(n) for k, n in enumerate(NUMBERS)] + [F.regexp_extract("span", SPANS, k + 3).try_cast("long").alias(n) for k, n in enumerate(SPAN_NAMES)]
    return out.select("file", "block", "id", "accession", "descr", "pdb", *numbers)


def faults(rows: DataFrame) -> DataFrame:
    """(file, block, fault) of what makes a file unreadable: no end, no query, an unknown row, an empty name, PR without RI, wrong residues."""
    v = F.col("value")
    names = hits(rows).select("file", "block", "id").union(rows.select("file", "block", "query_id")).distinct()
    al = aligned(rows)
    found = [
        rows.groupBy("file", "block").agg(F.max((v == "//").cast("int")).alias("ended"), F.max("query_id").alias("q")).select("file", "block", F.when(F.col("ended") == 0, "truncated or incomplete").when(F.col("q").isNull(), "no query").alias("fault")),
        al.filter("id = ''").select("file", "block", F.lit("empty id in an alignment line").alias("fault")),
        al.filter("id <> ''").join(names, ["file", "block", "id"], "left_anti").select("file", "block", F.concat(F.lit("not in the header: "), "id").alias("fault")),
    ]
    ri = residues(rows)
    pr = rows.filter(v.startswith("#=GF PR ")).select("file", "block", F.trim(v.substr(9, 5)).try_cast("long").alias("seq_nr"))
    found.append(pr.join(ri.select("file", "block", "seq_nr"), ["file", "block", "seq_nr"], "left_anti").select("file", "block", F.lit("a profile line without its residue").alias("fault")))
    w = Window.partitionBy("file", "block").orderBy("seq_nr")
    want = ri.filter("not is_break").select("file", "block", F.row_number().over(w).alias("k"), "letter")
    got = al.filter("id = query_id").select("file", "block", F.posexplode(F.filter(F.split("aligned", ""), lambda c: (c != "") & ~c.isin(" ", ".", "-"))).alias("k", "res")).withColumn("k", F.col("k") + 1)
    both = want.join(got, ["file", "block", "k"], "right")
    wrong = F.col("letter").isNull() | ((F.col("res") != F.col("letter")) & ~((F.col("res") == "C") | F.col("letter").rlike("^[a-z]$")))
    found.append(both.filter(wrong).select("file", "block", F.concat(F.lit("invalid residue "), "res", F.lit(" expected to be "), F.coalesce("letter", F.lit("none"))).alias("fault")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.filter("fault is not null").distinct()


def insertions(rows: DataFrame) -> DataFrame:
    """(query_id, id, ipos, jpos, seq) of rows (query_id, query, id, aligned, ifir, jfir): stretches where a hit has residues and the query none.

    seq has the residues on either side in lower case; ipos and jpos are those of the first of them. Queries and hits are aligned texts of one length.
    """
    w = Window.partitionBy("query_id", "id").orderBy("k")
    cells = rows.select("query_id", "id", "ifir", "jfir", F.posexplode(F.arrays_zip(F.split("query", "").alias("q"), F.split("aligned", "").alias("r"))).alias("k", "c"))
    gap = lambda c: c.isin(" ", ".", "-", "") | c.isNull()
    t = cells.select("query_id", "id", "ifir", "jfir", "k", gap(F.col("c.q")).alias("qgap"), gap(F.col("c.r")).alias("rgap"), F.col("c.r").alias("r")).filter("not (qgap and rgap)")
    t = t.withColumn("i", F.sum((~F.col("qgap") & ~F.col("rgap")).cast("int")).over(w)).withColumn("here", F.sum((~F.col("qgap")).cast("int")).over(w)).withColumn("j", F.sum((~F.col("rgap")).cast("int")).over(w))
    first = Window.partitionBy("query_id", "id")
    t = t.withColumn("start", F.min(F.when(~F.col("qgap") & ~F.col("rgap"), F.col("here"))).over(first)).withColumn("lead_j", F.min(F.when(~F.col("qgap") & ~F.col("rgap"), F.col("j"))).over(first))
    inside = t.filter("not rgap").withColumn("left", F.lag("r").over(w)).withColumn("right", F.lead("r").over(w))
    ins = inside.filter("qgap and i > 0").groupBy("query_id", "id", "ifir", "jfir", "i", "start", "lead_j").agg(F.min("here").alias("here"), F.min("j").alias("j"), F.array_sort(F.collect_list(F.struct("k", "r"))).alias("mid"), F.min_by("left", "k").alias("left"), F.max_by("right", "k").alias("right"))
    seq = F.concat(F.lower("left"), F.array_join(F.transform("mid", lambda x: x["r"]), ""), F.lower("right"))
    return ins.filter("right is not null").select("query_id", "id", (F.col("ifir") + F.col("here") - F.col("start")).alias("ipos"), (F.col("jfir") + F.col("j") - 1 - F.col("lead_j")).alias("jpos"), seq.alias("seq"))
