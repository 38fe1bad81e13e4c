"""Whole reports as ordered lines: annotated Stockholm files and the older column format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from foldline.functions.alphabet import PROFILE_ORDER
from foldline.plans.output import disulfide_letter, fixed_length, variability_digit

WIDTH, PANEL, MOST_HITS, INSERTION = 72, 70, 9999, 100
ORDER = ("section", "place", "row")


def structure_string(ss: Column, flags: list[Column], bend: Column, chirality: Column, ladders: list[Column], parallel: list[Column]) -> Column:
    """Nine characters: state, blank, three helix flags, bend, chirality and two ladder letters, small where parallel."""

    def ladder(n: Column, small: Column) -> Column:
        letter = F.char(65 + n % 26)
        return F.when(n.isNull(), " ").otherwise(F.when(small, F.lower(letter)).otherwise(letter))

    return F.concat(ss, F.lit(" "), *flags, F.when(bend, "S").otherwise(" "), chirality, *[ladder(n, p) for n, p in zip(ladders, parallel, strict=True)])


def listed(names: Column) -> Column:
    """a, b and c."""
    n = F.size(names)
    return F.when(n <= 1, F.array_join(names, "")).otherwise(F.concat(F.array_join(F.slice(names, F.lit(1), n - 1), ", "), F.lit(" and "), F.element_at(names, -1)))


def _lines(t: DataFrame, section: int, place: Column, row: Column, line: Column) -> DataFrame:
    return t.select("query_id", F.lit(section).alias("section"), place.cast("long").alias("place"), row.cast("long").alias("row"), line.alias("line"))


def _number(value: Column, size: int) -> Column:
    return fixed_length(value.cast("string"), size)


def _tail(t: DataFrame) -> list[Column]:
    """The wide columns that residue and profile lines end with."""
    return [F.lit("  "), fixed_length(F.col("chain"), 4), F.lit("      "), fixed_length(F.col("auth_chain"), 4), *[x for c in ("seq_nr", "pdb_nr", "bp1", "bp2") for x in (F.lit(" "), _number(F.col(c), 10))]]


def head_lines(queries: DataFrame) -> DataFrame:
    """From queries (query_id, date, pdb_id, header, compound, source, author, dbrefs, chain, n_chains, used, same)."""
    cc = F.lit("#=GF CC ")
    parts = [F.lit("# STOCKHOLM 1.0"), F.concat(cc, F.lit("DATE   "), F.col("date").cast("string"))]
    parts += [F.when(F.length(c) > 0, F.concat(cc, F.lit(n), c)) for n, c in (("PDBID  ", F.col("pdb_id")), ("HEADER ", F.col("header")), ("COMPND ", F.col("compound")), ("SOURCE ", F.col("source")), ("AUTHOR ", F.col("author")))]
    chains = F.concat(cc, F.lit("PDB file contains "), F.col("n_chains").cast("string"), F.lit(" chains. Used chain"), F.when(F.size("used") > 1, "s are ").otherwise(" is "), listed(F.col("used")))
    same = F.concat(cc, F.lit("Chain "), "chain", F.lit(" is considered to be the same as "), listed(F.col("same")))
    many = F.col("n_chains") > 1
    end = [F.when(many, chains), F.when(many & (F.size("same") > 0), same), F.concat(F.lit("#=GF ID "), "query_id"), F.concat(F.lit("#=GF SQ "), F.col("n_hits").cast("string"))]
    all_lines = F.concat(F.array(*parts), F.transform(F.coalesce("dbrefs", F.array().cast("array<string>")), lambda x: F.concat(cc, x)), F.array(*end))
    t = queries.select("query_id", F.posexplode(F.filter(all_lines, lambda x: x.isNotNull())).alias("place", "line"))
    return _lines(t, 0, F.col("place"), F.lit(0), F.col("line"))


def residue_section(residues: DataFrame) -> DataFrame:
    """RI and PR lines of residues (query_id, seq_nr, pdb_nr, icode, chain, auth_chain, letter, bridge, structure, bp1, bp2, accessibility,
    nocc, ndel, nins, entropy, weight, freq), with a line for each break in the numbers."""
    w = Window.partitionBy("query_id").orderBy("seq_nr")
    t = residues.withColumn("gap", F.coalesce(F.col("seq_nr") != F.lag("seq_nr").over(w) + 1, F.lit(False)))
    broken = t.filter("gap").withColumn("nr", F.col("seq_nr") - 1)
    weight = F.floor(100 * (1 - F.col("weight"))).cast("int")
    ri = F.concat(F.lit("#=GF RI "), _number(F.col("seq_nr"), 5), F.lit(" "), _number(F.col("pdb_nr"), 5), F.coalesce("icode", F.lit(" ")), fixed_length(F.col("chain"), 1), F.lit(" "), disulfide_letter(F.col("letter"), F.col("bridge")), F.lit("  "), F.rpad("structure", 9, " "), F.lit(" "), _number(F.col("bp1"), 4), _number(F.col("bp2"), 4), _number(F.floor(F.col("accessibility") + 0.5), 5), F.lit(" "), _number(F.col("nocc"), 5), _number(weight, 4), *_tail(t))
    shares = [_number(F.floor(100 * F.coalesce(F.col("freq")[c], F.lit(0.0)) + 0.5), 4) for c in PROFILE_ORDER]
    relent = F.floor(100 * F.col("entropy") / F.log(F.lit(20.0))).cast("int")
    pr = F.concat(F.lit("#=GF PR "), _number(F.col("seq_nr"), 5), F.lit(" "), _number(F.col("pdb_nr"), 5), F.coalesce("icode", F.lit(" ")), F.when(F.length("chain") <= 1, F.col("chain")).otherwise(">"), *shares, F.lit("  "), _number(F.col("nocc"), 4), F.lit(" "), _number(F.col("ndel"), 4), F.lit(" "), _number(F.col("nins"), 4), F.format_string("  %6.3f   %4d %5.2f ", F.col("entropy").cast("double"), relent, F.col("weight").cast("double")), *_tail(t))
    heads = residues.select("query_id").distinct()
    none = F.lit("   0" * 20 + "     0    0    0   0.000      0  1.00")
    return (
        _lines(heads, 1, F.lit(-1), F.lit(0), F.lit("#=GF CC ## RESIDUE INFORMATION"))
        .unionByName(_lines(heads, 1, F.lit(-1), F.lit(1), F.lit("#=GF CC SeqNo   PDBNo AA STRUCTURE BP1 BP2  ACC  NOCC VAR CHAIN AUTHCHAIN     NUMBER     RESNUM        BP1        BP2")))
        .unionByName(_lines(t, 1, F.col("seq_nr"), F.lit(0), ri))
        .unionByName(_lines(broken, 1, F.col("nr"), F.lit(0), F.concat(F.lit("#=GF RI "), _number(F.col("nr"), 5), F.lit("       ! !              0   0    0     0   0"))))
        .unionByName(_lines(heads, 2, F.lit(-1), F.lit(0), F.lit("#=GF CC ## SEQUENCE PROFILE AND ENTROPY")))
        .unionByName(_lines(t, 2, F.col("seq_nr"), F.lit(0), pr))
        .unionByName(_lines(broken, 2, F.col("nr"), F.lit(0), F.concat(F.lit("#=GF PR "), _number(F.col("nr"), 5), F.lit("        "), none)))
    )


def hit_section(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """GS lines of hits (query_id, nr, id, accession, descr, score, similarity, ifir ... seq_len, pdbs), names padded to the longest."""
    wide = hits.groupBy("query_id").agg(F.max(F.length("id")).alias("most"))
    q = queries.select("query_id").join(wide, "query_id", "left").withColumn("width", F.greatest(F.length("query_id"), F.coalesce("most", F.lit(0))))
    t = hits.join(q.select("query_id", "width"), "query_id")
    name = F.concat(F.lit("#=GS "), F.expr("rpad(id, width, ' ')"), F.lit(" "))
    span = F.format_string("HSSP score=%4.2f/%4.2f aligned=%d-%d/%d-%d length=%d ngaps=%d gaplen=%d seqlen=%d", *[F.col(c) for c in ("score", "similarity", "ifir", "ilas", "jfir", "jlas", "length", "gaps", "gap_letters", "seq_len")])
    refs = F.when(F.size("pdbs") > 0, F.concat(name, F.lit("DR PDB "), F.array_join("pdbs", ", ")))
    lines = F.filter(F.array(F.concat(name, F.lit("ID "), "accession"), F.concat(name, F.lit("DE "), "descr"), F.concat(name, span), refs), lambda x: x.isNotNull())
    t = t.select("query_id", "nr", F.posexplode(lines).alias("row", "line"))
    first = _lines(q, 3, F.lit(-1), F.lit(0), F.concat(F.lit("#=GS "), F.expr("rpad(query_id, width, ' ')"), F.lit(" CC The query chain")))
    return first.unionByName(_lines(t, 3, F.col("nr"), F.col("row"), F.col("line")))


def alignment_section(queries: DataFrame, hits: DataFrame, columns: DataFrame) -> DataFrame:
    """Blocks of 72 columns: the query (query_id, aligned), its hits (query_id, nr, id, aligned), then state, entropy and variability
    from columns (query_id, pos, ss, entropy, weight); columns without a residue have dots and dashes."""
    names = queries.select("query_id", F.lit(0).cast("long").alias("nr"), F.col("query_id").alias("id"), "aligned").unionByName(hits.select("query_id", F.col("nr").cast("long").alias("nr"), "id", "aligned"))
    width = names.groupBy("query_id").agg(F.greatest(F.max(F.length("id")), F.lit(17)).alias("width"))
    t = names.join(width, "query_id").select("query_id", "nr", F.expr("rpad(id, width + 1, ' ')").alias("name"), F.posexplode(F.regexp_extract_all("aligned", F.lit(f".{{1,{WIDTH}}}"), 0)).alias("block", "piece"))
    rows = _lines(t, 4, F.col("block"), F.col("nr"), F.concat("name", "piece"))
    per = columns.withColumn("block", F.floor((F.col("pos") - 1) / WIDTH)).groupBy("query_id", "block").agg(F.array_sort(F.collect_list(F.struct("pos", F.when(F.col("ss") == " ", "C").otherwise(F.coalesce("ss", F.lit("."))).alias("ss"), F.when(F.col("ss").isNull(), "-").otherwise(variability_digit(F.col("entropy") / F.log(F.lit(20.0)))).alias("ent"), F.when(F.col("ss").isNull(), "-").otherwise(variability_digit(1 - F.col("weight"))).alias("var")))).alias("cells"))
    per = per.join(width, "query_id").select("query_id", "block", "width", F.posexplode(F.array(*[F.struct(F.lit(n).alias("tag"), F.array_join(F.col("cells")[f], "").alias("text")) for n, f in (("#=GC SS", "ss"), ("#=GC Entropy", "ent"), ("#=GC Variability", "var"))])).alias("k", "x"))
    marks = _lines(per, 4, F.col("block"), F.lit(1 << 40) + F.col("k"), F.concat(F.expr("rpad(x.tag, width + 1, ' ')"), F.col("x.text")))
    blank = _lines(t.select("query_id", "block").distinct(), 4, F.col("block"), F.lit(-1), F.lit(""))
    return blank.unionByName(rows).unionByName(marks)


def stockholm(queries: DataFrame, residues: DataFrame, hits: DataFrame, columns: DataFrame) -> DataFrame:
    """(query_id, section, place, row, line): in that order the lines of each query's file."""
    counted = queries.join(hits.groupBy("query_id").agg(F.count("*").alias("n_hits")), "query_id", "left").na.fill(0, ["n_hits"])
    end = _lines(queries, 5, F.lit(0), F.lit(0), F.lit("//"))
    return head_lines(counted).unionByName(residue_section(residues)).unionByName(hit_section(queries, hits)).unionByName(alignment_section(queries, hits, columns)).unionByName(end)


def legacy(proteins: DataFrame, residues: DataFrame, hits: DataFrame, cells: DataFrame, insertions: DataFrame) -> DataFrame:
    """(query_id, section, place, row, line) of the older format, with the MOST_HITS best hits by identity, name and first residue.

    proteins: query_id, pdb_id, description, seq_length, n_chain, used; residues: query_id, nr, text (the RI text of 43 columns);
    hits: query_id, id, pdb, identity, similarity, ifir ... seq_len, accession, descr; cells: query_id, nr, id, letter (one character of a
    hit under a residue); insertions: query_id, id, ipos, jpos, seq.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("identity"), "id", "ifir")
    ranked = hits.withColumn("hit_nr", F.row_number().over(order)).filter(F.col("hit_nr") <= MOST_HITS)
    n = ranked.groupBy("query_id").agg(F.count("*").alias("n_hits"))
    p = proteins.join(n, "query_id", "left").na.fill(0, ["n_hits"])
    used = F.when(F.size("used") < F.col("n_chain"), F.concat(F.lit("KCHAIN     "), _number(F.size("used"), 4), F.lit(" chain(s) used here ; chains(s) : "), F.array_join("used", ",")))
    about = F.split("description", "\n")  # a line each
    rest = F.array(F.concat(F.lit("SEQLENGTH "), _number(F.col("seq_length"), 5)), F.concat(F.lit("NCHAIN     "), _number(F.col("n_chain"), 4), F.lit(" chain(s) in "), "pdb_id", F.lit(" data set")), used, F.concat(F.lit("NALIGN     "), _number(F.col("n_hits"), 4)), F.lit("## PROTEINS : identifier and alignment statistics"), F.lit("  NR.    ID         STRID   %IDE %WSIM IFIR ILAS JFIR JLAS LALI NGAP LGAP LSEQ2 ACCNUM     PROTEIN"))
    head = F.filter(F.concat(F.array(F.concat(F.lit("PDBID      "), "pdb_id")), about, rest), lambda x: F.length(x) > 0)
    top = _lines(p.select("query_id", F.posexplode(head).alias("k", "line")), 0, F.col("k"), F.lit(0), F.col("line"))
    spans = [_number(F.col(c), 5) for c in ("ifir", "ilas", "jfir", "jlas", "length", "gaps", "gap_letters", "seq_len")]
    protein = F.concat(_number(F.col("hit_nr"), 5), F.lit(" : "), F.rpad(F.substring("id", 1, 12), 12, " "), F.rpad(F.coalesce("pdb", F.lit("")), 4, " "), F.format_string("    %4.2f  %4.2f", F.col("identity").cast("double"), F.col("similarity").cast("double")), *spans, F.lit("  "), F.rpad(F.substring("accession", 1, 10), 10, " "), F.lit(" "), F.col("descr"))
    listing = _lines(ranked, 1, F.col("hit_nr"), F.lit(0), protein)
    # Panels of 70 hits: a line a residue with a character a hit.
    panels = p.filter("n_hits > 0").select("query_id", "n_hits", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_hits") - 1) / PANEL).cast("long"))).alias("panel"))
    title = _lines(panels, 2, F.col("panel"), F.lit(-1), F.concat(F.lit("## ALIGNMENTS "), _number(F.col("panel") * PANEL + 1, 4), F.lit(" - "), _number(F.least("n_hits", (F.col("panel") + 1) * PANEL), 4)))
    own = cells.join(ranked.select("query_id", "id", "hit_nr"), ["query_id", "id"]).withColumn("panel", F.floor((F.col("hit_nr") - 1) / PANEL)).withColumn("at", (F.col("hit_nr") - 1) % PANEL)
    packed = own.groupBy("query_id", "nr", "panel").agg(F.map_from_entries(F.collect_list(F.struct("at", "letter"))).alias("letters"))
    text = F.rtrim(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(PANEL - 1)), lambda k: F.coalesce(F.col("letters")[k.cast("long")], F.lit(" "))), ""))
    body = residues.join(panels, "query_id").join(packed, ["query_id", "nr", "panel"], "left")
    rows = _lines(body, 2, F.col("panel"), F.col("nr"), F.concat(F.lit(" "), _number(F.col("nr"), 5), F.rpad("text", 43, " "), F.lit("  "), F.coalesce(text, F.lit(""))))
    # Insertions, wrapped at 100 letters.
    ins = insertions.join(ranked.select("query_id", "id", "hit_nr"), ["query_id", "id"])
    pieces = ins.select("query_id", "hit_nr", "ipos", "jpos", F.length("seq").alias("size"), F.posexplode(F.regexp_extract_all("seq", F.lit(f".{{1,{INSERTION}}}"), 0)).alias("k", "piece"))
    line = F.when(F.col("k") == 0, F.concat(F.lit(" "), F.array_join(F.array(*[_number(F.col(c), 5) for c in ("hit_nr", "ipos", "jpos")], _number(F.col("size") - 2, 5)), " "), F.lit(" "), "piece")).otherwise(F.concat(F.lit("     +" + " " * 19), "piece"))
    inserted = _lines(pieces, 4, F.col("hit_nr"), F.col("ipos") * 100_000 + F.col("k"), line)
    ends = _lines(p, 3, F.lit(0), F.lit(0), F.lit("## INSERTION LIST")).unionByName(_lines(p, 3, F.lit(1), F.lit(0), F.lit(" AliNo  IPOS  JPOS   Len Sequence"))).unionByName(_lines(p, 5, F.lit(0), F.lit(0), F.lit("//")))
    return top.unionByName(listing).unionByName(title).unionByName(rows).unionByName(inserted).unionByName(ends)
