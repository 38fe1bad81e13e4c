"""Crystallographic information files as long rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from foldline.functions.alphabet import known_element, plain_float


def tokens(text: str):
    """(token, quoted) of a file: bare words, quoted strings, text blocks between lines that begin with ;."""
    lines, k = text.splitlines(), 0
    while k < len(lines):
        line = lines[k]
        k += 1
        if line.startswith(";"):
            block = [line[1:]]
            while k < len(lines) and not lines[k].startswith(";"):
                block.append(lines[k])
                k += 1
            k += 1
            yield "\n".join(block), True
            continue
        at = 0
        while at < len(line):
            c = line[at]
            if c.isspace():
                at += 1
            elif c == "#":
                break
            elif c in "'\"":
                end = at + 1  # a quote ends where white space or the line's end follows it
                while (end := line.find(c, end)) >= 0 and end + 1 < len(line) and not line[end + 1].isspace():
                    end += 1
                end = len(line) if end < 0 else end
                yield line[at + 1 : end], True
                at = end + 1
            else:
                end = at
                while end < len(line) and not line[end].isspace():
                    end += 1
                yield line[at:end], False
                at = end


def rows(text: str):
    """(category, row, field, value) of a file with one data block."""
    names: list[str] = []
    mode, count, begun, pending, single = "", 0, False, None, {}
    for token, quoted in tokens(text):
        word = "" if quoted else token
        if word.lower().startswith("data_"):
            if begun:
                raise ValueError("a second data block")
            begun = True
        elif not begun:
            raise ValueError("no data block")
        elif word.lower() == "loop_":
            names, mode, count = [], "names", 0
        elif word.startswith("_") and mode == "names":
            names.append(word)
        elif word.startswith("_"):
            mode, pending = "", word
        elif mode in ("names", "values") and pending is None:
            mode = "values"
            category, _, field = names[count % len(names)].partition(".")
            yield category, count // len(names), field, token
            count += 1
        elif pending is not None:
            category, _, field = pending.partition(".")
            yield category, 0, field, token
            pending = None
        else:
            raise ValueError(f"unexpected {token!r}")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, category, row, field, value); a file is a row's whole text."""
    from pyspark.sql import types as T

    out = T.ArrayType(T.StructType([T.StructField("category", T.StringType()), T.StructField("row", T.IntegerType()), T.StructField("field", T.StringType()), T.StructField("value", T.StringType())]))
    parsed = F.udf(lambda text: list(rows(text)), out)  # a call a file
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.col("_metadata.file_path").alias("file"), F.explode(parsed("value")).alias("r")).select("file", "r.*")


def field(cif: DataFrame, category: str, name: str, delimiter: str = " ") -> DataFrame:
    """(file, value): a field's values joined in row order."""
    some = cif.filter((F.col("category") == category) & (F.col("field") == name))
    ordered = F.array_sort(F.collect_list(F.struct("row", "value")))
    return some.groupBy("file").agg(F.array_join(F.transform(ordered, lambda x: F.trim(x["value"])), delimiter).alias("value"))


def wide(cif: DataFrame, category: str, fields: list[str]) -> DataFrame:
    """A row for each row of a category, with the named fields as columns."""
    return cif.filter(F.col("category") == category).groupBy("file", "row").pivot("field", fields).agg(F.first("value"))


def heads(cif: DataFrame) -> DataFrame:
    """(file, pdb_id, header, compound, source, author) of an entry."""
    out = field(cif, "_entry", "id").withColumnRenamed("value", "pdb_id")
    for name, category, column, between in (("header", "_struct_keywords", "text", " "), ("compound", "_entity", "pdbx_description", "; "), ("source", "_entity_src_gen", "pdbx_gene_src_scientific_name", "; "), ("author", "_audit_author", "name", "; ")):
        out = out.join(field(cif, category, column, between).withColumnRenamed("value", name), "file", "left").na.fill("", [name])
    return out


def atoms(cif: DataFrame) -> DataFrame:
    """Atom rows as of PDB lines, of the first model: author's chain names, both chain ids kept; no hydrogens or unknown elements."""
    names = ["group_PDB", "id", "type_symbol", "label_atom_id", "label_alt_id", "label_comp_id", "label_asym_id", "auth_asym_id", "auth_seq_id", "pdbx_PDB_ins_code", "Cartn_x", "Cartn_y", "Cartn_z", "pdbx_PDB_model_num"]
    t = wide(cif, "_atom_site", names)
    first = t.groupBy("file").agg(F.min_by("pdbx_PDB_model_num", "row").alias("model"))

    def known(c: str):
        return F.when(F.col(c).isin("?", "."), None).otherwise(F.col(c))

    t = t.join(first, "file").filter("pdbx_PDB_model_num <=> model").filter(known_element(F.col("type_symbol")) & (F.upper("type_symbol") != "H"))
    xyz = [plain_float(F.col(f"Cartn_{c}")).alias(c) for c in "xyz"]
    return t.select("file", F.col("row").alias("line_no"), F.col("group_PDB").alias("record"), F.col("id").try_cast("int").alias("serial"), F.col("label_atom_id").alias("name"), F.coalesce(known("label_alt_id"), F.lit(" ")).alias("altloc"), F.col("label_comp_id").alias("resname"), F.col("auth_asym_id").alias("chain"), F.col("label_asym_id").alias("label_chain"), F.col("auth_seq_id").try_cast("int").alias("resseq"), known("pdbx_PDB_ins_code").alias("icode"), *xyz, F.col("type_symbol").alias("element")).filter("x is not null and y is not null and z is not null")


def disulfides(cif: DataFrame) -> DataFrame:
    """(file, nr, chain1, seq1, chain2, seq2) of the disulfide connections, numbered in their order."""
    names = ["conn_type_id", "ptnr1_auth_asym_id", "ptnr1_auth_seq_id", "ptnr2_auth_asym_id", "ptnr2_auth_seq_id"]
    t = wide(cif, "_struct_conn", names).filter("conn_type_id = 'disulf'")
    t = t.select("file", "row", F.col(names[1]).alias("chain1"), F.col(names[2]).try_cast("long").alias("seq1"), F.col(names[3]).alias("chain2"), F.col(names[4]).try_cast("long").alias("seq2")).filter("not (chain1 = chain2 and seq1 = seq2)")
    return t.select("file", F.row_number().over(Window.partitionBy("file").orderBy("row")).alias("nr"), "chain1", "seq1", "chain2", "seq2")
