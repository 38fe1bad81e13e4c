"""Text rows of profile reports, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from foldline.functions.alphabet import PROFILE_ORDER


def fixed_length(text: Column, size: int) -> Column:
    """Right-aligned text; an arrow where it is too long."""
    return F.when(F.length(text) <= size, F.lpad(text, size, " ")).otherwise(F.concat(F.lit("-" * (size - 1)), F.lit(">")))


def variability_digit(value: Column) -> Column:
    """0 to 9 for 0.0 to 0.9 and over; + outside 0 to 1."""
    return F.when((value < 0) | (value > 1), "+").otherwise(F.least(F.floor(value * 10), F.lit(9)).cast("string"))


def disulfide_letter(letter: Column, bridge: Column) -> Column:
    """Cysteines in bridges by lower-case letters."""
    return F.when((letter == "C") & (bridge > 0), F.char(97 + (bridge - 1) % 26)).otherwise(letter)


def residue_lines(rows: DataFrame) -> DataFrame:
    """(seq_nr, line) of residues (chain, seq_nr, pdb_nr, letter, ss, nocc, weight, accessibility); a break row where numbers jump."""
    w = Window.partitionBy("chain").orderBy("seq_nr")
    t = rows.withColumn("gap", F.coalesce(F.col("seq_nr") != F.lag("seq_nr").over(w) + 1, F.lit(False)))
    line = F.concat_ws(" ", F.lit("#=GF RI"), fixed_length(F.col("seq_nr").cast("string"), 5), fixed_length(F.col("pdb_nr").cast("string"), 6), "chain", "letter", "ss", fixed_length(F.floor(F.col("accessibility") + 0.5).cast("string"), 4), fixed_length(F.col("nocc").cast("string"), 5), fixed_length(F.floor(100 * (1 - F.col("weight"))).cast("string"), 4))
    broken = t.filter("gap").select((F.col("seq_nr") - 1).alias("seq_nr"), F.concat(F.lit("#=GF RI "), fixed_length((F.col("seq_nr") - 1).cast("string"), 5), F.lit("        !  !")).alias("line"))
    return t.select("seq_nr", line.alias("line")).unionByName(broken)


def profile_lines(rows: DataFrame) -> DataFrame:
    """(seq_nr, line): the frequencies of the twenty residues in percent, from a map column freq; then nocc, ndel, nins, entropy, relent, weight."""
    shares = [fixed_length(F.floor(100 * F.coalesce(F.col("freq")[c], F.lit(0.0)) + 0.5).cast("string"), 4) for c in PROFILE_ORDER]
    rest = [fixed_length(F.col(c).cast("string"), 5) for c in ("nocc", "ndel", "nins")]
    return rows.select("seq_nr", F.concat(F.lit("#=GF PR "), fixed_length(F.col("seq_nr").cast("string"), 5), *shares, *rest, F.format_string(" %6.3f %4d %5.2f", F.col("entropy").cast("double"), F.floor("relent").cast("int"), F.col("weight").cast("double"))).alias("line"))


def alignment_lines(rows: DataFrame, id_col: str, seq_col: str, width: int = 72) -> DataFrame:
    """(block, id, line): aligned rows in blocks of columns."""
    t = rows.filter(F.length(seq_col) > 0).select(F.col(id_col).alias("id"), F.col(seq_col).alias("s"), F.explode(F.sequence(F.lit(0), F.floor((F.length(seq_col) - 1) / width).cast("int"))).alias("block"))
    return t.select("block", "id", F.concat(F.rpad(F.col("id").cast("string"), 20, " "), F.lit(" "), F.col("s").substr(F.col("block") * width + 1, F.lit(width))).alias("line"))


def hit_lines(hits: DataFrame, label: str = "score") -> DataFrame:
    """(nr, line) of hits (id, identity, similarity, ifir, ilas, jfir, jlas, length, gaps, gap_letters, seq_len), numbered by identity and name within one report."""
    nr = F.row_number().over(Window.partitionBy("report").orderBy(F.desc("identity"), "id", "ifir"))
    line = F.format_string(f"#=GS %s {label}=%4.2f/%4.2f aligned=%d-%d/%d-%d length=%d ngaps=%d gaplen=%d seqlen=%d", F.col("id").cast("string"), "identity", "similarity", "ifir", "ilas", "jfir", "jlas", "length", "gaps", "gap_letters", "seq_len")
    return hits.select("report", nr.alias("nr"), line.alias("line"))
