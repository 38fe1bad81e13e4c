"""From sequences to reports: search, distances, progressive alignment, profile, conservation, annotated alignment."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from foldline.operators.distance import sequence_distance
from foldline.operators.msa import progressive
from foldline.operators.profile import conservation
from foldline.operators.search import search
from foldline.plans import report
from foldline.plans.scratch import written

LEAST = 25  # letters of a query


@dataclass
class Homology:
    """rows (query_id, hit_id, databank, target_id, aligned, the alignment's numbers): the accepted hits, and each query's own row with null hit_id;
    columns (query_id, pos, seq_nr, letter, nocc, ndel, nins, entropy, weight, freq): the profile, seq_nr null in columns that hits have inserted."""

    rows: DataFrame
    columns: DataFrame


def homology(queries: DataFrame, *databanks: DataFrame, expect: float = 10.0, most: int = 1500, max_hits: int = 5000) -> Homology:
    """All tables have id (long) and seq. Of the queries those of LEAST letters and more are searched; queries whose hits are all rejected have a profile of themselves."""
    asked = queries.filter(F.length("seq") >= LEAST)
    found = search(asked, *databanks, expect=expect, most=most).filter("nr = 1").select("query_id", "databank", "target_id")
    n = len(databanks)
    bank = None
    for k, df in enumerate(databanks):
        own = df.select(F.lit(k).alias("databank"), F.col("id").alias("target_id"), "seq")
        bank = own if bank is None else bank.unionByName(own)
    own = asked.select(F.col("id").alias("query_id"), F.col("seq").alias("query"))
    hits = found.join(bank, ["databank", "target_id"]).join(own, "query_id").select("query_id", "query", (F.col("target_id") * n + F.col("databank")).alias("hit_id"), "seq")
    tasks = max(4 * queries.sparkSession.sparkContext.defaultParallelism, int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    hits = hits.repartition(tasks, "query_id", "hit_id").withColumn("distance", sequence_distance("query", "seq"))
    # A query without hits is aligned to nothing: its row comes from a hit that is never accepted.
    nothing = own.select("query_id", "query", F.lit(None).cast("long").alias("hit_id"), F.lit(None).cast("string").alias("seq"), F.lit(None).cast("double").alias("distance"))
    lonely = nothing.withColumn("hit_id", F.lit(-1).cast("long"))
    aligned = progressive(hits.unionByName(lonely), max_hits)
    kept = aligned.filter("aligned is not null").withColumn("databank", F.pmod("hit_id", F.lit(n)).cast("int")).withColumn("target_id", F.expr(f"hit_id div {n}"))
    rows = written(kept)
    return Homology(rows, written(profile(rows)))


def profile(rows: DataFrame) -> DataFrame:
    """The columns of aligned rows: residues by column, insertions and deletions, entropy, conservation."""
    whole = rows.filter("hit_id is null")
    cells = whole.select("query_id", F.posexplode(F.arrays_zip(F.split("aligned", "").alias("letter"), F.col("inserted"), F.col("deleted"))).alias("k", "c")).filter("c.letter <> ''")
    running = F.sum((F.col("letter") != ".").cast("int")).over(Window.partitionBy("query_id").orderBy("pos"))
    own = cells.select("query_id", (F.col("k") + 1).alias("pos"), F.col("c.letter").alias("letter"), F.col("c.inserted").alias("nins"), F.col("c.deleted").alias("ndel"))
    own = own.withColumn("seq_nr", F.when(F.col("letter") != ".", running))
    letters = rows.select("query_id", F.posexplode(F.split("aligned", "")).alias("k", "res")).filter("res not in ('', '.', '-', ' ', 'X')")
    counts = letters.groupBy("query_id", (F.col("k") + 1).alias("pos"), "res").agg(F.count("*").alias("n"))
    common = counts.filter("res not in ('B', 'Z')")
    by_column = counts.groupBy("query_id", "pos").agg(F.sum("n").alias("nocc"))
    shares = common.join(by_column, ["query_id", "pos"]).withColumn("f", F.col("n") / F.col("nocc"))
    stats = shares.groupBy("query_id", "pos").agg((-F.sum(F.col("f") * F.log("f")) + 0.0).alias("entropy"), F.map_from_entries(F.collect_list(F.struct("res", "f"))).alias("freq"))
    weight = conservation(rows.withColumn("hit", F.coalesce("hit_id", F.lit(-1))), "hit", "aligned", group="query_id")
    out = own.join(by_column, ["query_id", "pos"], "left").join(stats, ["query_id", "pos"], "left").join(weight, ["query_id", "pos"], "left")
    return out.select("query_id", F.col("pos").cast("long").alias("pos"), F.col("seq_nr").cast("long").alias("seq_nr"), "letter", F.coalesce("nocc", F.lit(0)).alias("nocc"), F.col("ndel").cast("long").alias("ndel"), F.col("nins").cast("long").alias("nins"), F.greatest(F.coalesce("entropy", F.lit(0.0)), F.lit(0.0)).alias("entropy"), F.coalesce("weight", F.lit(1.0)).alias("weight"), "freq")


def report_lines(found: Homology, names: DataFrame) -> DataFrame:
    """(query_id, section, place, row, line) of the annotated alignments; names has id and name of the queries, and of targets by (databank, target_id)."""
    named = names.select(F.col("id").alias("n_id"), F.col("databank").alias("n_bank"), "name", "seq_len")
    own = found.rows.filter("hit_id is null").join(named.filter("n_bank is null").drop("n_bank"), F.col("query_id") == F.col("n_id")).select("query_id", "name", "aligned")
    none = F.lit("")
    queries = own.select(F.col("name").alias("query_id"), F.lit(None).cast("string").alias("date"), *[none.alias(c) for c in ("pdb_id", "header", "compound", "source", "author")], F.array().cast("array<string>").alias("dbrefs"), F.lit("A").alias("chain"), F.lit(1).alias("n_chains"), F.array(F.lit("A")).alias("used"), F.array().cast("array<string>").alias("same"), "aligned")
    order = Window.partitionBy("query_id").orderBy(F.desc("share"), "hit_id")
    hits = found.rows.filter("hit_id is not null").join(named.withColumnRenamed("name", "id"), (F.col("databank") == F.col("n_bank")) & (F.col("target_id") == F.col("n_id")))
    hits = hits.withColumn("share", F.col("identical") / F.col("length")).withColumn("nr", F.row_number().over(order)).join(own.select("query_id", "name"), "query_id")
    span = F.format_string("%s/%d-%d", "id", "jfir", "jlas")
    hits = hits.select(F.col("name").alias("query_id"), "nr", span.alias("id"), F.col("id").alias("accession"), none.alias("descr"), F.col("share").alias("score"), (F.col("similar") / F.col("length")).alias("similarity"), "ifir", "ilas", "jfir", "jlas", "length", "gaps", F.col("gapn").alias("gap_letters"), "seq_len", F.array().cast("array<string>").alias("pdbs"), "aligned")
    columns = found.columns.join(own.select("query_id", "name"), "query_id").drop("query_id").withColumnRenamed("name", "query_id")
    zero = F.lit(0)
    residues = columns.filter("seq_nr is not null").select("query_id", "seq_nr", F.col("seq_nr").alias("pdb_nr"), F.lit(" ").alias("icode"), F.lit("A").alias("chain"), F.lit("A").alias("auth_chain"), "letter", zero.alias("bridge"), none.alias("structure"), zero.alias("bp1"), zero.alias("bp2"), F.lit(0.0).alias("accessibility"), "nocc", "ndel", "nins", "entropy", "weight", "freq")
    cells = columns.select("query_id", "pos", F.when(F.col("seq_nr").isNotNull(), " ").alias("ss"), "entropy", "weight")
    return report.stockholm(queries, residues, hits, cells)
