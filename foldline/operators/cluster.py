"""Chains of a protein that are equal or nearly so, each group named after its longest chain."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldline.operators.distance import sequence_distance

NEAR = 0.01


def near_equal(a: str, b: str, most: float = NEAR):
    """Whether two sequences differ in at most a share most of the shorter one's letters."""
    n = F.nullif(F.least(F.length(a), F.length(b)), F.lit(0))
    return 1 - (1 - sequence_distance(a, b)) * F.greatest(F.length(a), F.length(b)) / n <= most + 1e-9


def clustered(chains: DataFrame, protein: str = "protein", nr: str = "nr", seq: str = "seq") -> DataFrame:
    """(protein, nr, representative) of chains (protein, nr, seq).

    In order of nr, a chain joins the first leader that it is nearly equal to, or leads itself; the longest chain of a group,
    the first of several, stands for it. Equal sequences are compared once; pairs of different ones are rows of a join
    on the protein, whose chains are few. Null sequences are a group of their own in each protein, as
    are empty ones.
    """
    named = chains.select(F.col(protein).alias("p"), F.col(nr).alias("nr"), F.col(seq).alias("seq"), F.coalesce(F.md5(seq), F.lit("")).alias("key"))
    texts = named.groupBy("p", "key").agg(F.min_by("seq", "nr").alias("seq"), F.min("nr").alias("nr"))
    a, b = (texts.filter(F.length("seq") > 0).select("p", F.col("nr").alias(f"{x}_nr"), F.col("seq").alias(x)) for x in "ab")
    pairs = a.join(b, (a["p"].eqNullSafe(b["p"])) & (F.col("a_nr") < F.col("b_nr"))).select(a["p"], "a_nr", "b_nr", "a", "b")
    earlier = pairs.filter(near_equal("a", "b")).groupBy(F.col("p").alias("e_p"), "b_nr").agg(F.collect_list("a_nr").alias("earlier"))
    joined = texts.join(earlier, F.col("p").eqNullSafe(F.col("e_p")) & (F.col("nr") == F.col("b_nr")), "left")
    # Short lists: a protein's different chains by number, length and the numbers of earlier chains alike.
    rows = joined.groupBy("p").agg(F.array_sort(F.collect_list(F.struct("nr", F.coalesce(F.length("seq"), F.lit(0)).alias("n"), F.coalesce("earlier", F.array().cast(f"array<{chains.schema[nr].dataType.simpleString()}>")).alias("earlier")))).alias("rows"))
    none = F.expr("transform(slice(rows, 1, 0), x -> named_struct('nr', x.nr, 'leader', x.nr, 'n', x.n))")

    def joins(done, row):
        alike = F.filter(done, lambda d: (d["nr"] == d["leader"]) & F.array_contains(row["earlier"], d["nr"]))
        leader = F.coalesce(F.array_min(F.transform(alike, lambda d: d["nr"])), row["nr"])
        return F.concat(done, F.array(F.struct(row["nr"].alias("nr"), leader.alias("leader"), row["n"].alias("n"))))

    led = rows.select("p", F.explode(F.aggregate("rows", none, joins)).alias("r")).select("p", "r.*")
    longest = F.first("nr").over(Window.partitionBy("p", "leader").orderBy(F.desc("n"), "nr"))
    of = led.select(F.col("p").alias("l_p"), F.col("nr").alias("l_nr"), longest.alias("representative"))
    keyed = texts.join(of, F.col("p").eqNullSafe(F.col("l_p")) & (F.col("nr") == F.col("l_nr"))).select(F.col("p").alias("k_p"), F.col("key").alias("k"), "representative")
    return named.join(keyed, F.col("p").eqNullSafe(F.col("k_p")) & (F.col("key") == F.col("k"))).select(F.col("p").alias(protein), F.col("nr").alias(nr), "representative")
