"""Mixing sources to target weights: capped water-filling, then whole and fractional repetitions.

A total is shared out by weight; a source whose share exceeds its size times the maximum of epochs stops there, and what is
left is shared out again by weight among the others, until no share is too large. Sources are taken in order of size by weight: in
that order those that stop come first, so that running sums give the last round's result at once.

A source's documents are repeated as often as its target allows as a whole; the rest is filled with documents in a
seeded random order, each whole, up to the target: those whose middle lies below it, so that a source misses its target
by half a document at most. Running sums go over ranges of that order, never over a source in one task.

Defined cases: null and empty texts have size 0 and are taken 0 times 0 words; a null source is a source, the last; repeated rows are
documents of their own; rows of one doc_id and text are interchangeable; sources without words have target 0; where
all sources stop, the mix is as large as that allows; an empty table gives an empty table; extra columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from foldline.llm.common import broadcast_below, stored, table
from foldline.llm.ordering import ordered

NAME = "op13_source_mixing"
WORDS = r"[^\x20\x09-\x0D]+"


def water_filled(sources: DataFrame, share: float, most: float) -> DataFrame:
    """Adds target to sources (source_size, weight, a row each): share times all sizes by weight, at most `most` times a
    source's size. The table of sources goes through one task's window; it has a row for each source, whatever there is to mix."""
    total = F.sum("source_size").over(Window.partitionBy()) * share
    by_room = Window.orderBy(F.asc_nulls_last(F.try_divide("source_size", "weight")), "source_size", "source")
    stopped_before = F.coalesce(F.sum("source_size").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * most
    weight_left = F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing))
    rows = sources.withColumn("_total", total).withColumn("_share", F.try_divide(F.col("weight") * (F.col("_total") - stopped_before), weight_left))
    rows = rows.withColumn("_stops", F.coalesce(F.col("_share") > F.col("source_size") * most, F.lit(False)))
    everything = Window.partitionBy()
    stopped = F.coalesce(F.sum(F.when(F.col("_stops"), F.col("source_size"))).over(everything), F.lit(0)) * most
    free = F.sum(F.when(~F.col("_stops"), F.col("weight"))).over(everything)
    level = F.try_divide(F.col("_total") - stopped, free.cast("double"))
    target = F.when(F.col("_stops"), F.col("source_size") * most).otherwise(F.coalesce(F.col("weight") * level, F.lit(0.0)))
    return rows.withColumn("target", target).drop("_total", "_share", "_stops")


def cyclic_weights(sources: DataFrame, weights: tuple = (3, 1, 2)) -> DataFrame:
    """Adds weight: these, repeating, to the sources by code point, null last."""
    at = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    return sources.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (at % len(weights)).cast("int") + 1))


def mixed(docs: DataFrame, key: Column, size: Column, source: Column, weigh=cyclic_weights, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(row, size, source_size, target, times): how often the mix takes each row of docs, at most `most` times, rounded up.

    key: what decides about the random order; weigh: adds weight to a table (source, source_size).
    """
    named = F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))
    rows = stored(docs.select(F.struct("*").alias("row"), named.alias("g"), source.cast("string").alias("source"), size.cast("long").alias("size"), key.alias("key")))
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stored(water_filled(weigh(sources), share, most))
    placed = ordered(rows, "g", [F.col("key")], "size")
    joined = placed.join(broadcast_below(targets.withColumnRenamed("source", "of")), F.col("source").eqNullSafe(F.col("of")))
    whole = F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0))
    rest = F.col("target") - whole * F.col("source_size")
    extra = F.col("before") + F.col("size") / 2 < rest
    return joined.select("row", "size", "source_size", "target", (whole + extra.cast("long")).alias("times"))


def op13(spark: SparkSession, sf_dir: str, seed: int = 13) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    facts = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("words"), F.md5(F.coalesce("text", F.lit(""))).alias("digest"))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("digest")))
    rows = mixed(facts, key, F.col("words"), F.col("source"))
    return rows.select("row.doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))


SQL = r"""
with recursive docs as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    md5('13:' || coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))) as key from documents),
sources as (
  select source, sum(size)::bigint as source_size, [3, 1, 2][(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight from docs group by source),
rounds as (
  select 0 as round, source, source_size, weight, false as stops from sources
  union all
  select round + 1, source, source_size, weight, stops or weight * ((sum(source_size) over () * 1.5::double - 2.0::double * coalesce(sum(source_size) filter (stops) over (), 0)) / sum(weight) filter (not stops) over ()) > 2.0::double * source_size
  from (select * from rounds) where round <= (select count(*) from sources)),
last as (select * from rounds where round = (select max(round) from rounds)),
targets as (
  select source, source_size, case when stops then source_size * 2.0::double else coalesce(weight * ((sum(source_size) over () * 1.5::double - coalesce(sum(source_size) filter (stops) over (), 0) * 2.0::double) / (sum(weight) filter (not stops) over ())::double), 0.0::double) end as target from last),
placed as (select *, coalesce(sum(size) over (partition by source order by key rows between unbounded preceding and 1 preceding), 0) as before from docs)
select p.doc_id, p.size, t.source_size, t.target,
  cast(p.size * (coalesce(floor(t.target / nullif(t.source_size, 0)), 0)
    + case when p.before + p.size / 2.0::double < t.target - coalesce(floor(t.target / nullif(t.source_size, 0)), 0) * t.source_size then 1 else 0 end) as bigint) as taken
from placed p join targets t on p.source is not distinct from t.source
"""
