"""The relational store: sequences and chains with get-or-create, update and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def get_or_create(known: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """known (id, key) with the values it lacks, which get the next ids.

    Ids are dense over partitions without a single sorted task: rows are numbered within each
    partition of a range partitioning by key, and the partitions' sizes are added up before.
    """
    new = values.select(key).filter(F.col(key).isNotNull()).distinct().join(known, key, "left_anti")
    parts = new.repartitionByRange(64, key).sortWithinPartitions(key).withColumn("p", F.spark_partition_id()).withColumn("k", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
    sizes = parts.groupBy("p").agg(F.count("*").alias("n"))
    # As many rows as partitions.
    before = sizes.alias("a").join(sizes.alias("b"), F.col("b.p") < F.col("a.p"), "left").groupBy(F.col("a.p").alias("p")).agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"))
    top = known.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    numbered = parts.join(F.broadcast(before), "p").crossJoin(F.broadcast(top)).select((F.col("top") + F.col("before") + F.col("k") + 1).alias("id"), key)
    return known.select("id", key).unionByName(numbered)


def updated(rows: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """rows with the column's values from changes (key, column) where there is one."""
    new = changes.select(key, F.col(column).alias("__new"))
    return rows.join(new, key, "left").withColumn(column, F.coalesce("__new", column)).drop("__new")


def looked_up(rows: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """Rows with what the store has under their key; those without a key there go."""
    return rows.join(store.filter(F.col(key).isNotNull()), key)


def exported(store: DataFrame, column: str, but: str) -> DataFrame:
    """Rows whose value is known and another one."""
    return store.filter(F.col(column) != but)


def counted(store: DataFrame, column: str, codes: list[str]) -> DataFrame:
    """(column, n) of the codes that occur."""
    return store.filter(F.col(column).isin(codes)).groupBy(column).agg(F.count("*").alias("n"))


def same_as(rows: DataFrame, digest: str, id_col: str) -> DataFrame:
    """(digest, ids) of the digests that several rows have, ids in order; rows that are alone never reach a list."""
    several = rows.groupBy(digest).agg(F.count("*").alias("n")).filter("n > 1")
    return rows.join(several, digest).groupBy(digest).agg(F.array_sort(F.collect_list(id_col)).alias("ids"))
