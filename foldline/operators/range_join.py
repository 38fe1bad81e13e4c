"""Pairs of points within a distance, by a join on grid cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def within(points: DataFrame, id_col: str, at: str, radius: float, keep: list[str] = ()) -> DataFrame:
    """(a, b, distance, and the columns in keep as a_<name>, b_<name>) with a < b and distance < radius.

    Space is cut into cubes of the radius: a point is sent to its own cube, its partners to the 27
    around theirs, so that the join is on equal cells.
    """
    cell = [F.floor(F.col(f"{at}.{c}") / radius).cast("long") for c in "xyz"]
    left = points.select(F.col(id_col).alias("a"), F.col(at).alias("pa"), *[F.col(k).alias(f"a_{k}") for k in keep], *[c.alias(f"c{i}") for i, c in enumerate(cell)])
    steps = F.array(*[F.struct(*[F.lit(v).cast("long").alias(f"d{i}") for i, v in enumerate((x, y, z))]) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1)])
    right = points.select(F.col(id_col).alias("b"), F.col(at).alias("pb"), *[F.col(k).alias(f"b_{k}") for k in keep], *[c.alias(f"e{i}") for i, c in enumerate(cell)]).withColumn("s", F.explode(steps))
    right = right.select("b", "pb", *[f"b_{k}" for k in keep], *[(F.col(f"e{i}") + F.col(f"s.d{i}")).alias(f"c{i}") for i in range(3)])
    square = sum((F.col(f"pa.{c}") - F.col(f"pb.{c}")) * (F.col(f"pa.{c}") - F.col(f"pb.{c}")) for c in "xyz")
    return left.join(right, ["c0", "c1", "c2"]).filter(F.col("a") < F.col("b")).withColumn("distance", F.sqrt(square)).filter(F.col("distance") < radius).drop("c0", "c1", "c2")
