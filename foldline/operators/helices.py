"""Turns and helices from hydrogen bonds along a chain, with window functions.

Rows have a chain, an order within it, and for n = 3, 4, 5 whether the residue n further on is
bonded back to this one (bond3, bond4, bond5) without a chain break between.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

STEPS = (3, 4, 5)


def turn_flags(rows: DataFrame, chain: str = "chain", order: str = "ord") -> DataFrame:
    """Adds helix3, helix4, helix5: X (start and end), > (start), < (end), the number (middle) or blank."""
    w = Window.partitionBy(chain).orderBy(order)
    for n in STEPS:
        start = F.col(f"bond{n}")
        end = F.coalesce(F.lag(start, n).over(w), F.lit(False))
        middle = F.coalesce(F.max(start).over(w.rowsBetween(-(n - 1), -1)), F.lit(False))
        rows = rows.withColumn(f"helix{n}", F.when(start & end, "X").when(start, ">").when(end, "<").when(middle, str(n)).otherwise(" "))
    return rows


def helix_marks(rows: DataFrame, chain: str = "chain", order: str = "ord", prefer_pi: bool = True) -> DataFrame:
    """Adds ss: H, G or I for helices, T for turns, S for bends (column bend), else blank."""
    w = Window.partitionBy(chain).orderBy(order)

    def pair(n: int):
        """Starts at the residue before and at this one."""
        return F.col(f"bond{n}") & F.coalesce(F.lag(f"bond{n}").over(w), F.lit(False))

    rows = rows.withColumn("p3", pair(3)).withColumn("p4", pair(4)).withColumn("p5", pair(5))
    rows = rows.withColumn("ss", F.when(F.max("p4").over(w.rowsBetween(-3, 0)), "H").otherwise(" "))
    for n, mark, allowed in ((3, "G", [" "]), (5, "I", [" ", "H"] if prefer_pi else [" "])):
        free = F.min(F.col("ss").isin(*allowed)).over(w.rowsBetween(0, n - 1))
        whole = F.count("*").over(w.rowsBetween(0, n - 1)) == n
        rows = rows.withColumn("hit", F.col(f"p{n}") & free & whole)
        rows = rows.withColumn("ss", F.when(F.max("hit").over(w.rowsBetween(-(n - 1), 0)), mark).otherwise(F.col("ss")))
    turn = F.lit(False)
    for n in STEPS:
        turn = turn | F.coalesce(F.max(f"bond{n}").over(w.rowsBetween(-(n - 1), -1)), F.lit(False))
    return rows.withColumn("ss", F.when(F.col("ss") != " ", F.col("ss")).when(turn, "T").when(F.col("bend"), "S").otherwise(" ")).drop("p3", "p4", "p5", "hit")
