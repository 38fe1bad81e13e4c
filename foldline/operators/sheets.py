"""Bridges, ladders and sheets from hydrogen bonds, and solvent accessible surface."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

SPHERE, PROBE = 200, 1.4


def strongest(bonds: DataFrame, most: float = -0.5) -> DataFrame:
    """(protein, donor, acceptor, energy, rank): each donor's two best acceptors below an energy; earlier ones win ties."""
    w = Window.partitionBy("protein", "donor").orderBy("energy", "acceptor")
    ranked = bonds.filter("energy < 0").withColumn("rank", F.row_number().over(w).cast("long")).filter("rank <= 2")
    return ranked.filter(F.col("energy") < most)


def bridges(bonds: DataFrame, residues: DataFrame) -> DataFrame:
    """(protein, i, j, kind, segment_i, segment_j) with j >= i + 3 from bonds (protein, donor, acceptor) and residues (protein,
    ord, segment): built from the bonds by equal ordinals, never from all pairs of residues.

    Both residues need neighbours on either side without a break; what is both is parallel.
    """
    b = bonds.select("protein", F.col("donor").alias("d"), F.col("acceptor").alias("a"))

    def both(first, second):
        """Pairs of bonds that share what the pattern needs; each side gives (i, j)."""
        x = b.select("protein", first[0].alias("i"), first[1].alias("j"))
        y = b.select("protein", second[0].alias("i"), second[1].alias("j"))
        return x.join(y, ["protein", "i", "j"]).distinct()

    d, a = F.col("d"), F.col("a")
    parallel = both((a + 1, d), (d - 1, a)).union(both((d, a + 1), (a, d - 1)))
    anti = both((d, a), (a, d)).union(both((a + 1, d - 1), (d - 1, a + 1)))
    out = parallel.withColumn("kind", F.lit("parallel")).union(anti.withColumn("kind", F.lit("antiparallel")))
    out = out.select("protein", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "kind").filter("j >= i + 3")
    out = out.groupBy("protein", "i", "j").agg(F.max("kind").alias("kind"))
    w = Window.partitionBy("protein").orderBy("ord")
    beside = [(F.lag("segment").over(w) == F.col("segment")), (F.lead("segment").over(w) == F.col("segment"))]
    inner = residues.select("protein", "ord", "segment", beside[0].alias("before"), beside[1].alias("after")).filter("before and after").select("protein", "ord", "segment")
    for end in ("i", "j"):
        out = out.join(inner.select("protein", F.col("ord").alias(end), F.col("segment").alias(f"segment_{end}")), ["protein", end])
    return out.select("protein", "i", "j", "kind", "segment_i", "segment_j")


def ladders(bridge_rows: DataFrame) -> DataFrame:
    """(protein, kind, first_i, last_i, first_j, last_j, n, segment_i, segment_j): consecutive bridges on one diagonal."""
    diagonal = F.when(F.col("kind") == "parallel", F.col("i") - F.col("j")).otherwise(F.col("i") + F.col("j"))
    w = Window.partitionBy("protein", "kind", "diagonal").orderBy("i")
    t = bridge_rows.withColumn("diagonal", diagonal).withColumn("island", F.col("i") - F.row_number().over(w))
    return t.groupBy("protein", "kind", "diagonal", "island").agg(F.min("i").alias("first_i"), F.max("i").alias("last_i"), F.min("j").alias("first_j"), F.max("j").alias("last_j"), F.count("*").alias("n"), F.first("segment_i").alias("segment_i"), F.first("segment_j").alias("segment_j")).drop("diagonal", "island")


class Ladder:
    """Pairs of bridged residues; j runs against i where it is antiparallel."""

    def __init__(self, r):
        self.parallel, self.segments = r.kind == "parallel", (r.segment_i, r.segment_j)
        self.i = list(range(r.first_i, r.last_i + 1))
        self.j = list(range(r.first_j, r.last_j + 1)) if self.parallel else list(range(r.last_j, r.first_j - 1, -1))

    def bulges_into(self, other: Ladder) -> bool:
        """Whether the other one goes on where this one ends, but for a bulge of one residue on one side and up to four on the other."""
        if self.parallel != other.parallel or self.segments != other.segments:
            return False
        gap_i = other.i[0] - self.i[-1]
        gap_j = other.j[0] - self.j[-1] if self.parallel else self.j[-1] - other.j[0]
        return 0 < gap_i < 6 and gap_j >= 0 and (gap_j < 3 or (gap_j < 6 and gap_i < 3))


def merged(found: list[Ladder]) -> list[Ladder]:
    """Ladders after bulges are bridged, in order of their first residues."""
    left, out = list(found), []
    while left:
        one, rest = left[0], []
        for other in left[1:]:
            if one.bulges_into(other):
                one.i, one.j = one.i + other.i, one.j + other.j
            else:
                rest.append(other)
        out.append(one)
        left = rest
    return out


def numbered(found: list[Ladder]) -> list[tuple[int, int]]:
    """(sheet from 1, ladder from 0) of each ladder: ladders that share a residue are in one sheet."""
    up = list(range(len(found)))

    def top(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    owner: dict[int, int] = {}
    for k, one in enumerate(found):
        for residue in {*one.i, *one.j}:
            a, b = top(owner.setdefault(residue, k)), top(k)
            up[max(a, b)] = min(a, b)
    sheet: dict[int, int] = {}
    own = [sheet.setdefault(top(k), len(sheet) + 1) for k in range(len(found))]
    ladder = {k: n for n, k in enumerate(sorted(range(len(found)), key=lambda k: (own[k], k)))}
    return [(own[k], ladder[k]) for k in range(len(found))]


def _ladders_of(group: pd.DataFrame) -> list[Ladder]:
    return merged([Ladder(r) for r in group.sort_values(["first_i", "first_j", "kind"]).itertuples()])


def sheets(ladder_rows: DataFrame) -> DataFrame:
    """(protein, sheet, ladder, kind, first_i, last_i, first_j, last_j, n) after bulges; a group is a protein's ladders."""

    def join(group: pd.DataFrame) -> pd.DataFrame:
        found = _ladders_of(group)
        rows = [(group["protein"].iloc[0], s, k, "parallel" if x.parallel else "antiparallel", x.i[0], x.i[-1], min(x.j), max(x.j), len(x.i)) for x, (s, k) in zip(found, numbered(found))]
        return pd.DataFrame(rows, columns=["protein", "sheet", "ladder", "kind", "first_i", "last_i", "first_j", "last_j", "n"])

    kind = ladder_rows.schema["protein"].dataType.simpleString()
    return ladder_rows.groupBy("protein").applyInPandas(join, f"protein {kind}, sheet long, ladder long, kind string, first_i long, last_i long, first_j long, last_j long, n long")


def strands(ladder_rows: DataFrame) -> DataFrame:
    """(protein, ord, ss, sheet, partner1, ladder1, parallel1, partner2, ladder2, parallel2) of residues in ladders.

    E in ladders of more than one bridge, else B; residues that a ladder spans over a bulge have no partner there. A ladder takes
    the second place of all its residues on a side if one of them already has a first partner.
    """

    def assign(group: pd.DataFrame) -> pd.DataFrame:
        found = _ladders_of(group)
        partner: dict[tuple[int, int], tuple] = {}
        ss: dict[int, str] = {}
        sheet: dict[int, int] = {}
        for one, (s, k) in zip(found, numbered(found)):
            places = [int(any((r, 0) in partner for r in side)) for side in (one.i, one.j)]
            for place, own, others in ((places[0], one.i, one.j), (places[1], one.j, one.i)):
                partner |= {(r, place): (o, k, one.parallel) for r, o in zip(own, others)}
            for side in (one.i, one.j):
                for r in range(min(side), max(side) + 1):
                    ss[r] = "E" if len(one.i) > 1 or ss.get(r) == "E" else "B"
                    sheet[r] = s
        none = (None, None, None)
        rows = [(group["protein"].iloc[0], r, ss[r], sheet[r], *partner.get((r, 0), none), *partner.get((r, 1), none)) for r in sorted(ss)]
        names = ["protein", "ord", "ss", "sheet", "partner1", "ladder1", "parallel1", "partner2", "ladder2", "parallel2"]
        return pd.DataFrame(rows, columns=names).astype({c: "Int64" for c in names if c[:-1] in ("partner", "ladder")})

    kind = ladder_rows.schema["protein"].dataType.simpleString()
    return ladder_rows.groupBy("protein").applyInPandas(assign, f"protein {kind}, ord long, ss string, sheet long, partner1 long, ladder1 long, parallel1 boolean, partner2 long, ladder2 long, parallel2 boolean")


def sphere(n: int = SPHERE) -> tuple[np.ndarray, float]:
    """2n + 1 evenly spread unit vectors on a spiral, and the area that each stands for."""
    k = np.arange(-n, n + 1)
    lat, lon = np.arcsin(2.0 * k / (2 * n + 1)), 2 * np.pi * k / ((1 + math.sqrt(5)) / 2)
    return np.stack([np.sin(lon) * np.cos(lat), np.cos(lon) * np.cos(lat), np.sin(lat)], 1), 4 * np.pi / (2 * n + 1)


def surface(atoms: DataFrame, side: float = 16.0) -> DataFrame:
    """(protein, atom, area): accessible area of each of the atoms (protein, atom, x, y, z, radius); those without a place are left out.

    Space is cut into cubes; a task gets a cube's atoms with those around it whose spheres may touch them, in one Arrow group, and
    tries the dots of each atom's sphere against its neighbours, the nearest first. Atoms of a cube are as many as fit into it.
    """
    placed = atoms.filter(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull() & F.col("radius").isNotNull())
    largest = placed.agg(F.max("radius")).first()[0] or 0.0
    reach = 2 * (largest + PROBE)

    def cubes(c: str):
        return F.explode(F.sequence(F.floor((F.col(c) - reach) / side), F.floor((F.col(c) + reach) / side)))

    rows = placed.select("protein", "atom", "x", "y", "z", "radius")
    for c in "xyz":
        rows = rows.withColumn(f"cube_{c}", cubes(c))
    own = F.lit(True)
    for c in "xyz":
        own = own & (F.col(f"cube_{c}") == F.floor(F.col(c) / side))
    keys = ["protein", "cube_x", "cube_y", "cube_z"]
    kind = atoms.schema

    def areas(group: pa.Table) -> pa.Table:
        mine = np.flatnonzero(group.column("own").to_numpy())
        at = np.stack([group.column(c).to_numpy() for c in "xyz"], 1)
        radius = group.column("radius").to_numpy() + PROBE
        dots, weight = sphere()
        out = []
        for k in mine:
            far = ((at - at[k]) ** 2).sum(1)
            near = np.flatnonzero((far < (radius + radius[k]) ** 2) & (far > 0.0001))
            near = near[np.argsort(far[near], kind="stable")]
            free = dots * radius[k]
            for i in range(0, len(near), 8):
                some = near[i : i + 8]
                hidden = ((free[:, None, :] - (at[some] - at[k])[None]) ** 2).sum(2) <= radius[some] ** 2
                free = free[~hidden.any(1)]
                if not len(free):
                    break
            out.append(len(free) * weight * radius[k] ** 2)
        return pa.table({"protein": group.column("protein").take(pa.array(mine)), "atom": group.column("atom").take(pa.array(mine)), "area": pa.array(out, pa.float64())})

    types = f"protein {kind['protein'].dataType.simpleString()}, atom {kind['atom'].dataType.simpleString()}, area double"
    return rows.withColumn("own", own).groupBy(*keys).applyInArrow(areas, types)


def statistics(best: DataFrame, residues: DataFrame) -> DataFrame:
    """(protein, residues, chains, bonds, and a count for each distance in number from donor to acceptor, -5 to 5) of each protein and, with
    protein null, of all; best from strongest(), residues as for bridges(). One pass over residues and bonds together; counts are combined before the shuffle."""
    offset = F.col("acceptor") - F.col("donor")
    rows = residues.select("protein", "segment", F.lit(None).cast("long").alias("k")).unionByName(best.select("protein", F.lit(None).cast(residues.schema["segment"].dataType).alias("segment"), offset.cast("long").alias("k")))
    names = [(k, f"minus_{-k}" if k < 0 else f"plus_{k}") for k in range(-5, 6)]
    each = rows.groupBy("protein", "segment").agg(F.count_if(F.col("segment").isNotNull()).alias("residues"), F.count("k").alias("bonds"), *[F.count_if(F.col("k") == k).alias(n) for k, n in names])
    return each.rollup("protein").agg(F.sum("residues").alias("residues"), F.count("segment").alias("chains"), F.sum("bonds").alias("bonds"), *[F.sum(n).alias(n) for _, n in names])
