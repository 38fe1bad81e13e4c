"""Vector geometry on struct columns with fields x, y, z."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def point(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def minus(a: Column, b: Column) -> Column:
    return point(a["x"] - b["x"], a["y"] - b["y"], a["z"] - b["z"])


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def cross(a: Column, b: Column) -> Column:
    return point(a["y"] * b["z"] - b["y"] * a["z"], a["z"] * b["x"] - b["z"] * a["x"], a["x"] * b["y"] - b["x"] * a["y"])


def distance(a: Column, b: Column) -> Column:
    d = minus(a, b)
    return F.sqrt(dot(d, d))


def cosine(p1: Column, p2: Column, p3: Column, p4: Column) -> Column:
    """Of the angle between p1 - p2 and p3 - p4; 0 where one has no length."""
    u, v = minus(p1, p2), minus(p3, p4)
    n = dot(u, u) * dot(v, v)
    return F.when(n > 0, dot(u, v) / F.sqrt(n)).otherwise(0.0)


def dihedral(p1: Column, p2: Column, p3: Column, p4: Column) -> Column:
    """Degrees; null where it isn't defined."""
    v12, v43, z = minus(p1, p2), minus(p4, p3), minus(p2, p3)
    p, x = cross(z, v12), cross(z, v43)
    y = cross(z, x)
    u, v = dot(x, x), dot(y, y)
    return F.when((u > 0) & (v > 0), F.degrees(F.atan2(dot(p, y) / F.sqrt(v), dot(p, x) / F.sqrt(u))))


def hbond_energy(h: Column, n: Column, c: Column, o: Column) -> Column:
    """Kabsch and Sander's electrostatic energy in kcal/mol, rounded to 3 places, -9.9 at least."""
    ho, hc, nc, no = distance(h, o), distance(h, c), distance(n, c), distance(n, o)
    energy = F.round(F.lit(-27.888) * (1 / ho - 1 / hc + 1 / nc - 1 / no), 3)
    return F.when(F.least(ho, hc, nc, no) < 0.5, F.lit(-9.9)).otherwise(F.greatest(energy, F.lit(-9.9)) + 0.0)  # no negative zero


def hydrogen(n: Column, previous_c: Column, previous_o: Column, proline: Column) -> Column:
    """The amide's hydrogen: against the C=O of the residue before; N itself for proline, the first residue and behind one without a place."""
    d = distance(previous_c, previous_o)
    return point(*[F.when(proline | previous_c[k].isNull() | (d == 0), n[k]).otherwise(n[k] + (previous_c[k] - previous_o[k]) / d) for k in "xyz"])


def grown(low: Column, high: Column, margin: float) -> Column:
    """A box with a margin on all sides."""
    return F.struct(*[(low[k] - margin).alias(f"min_{k}") for k in "xyz"], *[(high[k] + margin).alias(f"max_{k}") for k in "xyz"])


def touches(box: Column, at: Column, radius: Column) -> Column:
    """Whether a sphere reaches into a box."""
    out = F.lit(True)
    for k in "xyz":
        out = out & (at[k] + radius >= box[f"min_{k}"]) & (at[k] - radius <= box[f"max_{k}"])
    return out


def centred(rows: DataFrame, group: str, at: str) -> DataFrame:
    """Adds centroid and moves the points of each group to it."""
    means = rows.groupBy(group).agg(F.struct(*[F.avg(f"{at}.{k}").alias(k) for k in "xyz"]).alias("centroid"))
    return rows.join(means, group).withColumn(at, minus(F.col(at), F.col("centroid")))


def superposed(pairs: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """(group, n, rmsd, quaternion) of the best rotation of the points b onto a, both moved to their centroids.

    Nine sums of products a group, then the largest eigenvalue of a 4 x 4 matrix, in Arrow batches.
    """
    moved = centred(centred(pairs, group, a).drop("centroid"), group, b)
    x, y = F.col(a), F.col(b)
    sums = moved.groupBy(group).agg(F.count("*").alias("n"), F.sum(dot(x, x) + dot(y, y)).alias("squares"), *[F.sum(y[i] * x[j]).alias(i + j) for i in "xyz" for j in "xyz"])

    def run(batches):
        for t in batches:
            s = {i + j: t[i + j].to_numpy(float) for i in "xyz" for j in "xyz"}
            k = np.zeros((len(t), 4, 4))
            k[:, 0, 0] = s["xx"] + s["yy"] + s["zz"]
            for m, (p, q) in enumerate(("yz", "zx", "xy"), 1):
                k[:, 0, m] = k[:, m, 0] = s[p + q] - s[q + p]
                i = "xyz"[m - 1]
                k[:, m, m] = 2 * s[i + i] - k[:, 0, 0]
                for o in range(m + 1, 4):
                    j = "xyz"[o - 1]
                    k[:, m, o] = k[:, o, m] = s[i + j] + s[j + i]
            values, vectors = np.linalg.eigh(k) if len(t) else (np.zeros((0, 4)), np.zeros((0, 4, 4)))
            n = t["n"].to_numpy(float)
            out = t[[group, "n"]].copy()
            out["rmsd"] = np.sqrt(np.maximum(t["squares"].to_numpy(float) - 2 * values[:, -1], 0) / n)
            out["quaternion"] = list(vectors[:, :, -1])
            yield out

    kind = pairs.schema[group].dataType.simpleString()
    return sums.mapInPandas(run, f"`{group}` {kind}, n long, rmsd double, quaternion array<double>")


def angle_axis(quaternion: Column) -> Column:
    """(angle in degrees, x, y, z) of the rotation of a quaternion w, x, y, z of any length."""
    q = [quaternion[k] for k in range(4)]
    length = F.sqrt(sum((v * v for v in q[1:]), q[0] * q[0]))
    w = q[0] / length
    s = F.sqrt(F.greatest(F.lit(0.0), 1 - w * w))
    return F.struct(F.degrees(2 * F.acos(F.least(F.greatest(w, F.lit(-1.0)), F.lit(1.0)))).alias("angle"), *[F.when(s > 1e-9, v / length / s).otherwise(v / length).alias(k) for k, v in zip("xyz", q[1:])])
