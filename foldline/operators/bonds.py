"""Hydrogen bonds that may be among the two best of a residue, by tiles of residues."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from foldline.functions import geometry as G

BLOCK, TILE = 4096, 256
LEAST = -9.9
ATOMS = ("h", "n", "c", "o")
# A bond's rank is its energy in thousandths and, below these bits, the partner's place; no bond ranks behind NONE.
BITS, NONE = 24, np.int64(2**62)


def _far(one: np.ndarray, i: np.ndarray, other: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances of points by their places in two arrays of coordinates, 3 x n."""
    total = 0.0
    for x, y in zip(one, other):
        step = x.take(i)
        step -= y.take(j)
        step *= step
        total = total + step
    return np.sqrt(total)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal keys begin, and the number of each key's run."""
    new = np.diff(keys, prepend=-1) != 0
    return np.flatnonzero(new), np.cumsum(new) - 1


def _two_least(ranks: np.ndarray, starts: np.ndarray, run: np.ndarray) -> np.ndarray:
    """The two least of each run's ranks, n x 2; run numbers the runs that begin at starts."""
    least = np.minimum.reduceat(ranks, starts)
    return np.stack([least, np.minimum.reduceat(np.where(ranks == least[run], NONE, ranks), starts)], 1)


def _energies(atoms: dict, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(energy in thousandths, whether it can't be told to the last one) of donors i and acceptors j; it may be one less than it says then."""
    ho, hc, nc, no = (_far(atoms[x], i, atoms[y], j) for x, y in ("ho", "hc", "nc", "no"))
    close = np.minimum(np.minimum(ho, hc), np.minimum(nc, no))
    energy = np.maximum(-27.888 * (1 / ho - 1 / hc + 1 / nc - 1 / no), LEAST)
    open_ = np.isnan(close) | (np.abs(close - 0.5) < 1e-6)
    thousandths = np.where(open_ | (close < 0.5), LEAST, energy) * 1000
    whole = np.rint(thousandths)
    return whole.astype(np.int64), open_ | (np.abs(thousandths - whole) > 0.499)


def _best_of(radius: float, both: bool):
    """The rows of a pair of blocks, donors and acceptors, to those pairs that may be among the two best of one of their residues there."""

    def run(group: pa.Table) -> pa.Table:
        gives, number, place = (group.column(c).to_numpy() for c in ("gives", "id", "ord"))
        at = {a: np.stack([group.column(f"{a}_{c}").to_numpy() for c in "xyz"]) for a in ("ca", *ATOMS)}
        order = np.argsort(place, kind="stable")
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            found = list(tiles(order[gives[order]], order[~gives[order]], number, place, at))
        i, j, for_donor, for_acceptor = (pa.array(np.concatenate(x)) for x in zip(*found, (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, bool))))
        out = {"protein": group.column("chain").take(i), "donor": group.column("id").take(i), "acceptor": group.column("id").take(j), "d": group.column("ord").take(i), "a": group.column("ord").take(j)}
        out |= {"for_donor": for_donor, "for_acceptor": for_acceptor}
        return pa.table(out | {f"{a}_{c}": group.column(f"{a}_{c}").take(i if a in "hn" else j) for a in ATOMS for c in "xyz"})

    def tiles(donors, acceptors, number, place, at):
        there = at["ca"][:, acceptors]
        square = (there * there).sum(0)
        right = np.stack([*there, np.ones(len(acceptors)), square])
        taken = {a: at[a][:, acceptors] for a in "co"}
        best = np.full((len(acceptors), 2), NONE)
        later = []
        for begin in range(0, len(donors), TILE):
            some = donors[begin : begin + TILE]
            here = at["ca"][:, some]
            own = (here * here).sum(0)
            # A product of matrices, so with an error; what it lets through is measured again.
            spare = 1e-12 * (1 + np.nanmax(own, initial=0) + np.nanmax(square, initial=0))
            i, j = np.nonzero(np.stack([*(-2 * here), own, np.ones(len(some))], 1) @ right < radius * radius + spare)
            near = (number[some][i] != number[acceptors][j]) & (place[some][i] != place[acceptors][j] + 1) & (_far(here, i, there, j) < radius)
            i, j = i[near], j[near]
            energy, unsure = _energies(taken | {a: at[a][:, some] for a in "hn"}, i, j)
            below = (energy < 0) | unsure
            i, j, energy, unsure = i[below], j[below], energy[below], unsure[below]
            if not len(i):
                continue
            lowest = energy - 1 << BITS  # of those that aren't sure
            rank = np.where(unsure, NONE, (energy << BITS) + j)
            starts, row = _runs(i)
            second = _two_least(rank, starts, row)[row, 1]
            for_donor = (rank <= second) & ~unsure | unsure & (lowest <= second)
            for_acceptor = np.zeros(len(i), bool)
            rank = np.where(unsure, NONE, (energy << BITS) + begin + i)
            if both:
                for_acceptor = (rank <= best[j, 1]) & ~unsure | unsure & (lowest <= best[j, 1])
                few = np.flatnonzero(for_acceptor)
                few = few[np.argsort(j[few], kind="stable")]
                if len(few):
                    starts, column = _runs(j[few])
                    kinds = j[few][starts]
                    best[kinds] = np.sort(np.hstack([best[kinds], _two_least(rank[few], starts, column)]), 1)[:, :2]
            one = for_donor | for_acceptor
            later.append((some[i[one]], j[one], for_donor[one], for_acceptor[one], np.where(unsure, lowest, rank)[one]))
        for i, j, for_donor, for_acceptor, rank in later:
            for_acceptor = for_acceptor & (rank <= best[j, 1])
            one = for_donor | for_acceptor
            yield i[one], acceptors[j[one]], for_donor[one], for_acceptor[one]

    return run


def likely_bonds(residues: DataFrame, radius: float = 9.0, both: bool = False, block: int = BLOCK) -> DataFrame:
    """(protein, donor, acceptor, d, a, energy, for_donor, for_acceptor) of residues (chain, vec_id, ord, proline, ca, h, n, c, o) that are near.

    Among the rows for_donor are the two best acceptors of each donor by energy and number, of energies below 0; among those for_acceptor,
    with both, the two best donors of each acceptor. Others come as well, a few a residue and pair of blocks: the caller ranks.

    A chain is dealt out in pairs of blocks of residues, an Arrow group each. There a tile's energies are worked out together; the two best of a
    residue, and what may round to as little, leave the task with the energies of hbond_energy().
    """
    t = residues.filter(F.col("chain").isNotNull() & F.col("vec_id").isNotNull())
    size = F.count("*").over(Window.partitionBy("chain"))
    t = t.withColumn("_blocks", F.ceil(size / block)).withColumn("_own", F.floor((F.col("ord") - 1) * F.col("_blocks") / size))
    own, every = F.col("_own"), F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)

    def pairs(gives: bool):
        return F.transform(every, lambda k: F.struct((own if gives else k).alias("block_d"), (k if gives else own).alias("block_a"), F.lit(gives).alias("gives")))

    flat = [F.col(f"{a}.{c}").alias(f"{a}_{c}") for a in ("ca", *ATOMS) for c in "xyz"]
    sent = F.explode(F.when(F.col("proline"), pairs(False)).otherwise(F.concat(pairs(True), pairs(False))))
    dealt = t.select("chain", F.col("vec_id").cast("long").alias("id"), F.col("ord").cast("long").alias("ord"), *flat, sent.alias("to")).select("*", "to.*").drop("to")
    longs, flags, numbers = ("donor", "acceptor", "d", "a"), ("for_donor", "for_acceptor"), [f"{a}_{c}" for a in ATOMS for c in "xyz"]
    types = ", ".join([f"protein {residues.schema['chain'].dataType.simpleString()}", *(f"{c} long" for c in longs), *(f"{c} boolean" for c in flags), *(f"{c} double" for c in numbers)])
    found = dealt.groupBy("chain", "block_d", "block_a").applyInArrow(_best_of(radius, both), types)
    h, n, c, o = (G.point(*[F.col(f"{a}_{x}") for x in "xyz"]) for a in ATOMS)
    return found.select("protein", *longs, G.hbond_energy(h, n, c, o).alias("energy"), *flags)
