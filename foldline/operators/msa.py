"""Progressive alignment of hits to a growing profile.

Hits come to a query in order of distance and are read as a stream; the state of a query is its profile, an entry a
column, never the rows aligned so far. Each accepted hit leaves the task as a path: the numbers of the columns that it fills, and its
letters. Columns keep their numbers for good; what order they have in the end is known when a query's hits are through,
and a window hands it to all paths, from which the aligned rows are written independently of each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from foldline.functions.alphabet import PAM250_SCORES, RESIDUES, score_table
from foldline.operators.gapped import coded

SCORES = np.array(score_table(PAM250_SCORES), float)
# What gap costs are in units of the matrix, the costs, and the share of the profile that a hit has to cover.
MISMATCH, SCALE = 1.484210526, math.log(2) / 3
OPEN, EXTEND, FRAGMENT, MARGIN = 30.0, 2.0, 0.75, 0.05
X = RESIDUES.index("X")


# How dear a gap opposite a residue is, by residue, and by the state of a profile's column.
RESIDUE_GAP = {"A": 1.13, "C": 1.13, "D": 0.96, "E": 1.31, "F": 1.20, "G": 0.61, "H": 1.00, "I": 1.32, "K": 0.96, "L": 1.21, "M": 1.29, "N": 0.63, "P": 0.74, "Q": 1.07, "R": 0.72, "S": 0.76, "T": 0.89, "V": 1.25, "W": 1.23, "Y": 1.00}
STATE_GAP = {"H": 2.0, "B": 2.0, "G": 3.0, "I": 2.0, "T": 1.5}
NEAR = 8
GAP_OF = np.array([RESIDUE_GAP.get(c, 1.0) for c in RESIDUES])


def column_gap_costs(columns: DataFrame, group: str, rows: Column, opening: float = OPEN, extension: float = EXTEND) -> DataFrame:
    """Adds open_cost and extend_cost to columns (group, pos, ss, inserted, gaps) of alignments of so many rows.

    Opening costs by state, nothing where something was inserted already, and more near the next gap or end within
    NEAR columns on either side; extension costs the share of rows with a gap, if there is any.
    """
    w = Window.partitionBy(group).orderBy("pos")
    state = F.coalesce(F.create_map(*[F.lit(x) for kv in STATE_GAP.items() for x in kv])[F.col("ss")], F.lit(1.0))
    there = F.col("gaps") > 0

    def stops(f, k):
        return F.coalesce(f(there, k).over(w), F.lit(True))  # beyond the end there is no column

    near = F.least(*[F.when(stops(F.lead, k) | stops(F.lag, k), k).otherwise(NEAR) for k in range(NEAR)])
    factor = F.when(near < NEAR, (2 + (NEAR - near) * 2) / float(NEAR)).otherwise(1.0)
    cost = opening * state * F.when(F.col("inserted") > 0, 0.0).otherwise(1.0) * factor
    return columns.withColumn("open_cost", cost).withColumn("extend_cost", F.when(there, F.col("gaps") / rows).otherwise(F.lit(extension)))


def gap_costs_of(states: str, inserted: np.ndarray, gaps: np.ndarray, rows: int, opening: float = OPEN, extension: float = EXTEND) -> tuple[np.ndarray, np.ndarray]:
    """The same costs from arrays."""
    n = len(gaps)
    cost = opening * np.array([STATE_GAP.get(c, 1.0) for c in states])
    cost[inserted > 0] = 0
    stop = np.flatnonzero(np.concatenate([[True], gaps > 0, [True]])) - 1
    at = np.searchsorted(stop, np.arange(n))
    near = np.minimum(stop[at] - np.arange(n), np.where(at > 0, np.arange(n) - stop[np.maximum(at - 1, 0)], n))
    cost *= np.where(near < NEAR, (2 + (NEAR - near) * 2) / NEAR, 1.0)
    return cost, np.where(gaps > 0, gaps / rows, extension)


def curve(length: int) -> float:
    """The share of identical residues from which alignments of a length count as homologous."""
    return 2.9015 * min(max(length, 10), 80) ** -0.562


class Profile:
    """The columns of a query's alignment, without its rows."""

    def __init__(self, query: str, states: str | None = None, opening: float = OPEN, extension: float = EXTEND, fragment: float = FRAGMENT, margin: float = MARGIN):
        n = len(query)
        self.letters = coded(query)  # -1 where a hit has inserted a column
        self.states = (states or "").ljust(n)[:n]
        self.numbers, self.places = np.arange(n), np.arange(1, n + 1)  # places: in the query, 0 for inserted columns
        self.counts, self.weights = np.zeros((n, 23), np.int64), np.zeros((n, 23))
        self.inserted, self.deleted = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.counts[np.arange(n), self.letters] = 1
        self.weights[np.arange(n), self.letters] = 1.0
        self.entries, self.distances, self.next = 0, 0.0, n
        self.opening, self.extension, self.fragment, self.margin = opening, extension, fragment, margin

    def costs(self, seq: np.ndarray) -> tuple[np.ndarray, ...]:
        """Opening and extension by column and by residue; they depend on both lengths."""
        m, n = len(self.letters), len(seq)
        short, long = min(m, n), max(m, n)
        opening = self.opening * math.log10(short) / max(1 + 0.5 * math.log10(short / long), 1e-6) * MISMATCH * SCALE
        columns = gap_costs_of(self.states, self.inserted, self.counts[:, X], self.entries + 1, opening, self.extension * (1 + math.log10(m / n)))
        return *columns, opening * GAP_OF[seq], np.full(n, self.extension * (1 + math.log10(n / m)))

    def path(self, seq: np.ndarray) -> list[tuple[int, int, int]]:
        """(column, residue, way) of the best local alignment, last first: 0 a pair, 1 a column without, -1 a residue without.

        The table is filled by anti-diagonals and kept as one byte a cell. A pair goes before a gap, in a cell that a gap
        leads to only this gap goes on; nothing is paid beyond the last column or residue."""
        m, n = len(self.letters), len(seq)
        score = (self.weights @ SCORES / np.maximum(self.weights.sum(1, keepdims=True), 1e-9))
        open_x, more_x, open_y, more_y = self.costs(seq)
        open_x, open_y = np.append(open_x[:-1], 0.0), np.append(open_y[:-1], 0.0)
        own = self.letters >= 0
        ways = np.full((m + n - 1, m), 3, np.int8)
        before, last, down, right = np.zeros(m), np.zeros(m), np.zeros(m), np.zeros(m)
        best = (0.0, 0, 0)
        for t in range(m + n - 1):
            x = np.arange(max(0, t - n + 1), min(m - 1, t) + 1)
            y = t - x
            inner = (x > 0) & (y > 0)
            pair = score[x, seq[y]] + np.where(inner, before[x - 1], 0.0)
            a, b = np.where(x > 0, down[x - 1], 0.0), np.where(y > 0, right[x], 0.0)
            is_pair = (pair >= a) & (pair >= b)
            is_down = ~is_pair & (a >= b)
            cell = np.where(is_pair, pair, np.where(is_down, a, b))
            ways[t, x] = np.where(cell > 0, np.where(is_pair, 0, np.where(is_down, 1, -1)), 3)
            ends = np.where(is_pair & own[x], pair, 0.0)
            k = int(ends.argmax())
            if ends[k] > best[0] or ends[k] == best[0] > 0 and (int(x[k]), int(y[k])) < best[1:]:
                best = (float(ends[k]), int(x[k]), int(y[k]))
            new_x, new_y, go_x, go_y = pair - open_x[x], pair - open_y[y], a - more_x[x], b - more_y[y]
            new_down = np.where(is_pair, new_x, np.where(is_down, go_x, np.maximum(new_x, go_x)))
            new_right = np.where(is_pair, new_y, np.where(is_down, np.maximum(new_y, go_y), go_y))
            before, last = last, before
            last[x] = cell
            down, right = down.copy(), right.copy()
            down[x], right[x] = new_down, new_right
        _, i, j = best
        out = []
        while best[0] > 0 and i >= 0 and j >= 0 and (way := int(ways[i + j, i])) != 3:
            out.append((i, j, way))
            i, j = i - (way >= 0), j - (way <= 0)
        return out

    def add(self, seq: np.ndarray, distance: float) -> dict | None:
        """Aligns a hit and, if it is good enough, takes it into the profile; what its alignment is like, or None."""
        steps = self.path(seq)
        walked = gaps = length = new = ident = similar = end = 0
        for k, (i, j, way) in enumerate(steps):
            walked += not (way == 1 and self.letters[i] < 0)
            gaps += way == -1
            if way == 0 and self.letters[i] >= 0:
                length, new, end = walked, gaps, k + 1
                ident += seq[j] == self.letters[i]
                similar += seq[j] == self.letters[i] or SCORES[self.letters[i], seq[j]] > 0
        if not length or length < len(self.letters) * self.fragment or ident < length * (curve(length) + self.margin):
            return None
        steps = steps[:end]
        first, last = steps[-1], steps[0]
        facts = {"identical": int(ident), "similar": int(similar), "length": length, "ifir": int(self.places[first[0]]), "ilas": int(self.places[last[0]]), "jfir": first[1] + 1, "jlas": last[1] + 1}
        facts |= self._fill(steps, seq, distance, new)
        self.distances += 1 - ident / length
        self.entries += 1
        return facts

    def _fill(self, steps: list[tuple[int, int, int]], seq: np.ndarray, distance: float, new: int) -> dict:
        runs = single = 0
        in_x = in_y = False
        fresh, filled = [], []
        for i, j, way in steps:  # from the last on
            if way == -1:
                runs, single, in_x, in_y = runs + (not in_x), single + 1, True, False
                fresh.append((i + 1, int(seq[j])))
                continue
            residue = X if way == 1 else int(seq[j])
            self.counts[i, residue] += 1
            self.weights[i, residue] += 1 - distance
            if way == 1:
                if self.letters[i] >= 0:
                    runs, single, in_x, in_y = runs + (not in_y), single + 1, False, True
                continue
            filled.append((int(self.numbers[i]), residue))
            if self.letters[i] < 0:
                runs, single, in_x = runs + (not in_x), single + 1, True
            elif in_x:
                self.inserted[i] += 1
                in_x = False
            if in_y:
                self.deleted[i] += 1
                in_y = False
        if fresh:
            fresh.reverse()
            at, residues = [f[0] for f in fresh], np.array([f[1] for f in fresh])
            numbers = np.arange(self.next, self.next + len(fresh))
            self.next += len(fresh)
            counts, weights = np.zeros((len(fresh), 23), np.int64), np.zeros((len(fresh), 23))
            counts[:, X], weights[:, X] = self.entries + 1, self.distances
            counts[np.arange(len(fresh)), residues] += 1
            weights[np.arange(len(fresh)), residues] += 1 - distance
            self.counts, self.weights = np.insert(self.counts, at, counts, 0), np.insert(self.weights, at, weights, 0)
            self.letters, self.places = np.insert(self.letters, at, -1), np.insert(self.places, at, 0)
            self.inserted, self.deleted = np.insert(self.inserted, at, 0), np.insert(self.deleted, at, 0)
            self.numbers = np.insert(self.numbers, at, numbers)
            self.states = "".join(np.insert(np.array(list(self.states)), at, " "))
            filled += list(zip(numbers.tolist(), residues.tolist()))
        return {"gaps": runs, "gapn": single, "columns": [c for c, _ in filled], "letters": "".join(RESIDUES[r] for _, r in filled)}


FACTS = ("identical", "similar", "length", "ifir", "ilas", "jfir", "jlas", "gaps", "gapn")
PATHS = pa.schema([("query_id", pa.int64()), ("hit_id", pa.int64()), *((f, pa.int32()) for f in FACTS), ("columns", pa.list_(pa.int32())), ("letters", pa.string()), ("inserted", pa.list_(pa.int32())), ("deleted", pa.list_(pa.int32()))])
PATHS_SQL = f"query_id long, hit_id long, {', '.join(f'{f} int' for f in FACTS)}, columns array<int>, letters string, inserted array<int>, deleted array<int>"


def paths(hits: DataFrame, **options) -> DataFrame:
    """Paths of the hits (query_id, query, states, hit_id, seq, distance), a row each, length null where one is rejected; and for each query a row with null
    hit_id: the numbers of its columns in order, their letters (. where a hit has inserted one), insertions behind and deletions at each."""
    # A number of its own, since small tables would be put together into one task, though aligning takes long.
    spark = hits.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = hits.select("query_id", "query", "states", "hit_id", "seq", "distance").repartition(tasks, "query_id").sortWithinPartitions("query_id", "distance", "hit_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, profile, out = None, None, []

        def ended() -> dict:
            letters = "".join(RESIDUES[c] if c >= 0 else "." for c in profile.letters)
            return {"query_id": owner, "columns": profile.numbers.tolist(), "letters": letters, "inserted": profile.inserted.tolist(), "deleted": profile.deleted.tolist()}

        for batch in batches:
            for at in range(0, len(batch), 200):
                for r in batch.slice(at, 200).to_pylist():
                    if profile is None or r["query_id"] != owner:
                        if profile is not None:
                            out.append(ended())
                        owner, profile = r["query_id"], Profile(r["query"] or "", r["states"], **options)
                    usable = r["query"] and r["seq"] and r["distance"] is not None
                    out.append({"query_id": owner, "hit_id": r["hit_id"]} | ((profile.add(coded(r["seq"]), r["distance"]) if usable else None) or {}))
                yield pa.RecordBatch.from_pylist(out, PATHS)
                out = []
        if profile is not None:
            yield pa.RecordBatch.from_pylist([ended()], PATHS)

    return rows.mapInArrow(run, PATHS_SQL)


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The aligned row of each path: its letters at its columns' places in the order, points elsewhere."""
    for batch in batches:
        out = []
        for k in range(len(batch)):
            columns = batch.column("columns")[k].values
            if columns is None:
                out.append(None)
                continue
            order = batch.column("order")[k].values.to_numpy()
            place = np.empty(order.max(initial=-1) + 1, np.int64)
            place[order] = np.arange(len(order))
            row = np.full(len(order), ord("."), np.uint8)
            row[place[columns.to_numpy()]] = np.frombuffer(batch.column("letters")[k].as_py().encode(), np.uint8)
            out.append(row.tobytes().decode())
        kept = [c for c in batch.schema.names if c not in ("columns", "letters", "order")]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(out, pa.string())], [*kept, "aligned"])


def progressive(hits: DataFrame, max_hits: int = 5000, **options) -> DataFrame:
    """(query_id, hit_id, accepted, aligned, the numbers in FACTS, inserted, deleted) from hits (query_id, query, hit_id, seq, distance, and states, the
    secondary structure of the query's residues, if there is such a column).

    Hits are taken by distance; those that cover too little of the profile or are below the identity curve for their length stay out, with aligned
    null. The row with null hit_id is the query's: aligned has points where hits have inserted columns, inserted and deleted have a number for each column.
    A limit on hits is for those accepted: of more, a fixed random max_hits stay; before aligning, a fixed random ten times as many
    are taken, as the operator is defined. With max_hits 0 there is no limit. Null and empty sequences are rejected.
    """
    drawn = Window.partitionBy("query_id").orderBy(F.xxhash64("hit_id"), "hit_id")
    if "states" not in hits.columns:
        hits = hits.withColumn("states", F.lit(None).cast("string"))
    few = hits.withColumn("nr", F.row_number().over(drawn)).filter(F.col("nr") <= 10 * max_hits) if max_hits else hits
    order = F.max(F.when(F.col("hit_id").isNull(), F.col("columns"))).over(Window.partitionBy("query_id"))
    found = paths(few, **options).withColumn("order", order)
    kind = f"query_id long, hit_id long, {', '.join(f'{f} int' for f in FACTS)}, inserted array<int>, deleted array<int>, aligned string"
    out = found.mapInArrow(_written, kind).withColumn("accepted", F.col("length").isNotNull())
    if not max_hits:
        return out
    among = Window.partitionBy("query_id", "accepted").orderBy(F.xxhash64("hit_id"), "hit_id")
    return out.withColumn("nr", F.row_number().over(among)).filter(~F.col("accepted") | (F.col("nr") <= max_hits)).drop("nr")
