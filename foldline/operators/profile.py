"""Per-column profiles of aligned rows: counts, entropy, weighted scores, conservation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldline.functions.alphabet import GAPS, PAM250_SCORES, RESIDUES, substitution

PIECE, NEAR = 2_000_000, 1 << 17  # letters counted at once; columns whose counts a task keeps
FULL = 1.5  # similarity of equal residues


def columns_of(aligned: DataFrame, id_col: str, seq_col: str) -> DataFrame:
    """(id_col, pos, res): a row for each letter, pos from 1."""
    return aligned.select(id_col, F.posexplode(F.split(seq_col, "")).alias("pos", "res")).filter("res <> ''").withColumn("pos", F.col("pos") + 1)


def _numbers(raw: bool) -> np.ndarray:
    """The residue number of each byte, 255 for none; of any text (raw), small letters count too and U as X."""
    out = np.full(256, 255, np.uint8)
    out[[ord(c) for c in RESIDUES]] = np.arange(len(RESIDUES))
    if raw:
        out[[ord(c.lower()) for c in RESIDUES]] = np.arange(len(RESIDUES))
        out[[ord("U"), ord("u")]] = RESIDUES.index("X")
    return out


def _letters(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, bytes of each text) of parts of a string array, of about PIECE bytes."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, side="right")) - 1)
        yield data[offsets[at] : offsets[to]], np.diff(offsets[at : to + 1])
        at = to


def residue_counts(rows: DataFrame, text_col: str) -> DataFrame:
    """(number, n): how often each residue number occurs in any texts; a row for each number leaves a task."""
    number = _numbers(True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(256, np.int64)
        for batch in batches:
            for data, _ in _letters(batch.column(0)):
                counts += np.bincount(number[data], minlength=256)
        found = np.flatnonzero(counts[: len(RESIDUES)])
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[found])], ["number", "n"])

    return rows.select(text_col).mapInArrow(run, "number long, n long").groupBy("number").agg(F.sum("n").alias("n"))


def column_counts(aligned: DataFrame, seq_col: str, raw: bool = False) -> DataFrame:
    """(pos, res, n): how often each residue stands in each column, pos from 1. Of raw texts, only residues count as columns.

    Letters are counted in a task before any row leaves it: those of the first NEAR columns in a table of a fixed size, those
    beyond, in long sequences, in pieces."""
    number = _numbers(raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(0, np.int64)

        def counted(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array((keys >> 5) + 1), pa.array(list(RESIDUES)).take(pa.array(keys & 31)), pa.array(n)], ["pos", "res", "n"])

        for batch in batches:
            for data, lengths in _letters(batch.column(0)):
                codes = number[data]
                known = codes < 255
                if raw:
                    ends = np.concatenate([[0], np.cumsum(known)])[np.cumsum(lengths)]
                    codes, lengths, known = codes[known], np.diff(ends, prepend=0), None
                place = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                keys = (place << 5) | codes
                keys = keys if known is None else keys[known]
                near = keys < NEAR << 5
                n = np.bincount(keys[near])
                if len(n) > len(table):
                    table = np.concatenate([table, np.zeros(len(n) - len(table), np.int64)])
                table[: len(n)] += n
                if not near.all():
                    yield counted(*np.unique(keys[~near], return_counts=True))
        found = np.flatnonzero(table)
        yield counted(found, table[found])

    return aligned.select(seq_col).mapInArrow(run, "pos long, res string, n long").groupBy("pos", "res").agg(F.sum("n").alias("n"))


def column_profile(aligned: DataFrame, id_col: str, seq_col: str, raw: bool = False) -> DataFrame:
    """(pos, nocc, n_residues, top_freq, entropy, relent) of each column; X doesn't count as occupied. Of raw texts only residues are columns.

    Counts by column and letter are combined before they are shuffled, so a shuffled row is a
    column and letter of a task, however many rows are aligned.
    """
    counts = column_counts(aligned, seq_col, raw).filter("res <> 'X'")
    n = F.col("n").cast("double")
    # With N = sum n: -sum(n/N ln(n/N)) = ln N - sum(n ln n) / N, from one aggregation.
    sums = counts.groupBy("pos").agg(F.sum("n").alias("nocc"), F.count("*").alias("n_residues"), F.max("n").alias("most"), F.sum(n * F.log(n)).alias("s"))
    entropy = F.greatest(F.lit(0.0), F.log(F.col("nocc").cast("double")) - F.col("s") / F.col("nocc"))
    return sums.select("pos", "nocc", "n_residues", F.round(F.col("most") / F.col("nocc"), 6).alias("top_freq"), F.round(entropy, 6).alias("entropy"), F.round(100 * entropy / F.log(F.lit(20.0)), 4).alias("relent"))


def weighted_scores(aligned: DataFrame, id_col: str, seq_col: str, weight_col: str, scores: DataFrame | None = None) -> DataFrame:
    """(pos, res, score): for each column and residue the mean substitution score (PAM250 unless given), weighted by rows."""
    scores = substitution(aligned.sparkSession, PAM250_SCORES) if scores is None else scores
    w = columns_of(aligned.select(id_col, seq_col), id_col, seq_col).join(aligned.select(id_col, weight_col), id_col).groupBy("pos", "res").agg(F.sum(weight_col).alias("w"))
    pairs = w.join(F.broadcast(scores), F.col("res") == F.col("b"))
    return pairs.groupBy("pos", F.col("a").alias("res")).agg((F.round(F.sum(F.col("w") * F.col("score")) / F.sum("w"), 6) + 0.0).alias("score"))


TILE, STRIP = 256, 512  # rows of a block, columns compared at once
GAP = len(RESIDUES)


def _tiles(aligned: DataFrame, group: str | None, id_col: str, seq_col: str) -> DataFrame:
    """(g, block_a, ids_a, rows_a, block_b, ids_b, rows_b): each pair of blocks of a group's rows once, a block also with itself.

    Rows are dealt to blocks of about TILE by hash, so a task holds two blocks, whatever the number of rows; n rows are n / TILE blocks, which
    are moved n / TILE times, in place of a row for each pair and column."""
    g = F.col(group) if group else F.lit(0)
    rows = aligned.filter(F.length(seq_col) > 0).select(g.alias("g"), F.col(id_col).alias("id"), F.col(seq_col).alias("seq"))
    sizes = rows.groupBy("g").agg(F.ceil(F.count("*") / TILE).alias("blocks")).select(F.col("g").alias("_g"), "blocks")
    dealt = rows.join(sizes, F.col("g").eqNullSafe(F.col("_g"))).withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
    blocks = dealt.groupBy("g", "block").agg(F.collect_list("id").alias("ids"), F.collect_list("seq").alias("rows"))
    a, b = (blocks.select(F.col("g").alias(f"g_{x}"), F.col("block").alias(f"block_{x}"), F.col("ids").alias(f"ids_{x}"), F.col("rows").alias(f"rows_{x}")) for x in "ab")
    pairs = a.join(b, F.col("g_a").eqNullSafe(F.col("g_b")) & (F.col("block_a") <= F.col("block_b")))
    return pairs.select(F.col("g_a").alias("g"), "block_a", "ids_a", "rows_a", "block_b", "ids_b", "rows_b").repartition(max(8, 4 * aligned.sparkSession.sparkContext.defaultParallelism), "g", "block_a", "block_b")


def _coded_rows(rows: list[str], width: int) -> np.ndarray:
    number = np.full(256, RESIDUES.index("X"), np.int64)
    number[[ord(c) for c in RESIDUES]] = np.arange(len(RESIDUES))
    number[[ord(c) for c in GAPS]] = GAP
    out = np.full((len(rows), width), GAP)
    for k, row in enumerate(rows):
        out[k, : len(row)] = number[np.frombuffer(row.encode("latin-1", "replace"), np.uint8)]
    return out


def _strips(a: np.ndarray, b: np.ndarray):
    """(first column, letters of a and of b as 0 and 1 by row, column and residue) in strips."""
    kinds = np.arange(GAP)
    for at in range(0, a.shape[1], STRIP):
        yield at, *((x[:, at : at + STRIP, None] == kinds).astype(np.float32) for x in (a, b))


def _agreements(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many columns two rows have letters in, and how many equal ones, by row of a and of b."""
    both, same = np.zeros((len(a), len(b))), np.zeros((len(a), len(b)))
    for _, x, y in _strips(a, b):
        both += x.sum(2) @ y.sum(2).T
        same += x.reshape(len(a), -1) @ y.reshape(len(b), -1).T
    return both, same


def pair_identity(aligned: DataFrame, id_col: str, seq_col: str) -> DataFrame:
    """(a, b, compared, identity) of all pairs a < b of rows that have letters in a common column; by tiles of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in (x for k in range(len(batch)) for x in batch.slice(k, 1).to_pylist()):
                width = max(map(len, (*r["rows_a"], *r["rows_b"])))
                both, same = _agreements(_coded_rows(r["rows_a"], width), _coded_rows(r["rows_b"], width))
                x, y = np.array(r["ids_a"]), np.array(r["ids_b"])
                ok = (both > 0) & ((x[:, None] < y[None, :]) if r["block_a"] == r["block_b"] else (x[:, None] != y[None, :]))
                i, j = np.nonzero(ok)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x[i], y[j])), pa.array(np.maximum(x[i], y[j])), pa.array(both[i, j].astype(np.int64)), pa.array(same[i, j] / both[i, j])], ["a", "b", "compared", "identity"])

    kind = aligned.schema[id_col].dataType.simpleString()
    rows = _tiles(aligned, None, id_col, seq_col).mapInArrow(run, f"a {kind}, b {kind}, compared long, identity double")
    return rows.withColumn("identity", F.round("identity", 6))


def similarity(spark: SparkSession) -> DataFrame:
    """(a, b, score): BLOSUM62 over the geometric mean of both self-scores, so that equal residues have FULL; by rule, in
    place of a table of similarities on that scale, which can be given instead. B, Z and X have no similarity."""
    s = substitution(spark).filter("a not in ('B', 'Z', 'X') and b not in ('B', 'Z', 'X')")
    own = F.broadcast(s.filter("a = b"))
    return s.join(own.select("a", F.col("score").alias("sa")), "a").join(own.select("b", F.col("score").alias("sb")), "b").select("a", "b", (FULL * F.col("score") / F.sqrt(F.col("sa") * F.col("sb"))).alias("score"))


def conservation(aligned: DataFrame, id_col: str, seq_col: str, scores: DataFrame | None = None, group: str | None = None) -> DataFrame:
    """(pos, weight), with a group's column first if there are groups: least(1, sum of d * similarity over sum of d * FULL) over pairs that have
    a similarity there, d their distance; 1 where undefined.

    Gaps are compared with nothing. Tiles of rows give sums by column, which are added up; a column of n rows is n^2 pairs, but no row of any table."""
    table = np.zeros((GAP, GAP), np.float32)
    known = np.zeros((GAP, GAP), np.float32)
    for a, b, s in (similarity(aligned.sparkSession) if scores is None else scores).collect():  # under 600 rows
        table[RESIDUES.index(a), RESIDUES.index(b)], known[RESIDUES.index(a), RESIDUES.index(b)] = s, 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                r = batch.slice(k, 1).to_pylist()[0]
                width = max(map(len, (*r["rows_a"], *r["rows_b"])))
                a, b = _coded_rows(r["rows_a"], width), _coded_rows(r["rows_b"], width)
                both, same = _agreements(a, b)
                d = np.where(both > 0, 1 - same / np.maximum(both, 1), 0).astype(np.float32)
                if r["block_a"] == r["block_b"]:
                    d = np.triu(d, 1)
                s, t = np.zeros(width), np.zeros(width)
                for at, x, y in _strips(a, b):
                    near = (d @ y.reshape(len(b), -1)).reshape(len(a), -1, GAP)
                    size = x.shape[1]
                    # For each column: how much distance is between each two letters.
                    between = np.einsum("ikc,ike->kce", x, near, optimize=True)
                    s[at : at + size], t[at : at + size] = (between * table).sum((1, 2)), (between * known).sum((1, 2))
                    keep = np.flatnonzero(_met(x, None if r["block_a"] == r["block_b"] else y, known))
                    yield pa.RecordBatch.from_arrays([pa.array([r["g"]] * len(keep), batch.schema.field("g").type), pa.array(keep + at + 1), pa.array(s[keep + at]), pa.array(t[keep + at])], ["g", "pos", "s", "t"])

    tiles = _tiles(aligned, group, id_col, seq_col)
    sums = tiles.mapInArrow(run, f"g {tiles.schema['g'].dataType.simpleString()}, pos long, s double, t double").groupBy("g", "pos").agg(F.sum("s").alias("s"), (F.sum("t") * FULL).alias("t"))
    weight = F.round(F.when(F.col("t") > 0, F.least(F.lit(1.0), F.col("s") / F.col("t"))).otherwise(1.0), 5).alias("weight")
    return sums.select(F.col("g").alias(group), "pos", weight) if group else sums.select("pos", weight)


def _met(x: np.ndarray, y: np.ndarray | None, known: np.ndarray) -> np.ndarray:
    """By column, whether a row of x and one of y (None: another one of x) have letters with a similarity there."""
    n = x.sum(0)
    if y is None:
        pairs = n[:, :, None] * n[:, None, :] - np.eye(GAP, dtype=np.float32)[None] * n[:, :, None]
    else:
        pairs = n[:, :, None] * y.sum(0)[:, None, :]
    return (pairs * known).sum((1, 2)) > 0
