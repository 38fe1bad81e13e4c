"""Databank search: low-complexity masking, seeds by joins, gapped alignments with drop-offs, expectation values.

Words, seeds, pairs and hits are tables; only the extension of a pair's seeds and the alignments run in Arrow batches.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldline.functions.alphabet import RESIDUES
from foldline.functions.statistics import Scoring, merged_hits, search_space
from foldline.operators.gapped import coded, from_seed, traced, ungapped_hsps
from foldline.operators.seeds import HIT_WINDOW, WORD, pair_seeds, seeds, word_index

SEG_WINDOW, SEG_LOW, SEG_HIGH, SEG_TRIM = 12, 2.2, 2.5, 50
SALTS = 32


def entropy(counts: Counter, size: int) -> float:
    return -sum(n / size * math.log2(n / size) for n in counts.values() if n)


def _log_probability(text: str) -> float:
    """Natural log of the chance of a composition as complex as this one."""
    n, counts = len(text), sorted(Counter(text).values())
    ways = math.lgamma(n + 1) - sum(math.lgamma(c + 1) for c in counts)
    kinds = math.lgamma(21) - math.lgamma(max(21 - len(counts), 1)) - sum(math.lgamma(k + 1) for k in Counter(counts).values())
    return ways + kinds - n * math.log(20)


def low_complexity(seq: str, window: int = SEG_WINDOW, low: float = SEG_LOW, high: float = SEG_HIGH, trim: int = SEG_TRIM) -> list[tuple[int, int]]:
    """Stretches of low complexity: seen in a window, extended, then trimmed to their least likely part.

    What trimming leaves on the left is searched again if the window was seen there."""
    n = len(seq)
    if n < window:
        return []
    values, counts = [], Counter(seq[:window])
    for i in range(n - window + 1):
        values.append(entropy(counts, window))
        if i + window < n:
            counts[seq[i]] -= 1
            counts[seq[i + window]] += 1
    found, i, first = [], 0, 0
    while i < len(values):
        if values[i] > low:
            i += 1
            continue
        a = b = i
        while a > first and values[a - 1] <= high:
            a -= 1
        while b + 1 < len(values) and values[b + 1] <= high:
            b += 1
        size = b + window - a
        least, best = 1.0, (a, a + size)
        for n_part in range(size, max(1, size - trim), -1):
            for s in range(a, a + size - n_part + 1):
                p = _log_probability(seq[s : s + n_part])
                if p < least:
                    least, best = p, (s, s + n_part)
        if i + window <= best[0]:  # the window that was seen lies to the left of what trimming kept
            found += [(a + x, a + y) for x, y in low_complexity(seq[a : best[0]], window, low, high, trim)]
        found.append(best)
        i = first = min(best[1] - 1, b) + 1
    return found


def seg_mask_with(options: dict):
    """A function of a column of sequences that puts X into stretches of low complexity."""

    def one(s):
        if s is None:
            return None
        out = list(s)
        for a, b in low_complexity(s, **options):
            out[a:b] = "X" * (b - a)
        return "".join(out)

    @F.pandas_udf(T.StringType())
    def masked(seqs: pd.Series) -> pd.Series:
        return seqs.map(one)

    return masked


DUST = {"window": 32, "low": 1.4, "high": 1.6, "trim": 100}
seg_mask = seg_mask_with({})



BOX = "struct<score: long, q_start: int, q_end: int, t_start: int, t_end: int>"
HSP = "struct<score: long, q_start: int, q_end: int, t_start: int, t_end: int, identical: int, aligned_query: string, aligned_target: string>"


def _overlap(a: dict, b: dict) -> bool:
    return a["q_end"] >= b["q_start"] and a["q_start"] <= b["q_end"] and a["t_end"] >= b["t_start"] and a["t_start"] <= b["t_end"]


def _scored(scoring: Scoring, key: pa.DataType):
    """Rows of pairs with their seeds to rows of pairs with stretches, each with the score of the gapped alignment through its middle."""
    cut = scoring.cut_offs()
    kind = pa.schema([("query_id", pa.int64()), ("target_id", key), ("query", pa.string()), ("target", pa.string()), ("boxes", pa.list_(pa.struct([("score", pa.int64()), *((c, pa.int32()) for c in ("q_start", "q_end", "t_start", "t_end"))])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            ids = batch.column("target_id").to_pylist()
            for k, target_id in enumerate(ids):
                query, target = batch.column("query")[k].as_py(), batch.column("target")[k].as_py()
                x, y = coded(query), coded(target)
                found: list[dict] = []
                diagonals, places, second = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in ("diagonals", "places", "second"))
                some = np.isin(diagonals, diagonals[second])  # those with a second hit
                for q_start, q_end, t_start, t_end in ungapped_hsps(x, y, diagonals[some], places[some], WORD, HIT_WINDOW, cut["drop_ungapped"], cut["least_ungapped"]):
                    score = from_seed(x, y, (q_start + q_end) // 2, (t_start + t_end) // 2, scoring.opening + scoring.extension, scoring.extension, cut["drop_gapped"])
                    box = {"score": score, "q_start": q_start, "q_end": q_end, "t_start": t_start, "t_end": t_end}
                    # Of stretches that overlap, the best scoring one stays.
                    other = next((i for i, f in enumerate(found) if _overlap(box, f)), None)
                    if other is None:
                        found.append(box)
                    elif found[other]["score"] < score:
                        found[other] = box
                if found:
                    rows.append({"query_id": batch.column("query_id")[k].as_py(), "target_id": target_id, "query": query, "target": target, "boxes": found})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, kind)

    return run


def _aligned(scoring: Scoring, key: pa.DataType):
    """Rows of pairs with stretches to rows of pairs with aligned parts."""
    cut = scoring.cut_offs()
    kind = pa.schema([("query_id", pa.int64()), ("target_id", key), ("hsps", pa.list_(pa.struct([("score", pa.int64()), *((c, pa.int32()) for c in ("q_start", "q_end", "t_start", "t_end", "identical")), ("aligned_query", pa.string()), ("aligned_target", pa.string())])))])

    def one(query: str, target: str, box: dict) -> dict:
        x, y = coded(query), coded(target)
        score, q, q_end, t, t_end, steps = traced(x, y, (box["q_start"] + box["q_end"]) // 2, (box["t_start"] + box["t_end"]) // 2, scoring.opening + scoring.extension, scoring.extension, cut["drop_final"])
        out, rows, same, i, j = {"score": score, "q_start": q, "q_end": q_end, "t_start": t, "t_end": t_end}, ([], []), 0, q, t
        for step in steps:
            rows[0].append(RESIDUES[x[i]] if step >= 0 else "-")
            rows[1].append(RESIDUES[y[j]] if step <= 0 else "-")
            same += step == 0 and x[i] == y[j]
            i, j = i + (step >= 0), j + (step <= 0)
        return out | {"identical": int(same), "aligned_query": "".join(rows[0]), "aligned_target": "".join(rows[1])}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 50):
                rows = batch.slice(at, 50).to_pylist()
                yield pa.RecordBatch.from_pylist([{"query_id": r["query_id"], "target_id": r["target_id"], "hsps": [one(r["query"], r["target"], b) for b in r["boxes"]]} for r in rows], kind)

    return run


def first_rows(rows: DataFrame, group: str, order: list, most: int, key: str) -> DataFrame:
    """The first `most` rows of each group: drawn in SALTS parts of a group by key first, so that no task reads all of one."""
    parts = Window.partitionBy(group, F.pmod(F.xxhash64(key), F.lit(SALTS))).orderBy(*order)
    few = rows.withColumn("_nr", F.row_number().over(parts)).filter(F.col("_nr") <= most)
    return few.withColumn("_nr", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("_nr") <= most).drop("_nr")


def search(queries: DataFrame, *databanks: DataFrame, expect: float = 10.0, most: int = 0, scoring: Scoring = Scoring(), masked: bool = True, index: DataFrame | None = None) -> DataFrame:
    """(query_id, databank, target_id, nr, score, bits, expect, q_start, q_end, t_start, t_end, identical, aligned_query, aligned_target)
    of the parts (HSPs) of all hits; all tables have id (long) and seq, places count from 1, databanks from 0.

    Seeds come from joins of words; pairs with a second hit on some diagonal are joined with their sequences. A stretch that
    reaches the ungapped cut-off is aligned from its middle, with a drop-off, for its score; of each query's targets the best `most` by that
    (0: all) are aligned with the larger drop-off of the final pass. Parts that overlap a better one of the same target go;
    expectations count all databanks as one. Nulls and sequences shorter than a word have no hits.

    index: word_index of the databanks' union, if it is stored; its ids are (databank, id).
    """
    bank = None
    for k, df in enumerate(databanks):
        own = df.select(F.struct(F.lit(k).alias("databank"), F.col("id").alias("id")).alias("id"), "seq")
        bank = own if bank is None else bank.unionByName(own)
    there = bank.filter(F.length("seq") > 0)
    stats = there.agg(F.count("*").alias("n"), F.sum(F.length("seq")).alias("letters")).first()
    n, letters = stats["n"], stats["letters"] or 0
    asked = queries.filter(F.length("seq") > 0).select(F.col("id").cast("long").alias("id"), (seg_mask("seq") if masked else F.col("seq")).alias("seq"))
    size = queries.agg(F.sum(F.length("seq"))).first()[0] or 0
    pairs = pair_seeds(seeds(asked, word_index(there) if index is None else index, size), HIT_WINDOW)
    few = F.broadcast if size <= 4 << 20 else lambda df: df  # of queries' letters
    joined = pairs.join(few(asked.select(F.col("id").alias("query_id"), F.col("seq").alias("query"))), "query_id").join(there.select(F.col("id").alias("target_id"), F.col("seq").alias("target")), "target_id")
    key = pa.struct([("databank", pa.int32()), ("id", pa.int64())])
    # Aligning a pair takes far longer than moving it.
    spark = queries.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = joined.select("query_id", "target_id", "query", "target", "diagonals", "places", "second").repartition(tasks, "query_id", "target_id")
    rows = dealt.mapInArrow(_scored(scoring, key), f"query_id long, target_id struct<databank: int, id: long>, query string, target string, boxes array<{BOX}>")
    if most:
        rows = first_rows(rows.withColumn("_best", F.array_max("boxes.score")), "query_id", [F.desc("_best"), "target_id"], most, "target_id").drop("_best").repartition(tasks, "query_id", "target_id")
    hits = rows.mapInArrow(_aligned(scoring, key), f"query_id long, target_id struct<databank: int, id: long>, hsps array<{HSP}>")
    spaces = queries.select(F.col("id").alias("query_id"), search_space(F.length("seq"), F.lit(letters), F.lit(n), scoring).alias("room"))
    hits = hits.join(few(spaces), "query_id").select("query_id", "target_id", merged_hits(F.col("hsps"), F.col("room"), expect, scoring).alias("hsps"))
    out = hits.select("query_id", "target_id.*", F.posexplode("hsps").alias("nr", "h"))
    return out.select("query_id", "databank", F.col("id").alias("target_id"), (F.col("nr") + 1).alias("nr"), "h.score", "h.bits", "h.expect", (F.col("h.q_start") + 1).alias("q_start"), "h.q_end", (F.col("h.t_start") + 1).alias("t_start"), "h.t_end", "h.identical", "h.aligned_query", "h.aligned_target")
