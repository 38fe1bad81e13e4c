"""Quality classifier: hashed word n-gram logistic regression, fitted by follow-the-regularised-leader.

Features are single words and word pairs, and the same of word shapes (runs of upper case, lower
case and digits count as one letter, other characters as themselves); a pair of equal words is a
feature of its own. A document's vector holds, for each family, the share of its n-grams that fall
on a slot. Scores are the sigmoid of a sparse dot product with the weights.

The fit takes at most SAMPLE labelled rows (those with the smallest hash of their id); it runs in
SHARDS tasks, each with its share of the rows, and the shards' weights are averaged. Everything
else covers all rows.

Defined cases: a null text counts as empty, and its vector has only the bias and the length slot;
rows without a usable label are scored but not learnt from; labels outside 0 and 1 or null are not
used; several labels of a document all count; without any usable label all scores are 0.5; repeated
rows are scored alike; only the named columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldline.llm.common import Memo, crc_mod, pieces, table

NAME = "op8_quality_classifier"
SAMPLE, SHARDS, EPOCHS = 24_000, 8, 3
BITS = 17
SLOTS = 4 << BITS
RUNS = 8
ALPHA, BETA, L1, L2, SCALE = 0.3, 0.05, 0.02, 0.001, 8.0


def shape(word: str) -> str:
    """Runs of the whole word; more than RUNS of them by the kinds that occur and the order of magnitude of their number."""
    out = []
    for c in word:
        k = "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out) if len(out) <= RUNS else f"{''.join(sorted(set(out)))} {len(out).bit_length()}"


def word_codes(word: str) -> int:
    """31 bits of the lower-cased word's hash above 32 bits of its shape's hash."""
    return (zlib.crc32(word.lower().encode()) >> 1) << 32 | zlib.crc32(shape(word).encode())


def _slots(codes: np.ndarray) -> list[np.ndarray]:
    """The slots of each n-gram, by family; pairs are of each word with the next one."""
    words, shapes = (codes >> np.uint64(32)) + np.uint64(1), (codes & np.uint64(0xFFFFFFFF)) + np.uint64(1)
    mix = np.uint64(0x9E3779B97F4A7C15)
    out = []
    for k, (a, pair) in enumerate(((words, False), (words, True), (shapes, False), (shapes, True))):
        if pair:
            a = np.where(words[:-1] == words[1:], np.uint64(0), a[:-1] * np.uint64(0xD6E8FEB86659FD93) + a[1:])
        out.append(((a * mix) >> np.uint64(64 - BITS)).astype(np.int64) + (k << BITS))
    return out


class Features:
    def __init__(self) -> None:
        self.codes = Memo(word_codes)

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Slots and values of a text; the last slot but one is the bias, the last ones stand for lengths."""
        words = (text or "").split()
        codes = np.fromiter(map(self.codes.__getitem__, words), np.uint64, len(words))
        slots, values = [np.array([SLOTS, SLOTS + 1 + min(len(words), 1 << 20).bit_length()])], [np.ones(2)]
        for s in _slots(codes):
            if len(s):
                u, n = np.unique(s, return_counts=True)
                slots.append(u)
                values.append(n * (SCALE / len(s)))
        return np.concatenate(slots), np.concatenate(values)

    def scores(self, texts: list[str | None], weights: np.ndarray) -> np.ndarray:
        """Dot products of many texts: each n-gram adds its weight over the number of n-grams."""
        words = [(t or "").split() for t in texts]
        sizes = np.array([len(w) for w in words])
        codes = np.fromiter((self.codes[w] for ws in words for w in ws), np.uint64, int(sizes.sum()))
        total = weights[SLOTS] + weights[SLOTS + 1 + np.array([min(n, 1 << 20).bit_length() for n in sizes.tolist()], int)]
        ends = np.cumsum(sizes)
        last = np.zeros(len(codes), bool)
        last[ends[sizes > 0] - 1] = True
        row = np.repeat(np.arange(len(texts)), sizes)
        for k, s in enumerate(_slots(codes)):
            if k % 2:
                s, r, n = s[~last[:-1]], row[:-1][~last[:-1]], sizes - 1
            else:
                r, n = row, sizes
            total = total + np.bincount(r, weights[s], len(texts)) * (SCALE / np.maximum(n, 1))
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights after passing over the examples one at a time."""
    z, n = np.zeros(SLOTS + 32), np.zeros(SLOTS + 32)

    def weight(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(epochs):
        for i, x, y in examples:
            w = weight(i)
            p = 1 / (1 + np.exp(-np.clip((w * x).sum(), -30, 30)))
            g = (p - y) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
    return weight(np.arange(SLOTS + 32))


def labelled(documents: DataFrame, labels: DataFrame, label_col: str, sample: int) -> DataFrame:
    """(h, text, y) of the documents that at most sample labels of 0 or 1 are of; h is a hash of doc_id.

    The sample is drawn from the labels, so that it can be broadcast and only its texts move. Of several texts of
    one doc_id the greatest is learnt from, so that repeated rows can't outgrow the sample.
    """
    few = labels.select(F.col("doc_id").alias("__id"), F.col(label_col).cast("int").alias("y")).filter("y in (0, 1) and __id is not null")
    few = few.distinct().orderBy(F.xxhash64("__id"), "y").limit(sample)
    return documents.select(F.col("doc_id").alias("__doc"), "text").join(F.broadcast(few), F.col("__doc") == F.col("__id")).groupBy("__doc", "y").agg(F.max("text").alias("text")).select(F.xxhash64("__doc").alias("h"), "text", "y")


def fit(documents: DataFrame, labels: DataFrame, label_col: str, sample: int = SAMPLE) -> np.ndarray:
    """Weights learnt from documents (doc_id, text) with at most sample labels (doc_id, label_col)."""
    few = labelled(documents, labels, label_col, sample).withColumn("shard", F.pmod("h", F.lit(SHARDS)))

    def run(group):
        made = Features()
        order = sorted(zip(*(group.column(c).to_pylist() for c in ("h", "text", "y"))), key=lambda r: r[0])
        w = ftrl([(*made.of(text), y) for _, text, y in order])
        at = np.flatnonzero(w)
        return pa.table({"slot": at, "w": w[at]})

    # A group is sample / SHARDS rows at most; the weights are a bounded vector.
    found = few.repartition(SHARDS, "shard").groupBy("shard").applyInArrow(run, "slot long, w double")
    total = found.groupBy("slot").agg(F.sum(F.col("w")).alias("w")).toPandas()
    weights = np.zeros(SLOTS + 32)
    weights[total["slot"].to_numpy(np.int64)] = total["w"].to_numpy() / SHARDS
    return weights


def score(df: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score)."""
    shared = df.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, w = Features(), shared.value.astype(np.float64)
        for batch in batches:
            for part in pieces(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made.scores(part.column(1).to_pylist(), w))], [id_col, "score"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, score double")


def scorer(spark: SparkSession, weights: np.ndarray):
    """A function of a text column that gives its scores; for filters that keep all columns."""
    shared = spark.sparkContext.broadcast(weights.astype(np.float32))

    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        made, w = Features(), shared.value.astype(np.float64)
        for t in texts:
            rows = t.tolist()
            yield pd.Series(np.concatenate([made.scores(rows[i : i + 500], w) for i in range(0, len(rows), 500)] or [np.zeros(0)]))

    return F.pandas_udf(of, "double", F.PandasUDFType.SCALAR_ITER)


def classify(documents: DataFrame, labels: DataFrame, label_col: str, modulus: int, held: int, fit_with, score_with, threshold: float) -> DataFrame:
    """(doc_id, held_out, score, predicted) of all documents; rows with crc32(doc_id) % modulus = held are not learnt from."""
    usable = labels.filter(crc_mod("doc_id", modulus) != held)
    scored = score_with(documents, fit_with(documents, usable, label_col))
    return scored.select("doc_id", (crc_mod("doc_id", modulus) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality", 3, 1, fit, score, 0.5)
