"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters and digits in lower case. One pass over the documents finds the places
where three words in a row are those of a test item. Every n-gram of every item is a seed, so an item
is met wherever it has three words in a row in common with a document, however it is edited elsewhere
and however frequent it is. Around the places of an item as many words are kept as an alignment
can reach; the item is aligned to them unless fewer of its words occur there than the threshold asks for.

An alignment scores 1 for equal words, -0.5 for different ones and -1 for a gap of a word; a document is
contaminated by an item if the best score is at least THRESHOLD times the item's number of words.
Copies without three equal words in a row aren't looked for: they score half the item's words and one at most.

The benchmark is handled in blocks of about BLOCK bytes, so what is broadcast has a bound.

Defined cases: a null or empty text matches nothing; items with fewer than three words are not
looked for; equal items are reported each; repeated documents with one id count as one; an empty
table on either side gives an empty table; only the named columns are read; texts are read whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldline.llm.common import Memo, pieces, table

NAME = "op7_benchmark_decontamination"
N = 3
MISMATCH, GAP, THRESHOLD = 0.5, 1.0, 0.5
BLOCK = 8 << 20
WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


class Items:
    """A block of test items: vocabulary, n-grams and what each item consists of."""

    def __init__(self, items: list[tuple[int, str]]):
        cut = [(i, w) for i, t in sorted(items) if len(w := words_of(t)) >= N]
        self.vocabulary = {w: k + 1 for k, w in enumerate(sorted({w for _, ws in cut for w in ws}))}
        self.ids = [i for i, _ in cut]
        self.words = [np.array([self.vocabulary[w] for w in ws], np.int32) for _, ws in cut]
        codes = [self.codes(w) for w in self.words]
        self.grams = np.unique(np.concatenate(codes)) if codes else np.zeros(0, np.int64)
        # The items of each n-gram, and the words of all items, one after another.
        own = [np.unique(c) for c in codes]
        of = np.searchsorted(self.grams, np.concatenate(own)) if own else np.zeros(0, np.int64)
        self.gram_items = np.repeat(np.arange(len(own)), [len(c) for c in own])[np.argsort(of, kind="stable")]
        self.gram_ends = np.append(0, np.cumsum(np.bincount(of, minlength=len(self.grams))))
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.concatenate(self.words) if self.words else np.zeros(0, np.int32)

    @staticmethod
    def codes(words: np.ndarray) -> np.ndarray:
        """A number for each N words in a row; -1 where one isn't in the vocabulary (of under 2^21 words)."""
        out, known = np.zeros(max(len(words) - N + 1, 0), np.int64), np.ones(max(len(words) - N + 1, 0), bool)
        for j in range(N):
            part = words[j : len(words) - N + 1 + j].astype(np.int64)
            out, known = (out << 21) | part, known & (part > 0)
        return np.where(known, out, -1)


def slices(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of several stretches, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


def passages(items: Items, w: np.ndarray, threshold: float) -> Iterator[tuple[int, int, int]]:
    """(item, begin, end) of the stretches of a document around the n-grams of each item that can reach the threshold."""
    codes = items.codes(w)
    at = np.flatnonzero(codes >= 0)
    g = np.searchsorted(items.grams, codes[at])
    real = items.grams[np.minimum(g, len(items.grams) - 1)] == codes[at]
    at, g = at[real], g[real]
    if not len(at):
        return
    numbers = items.gram_ends[g + 1] - items.gram_ends[g]
    item, place = items.gram_items[slices(items.gram_ends[g], numbers)], np.repeat(at, numbers)
    # No alignment reaches the threshold with fewer equal words; first in the whole document.
    some, back = np.unique(item, return_inverse=True)
    there = np.zeros(len(items.vocabulary) + 1, bool)
    there[w] = True
    there[0] = False
    sizes = items.lengths[some]
    equal = np.add.reduceat(there[items.flat[slices(items.starts[some], sizes)]], np.cumsum(sizes) - sizes, dtype=np.int64)
    keep = (equal >= threshold * sizes)[back]
    item, place = item[keep], place[keep]
    if not len(item):
        return
    order = np.lexsort((place, item))
    item, place = item[order], place[order]
    reach = 2 * items.lengths[item]
    new = np.flatnonzero((np.diff(item) != 0) | (np.diff(place) > reach[1:])) + 1
    first, last = np.append(0, new), np.append(new, len(item)) - 1
    begins, ends = np.maximum(place[first] - reach[first], 0), np.minimum(place[last] + N + reach[last], len(w))
    for k, begin, end in zip(item[first].tolist(), begins.tolist(), ends.tolist()):
        there[:] = False
        there[w[begin:end]] = True
        there[0] = False
        if there[items.words[k]].sum() >= threshold * len(items.words[k]):
            yield k, begin, end


def align(item: np.ndarray, words: np.ndarray) -> tuple[float, int]:
    """Best local alignment score of an item within words, and where in words it ends."""
    places = np.arange(1, len(words) + 1) * GAP
    row, best, end = np.zeros(len(words) + 1), 0.0, 0
    for w in item:
        step = np.maximum(row[:-1] + np.where(words == w, 1.0, -MISMATCH), row[1:] - GAP)
        np.maximum(step, 0, out=step)
        step = np.maximum.accumulate(step + places) - places  # gaps in the item
        row = np.concatenate([[0.0], step])
        k = int(row.argmax())
        if row[k] > best:
            best, end = float(row[k]), k
    return best, end


def contaminated(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, score, end_word): score is the alignment's share of the item; end_word where it ends."""
    items = benchmark.select(F.col("item_id").cast("long"), "text").filter("item_id is not null")
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, math.ceil(size / BLOCK))
    found = None
    for b in range(blocks):
        some = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()  # about BLOCK bytes
        part = _block(documents, Items([(r["item_id"], r["text"]) for r in some]), threshold)
        found = part if found is None else found.unionByName(part)
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", "end_word")).alias("best")).select("doc_id", "item_id", "best.score", "best.end_word")


def _block(documents: DataFrame, items: Items, threshold: float) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        known = items.vocabulary
        numbers = Memo(lambda c: tuple(known.get(w, 0) for w in WORD.findall(c.lower())))
        for batch in batches:
            for part in pieces(batch):
                out = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    w = np.fromiter(chain.from_iterable(map(numbers.__getitem__, (text or "").split())), np.int32)
                    if len(w) < N or not len(items.grams):
                        continue
                    for k, begin, stop in passages(items, w, threshold):
                        score, end = align(items.words[k], w[begin:stop])
                        if score >= threshold * len(items.words[k]):
                            out.append((doc, items.ids[k], score / len(items.words[k]), begin + end))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), TYPES)], ["doc_id", "item_id", "score", "end_word"])

    TYPES = [pa.int64(), pa.int64(), pa.float64(), pa.int64()]
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, item_id long, score double, end_word long")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and test item of which it holds a copy, also an edited one."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
