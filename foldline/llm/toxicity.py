"""Toxicity by weak supervision.

Lexicon voters are word beginnings and whole words that labelled toxic documents have far more
often; pattern voters look at how many lexicon words a text has and how close they stand. A
generative label model takes each voter as a noisy source: expectation maximisation estimates how
often it fires in either class and, along a tree of the strongest correlations, after another voter. The given label is
one more voter, whose accuracy is measured against what the others say. A linear (logistic) classifier is then
trained on the posterior labels and scores all texts.

The fit takes at most SAMPLE labelled rows (those with the smallest hash of their id), of which at
most VOTERS word beginnings come to the driver; everything else covers all rows.

Defined cases: a null text counts as empty; rows without a usable label are scored but not learnt
from; labels outside 0 and 1 or null are not used; without labels of both classes no word is known
and all scores are 0; repeated rows are scored alike; only the named columns are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldline.llm.common import Memo, pieces, stored, table
from foldline.llm.quality import classify, labelled

NAME = "op10_toxicity"
SAMPLE, VOTERS, CANDIDATES = 24_000, 200, 20_000
SHORTEST, LONGEST, LEAST_DOCS, LEAST_LLR = 4, 12, 4, 18.0
WORD = re.compile(r"[^\W\d_]+")
PATTERNS = 6
TRUST, RIGHT = 100, 0.99  # before anything is seen, labels count as right as often as in so many rows


@dataclass
class Model:
    terms: dict[str, int] = field(default_factory=dict)  # a trailing $ marks a whole word
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))


class Votes:
    """Which voters fire on a text."""

    def __init__(self, terms: dict[str, int]):
        self.terms, self.size = terms, len(terms)
        self.hits = Memo(self._hits)

    def _hits(self, chunk: str) -> tuple[int, ...]:
        found = []
        for word in WORD.findall(chunk.lower()):
            whole = word + "$"
            k = next((self.terms[whole[:n]] for n in range(SHORTEST, min(len(whole), LONGEST) + 1) if whole[:n] in self.terms), None)
            if k is not None:
                found.append(k)
        return tuple(found)

    def features(self, texts: list[str | None]) -> np.ndarray:
        """A row a text: log counts of each lexicon voter, then the patterns."""
        out = np.zeros((len(texts), self.size + PATTERNS))
        get = self.hits.__getitem__
        for r, text in enumerate(texts):
            chunks = (text or "").split()
            places = [(i, k) for i, ks in enumerate(map(get, chunks)) if ks for k in ks]
            if not places:
                continue
            counts = Counter(k for _, k in places)
            for k, n in counts.items():
                out[r, k] = math.log1p(n)
            near = sum(b[0] - a[0] <= 40 for a, b in zip(places, places[1:]))
            dense = 100 * len(places) / len(chunks)
            out[r, self.size :] = (1, len(places) >= 2, len(counts) >= 2, len(places) >= 4, near >= 1, min(dense, 4) / 4)
        return out


def count_words(rows: DataFrame) -> DataFrame:
    """(word, toxic, clean): in how many texts of either label each distinct word stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())
        for batch in batches:
            for text, y in zip(*(c.to_pylist() for c in batch.columns)):
                counts[y].update(set(WORD.findall((text or "").lower())))
        words = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([counts[1][w] for w in words], pa.int64()), pa.array([counts[0][w] for w in words], pa.int64())], ["word", "toxic", "clean"])

    return rows.select("text", "y").mapInArrow(run, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def choose_terms(rows: DataFrame) -> dict[str, int]:
    """Word beginnings by their log-likelihood ratio; none begins with another one."""
    totals = rows.agg(F.sum(F.col("y")).alias("t"), F.count("*").alias("n")).first()
    toxic, clean = totals["t"] or 0, (totals["n"] or 0) - (totals["t"] or 0)
    if not toxic or not clean:
        return {}
    whole = F.concat("word", F.lit("$"))
    starts = F.transform(F.sequence(F.lit(SHORTEST), F.least(F.length(whole), F.lit(LONGEST))), lambda n: whole.substr(F.lit(1), n))
    terms = count_words(rows).filter(F.length(whole) >= SHORTEST).select(F.explode(starts).alias("term"), "toxic", "clean").groupBy("term").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    share = toxic / (toxic + clean)
    n, p = F.col("a") + F.col("b"), (F.col("a") / (F.col("a") + F.col("b")))
    ratio = F.col("a") * F.log(p / share) + F.when(F.col("b") > 0, F.col("b") * F.log((1 - p) / (1 - share))).otherwise(0.0)
    best = terms.filter((F.col("a") >= LEAST_DOCS) & (p > max(0.5, share))).withColumn("llr", 2 * ratio).filter(F.col("llr") >= LEAST_LLR).withColumn("n", n)
    chosen: dict[str, int] = {}
    beginnings: set[str] = set()
    # A longer beginning wins a tie, so that chance neighbours of a stem stay out.
    for r in best.orderBy(F.desc("llr"), F.desc(F.length("term")), "term").limit(CANDIDATES).collect():
        t = r["term"]
        if t in beginnings or any(t[:k] in chosen for k in range(SHORTEST, len(t) + 1)):
            continue
        chosen[t] = len(chosen)
        beginnings |= {t[:k] for k in range(SHORTEST, len(t) + 1)}
        if len(chosen) == VOTERS:
            break
    return chosen


def dependency_tree(votes: np.ndarray, classes: list[np.ndarray]) -> list[int]:
    """For each voter the one it depends on (-1 for the first): the spanning tree of the greatest mutual information within the classes."""
    size, total = votes.shape[1], sum(w.sum() for w in classes)
    gain = np.zeros((size, size))
    for w in classes:
        n = w.sum() + 1.0
        on = (votes.T @ w + 0.5) / n
        both = ((votes.T * w) @ votes + np.outer(on, on)) / n
        one, other = on[:, None], on[None, :]
        for p, of in ((both, one * other), (one - both, one * (1 - other)), (other - both, (1 - one) * other), (1 - one - other + both, (1 - one) * (1 - other))):
            p = np.maximum(p, 1e-12)
            gain += n / total * p * np.log(p / of)
    parent, best, left = [-1] * size, gain[0].copy(), np.arange(size) > 0
    near = np.zeros(size, int)
    while left.any():
        k = int(np.where(left, best, -np.inf).argmax())
        parent[k], left[k] = int(near[k]), False
        closer = left & (gain[k] > best)
        best[closer], near[closer] = gain[k][closer], k
    return parent


def label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = 8, times: np.ndarray | None = None) -> np.ndarray:
    """Posterior probability of the toxic class for each row of 0/1 votes; times is how often each row occurs.

    Voters fire by the class and by the voter that they depend on; expectation maximisation estimates the class share, the
    dependencies and how often a voter fires in each case. The labels give the first guess; afterwards they are
    one more voter, whose accuracy is measured by what the other voters say without it.
    """
    times = np.ones(len(labels)) if times is None else times.astype(float)
    votes = votes.astype(float)
    q = labels.astype(float)
    for _ in range(rounds):
        classes = [times * (1 - q), times * q]
        parent = dependency_tree(votes, classes)
        on = np.array([p if p >= 0 else 0 for p in parent])
        above = votes[:, on] * (np.array(parent) >= 0)  # the first voter depends on nothing
        evidence = np.full(len(q), np.log(max(classes[1].sum(), 1e-3) / max(classes[0].sum(), 1e-3)))
        for sign, w, few in ((-1, classes[0], 0.1), (1, classes[1], 0.5)):
            rate = (votes.T @ w + few) / (w.sum() + 2)  # what is seen in few rows is pulled to the voter's own rate
            for state in (above, 1 - above):
                fires = ((state * votes).T @ w + 4 * rate) / (state.T @ w + 4)
                evidence += sign * (state * (votes * np.log(fires) + (1 - votes) * np.log(1 - fires))).sum(1)
        said = 1 / (1 + np.exp(-np.clip(evidence, -30, 30)))
        right1 = ((times * said) @ labels + TRUST * RIGHT) / ((times * said).sum() + TRUST)
        right0 = ((times * (1 - said)) @ (1 - labels) + TRUST * RIGHT) / ((times * (1 - said)).sum() + TRUST)
        given = np.where(labels == 1, np.log(right1 / (1 - right0)), np.log((1 - right1) / right0))
        q = 1 / (1 + np.exp(-np.clip(evidence + given, -30, 30)))
    return q


def logistic(x: np.ndarray, q: np.ndarray, ridge: float = 0.3, rounds: int = 25, times: np.ndarray | None = None) -> np.ndarray:
    """Weights (bias last) that fit probabilities q, by Newton's method; times is how often each row occurs."""
    times = np.ones(len(q)) if times is None else times.astype(float)
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (times * (p * (1 - p) + 1e-6))) @ x + np.diag(penalty), x.T @ (times * (p - q)) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(documents: DataFrame, labels: DataFrame, label_col: str, sample: int = SAMPLE) -> Model:
    """The voters' words and the classifier's weights, from documents (doc_id, text) with at most sample labels (doc_id, label_col)."""
    few = stored(labelled(documents, labels, label_col, sample).dropDuplicates(["text", "y"]))
    terms = choose_terms(few)
    if not terms:
        return Model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        votes = Votes(terms)
        for batch in batches:
            for part in pieces(batch):
                x = votes.features(part.column(0).to_pylist())
                at = [np.flatnonzero(r) for r in x]
                yield pa.RecordBatch.from_arrays([pa.array([a.tolist() for a in at], pa.list_(pa.int32())), pa.array([r[a].tolist() for r, a in zip(x, at)], pa.list_(pa.float64())), part.column(1)], ["at", "value", "y"])

    # Rows that are alike, as all without a vote are, come as one row with their number; all are sample rows at most.
    found = few.select("text", "y").mapInArrow(run, "at array<int>, value array<double>, y int").groupBy("at", "value", "y").agg(F.count("*").alias("n")).orderBy("at", "value", "y").toPandas()
    x = np.zeros((len(found), len(terms) + PATTERNS))
    for r, (at, value) in enumerate(zip(found["at"], found["value"])):
        x[r, list(at)] = list(value)
    times = found["n"].to_numpy()
    q = label_model((x > 0).astype(float), found["y"].to_numpy(), times=times)
    return Model(terms, logistic(x, q, times=times))


def probabilities(votes: Votes, model: Model, texts: list[str | None]) -> np.ndarray:
    if not model.terms:
        return np.zeros(len(texts))
    return 1 / (1 + np.exp(-np.clip(votes.features(texts) @ model.weights[:-1] + model.weights[-1], -30, 30)))


def scorer(spark: SparkSession, model: Model):
    """A function of a text column that gives its scores; for filters that keep all columns."""
    shared = spark.sparkContext.broadcast(model)

    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        votes = Votes(shared.value.terms)
        for t in texts:
            rows = t.tolist()
            yield pd.Series(np.concatenate([probabilities(votes, shared.value, rows[i : i + 500]) for i in range(0, len(rows), 500)] or [np.zeros(0)]))

    return F.pandas_udf(of, "double", F.PandasUDFType.SCALAR_ITER)


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score)."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        votes = Votes(m.terms)
        for batch in batches:
            for part in pieces(batch):
                p = probabilities(votes, m, part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p)], [id_col, "score"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, score double")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "toxic", 4, 2, fit, score, 0.3)
