"""Word seeds between sequences: an inverted index of words, neighbouring words, hits on diagonals and second hits, by joins and windows; those of
few queries in the rows of the sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from foldline.functions.alphabet import MATRIX, RESIDUES, substitution
from foldline.operators.gapped import NUMBER

# Letters in a word, what a neighbouring word has to score, and how far a second hit on a diagonal may be.
WORD, WORD_SCORE, HIT_WINDOW = 3, 11, 40
SALTS = 8
BROADCAST_WORDS = 1_000_000
# Letters of queries that are looked for together, letters in which and seeds that are sorted together, if they aren't those of one sequence.
TOGETHER, LETTERS, SORTED = 2_000, 200_000, 300_000


def words_of(sequences: DataFrame, *names: str) -> DataFrame:
    """The columns named, place (from 0) and word of all words of the sequences in seq; in one pass over the letters of each."""
    letters = sequences.filter(F.length("seq") >= WORD).select(*names, F.split("seq", "").alias("_c"), (F.length("seq") - WORD).alias("_last"))
    word = F.transform(F.sequence(F.lit(0), F.col("_last")), lambda k: F.concat(*[F.get("_c", k + x) for x in range(WORD)]))
    return letters.select(*names, F.posexplode(word).alias("place", "word"))


def word_index(sequences: DataFrame) -> DataFrame:
    """(word, id, place) of all words of sequences (id, seq); words with X aren't indexed, since no neighbour has one.

    A row becomes as many as it has letters: sequences in fewer partitions than there are cores are dealt out first."""
    cores = sequences.sparkSession.sparkContext.defaultParallelism
    if sequences.rdd.getNumPartitions() < cores:
        sequences = sequences.repartition(4 * cores)
    return words_of(sequences, "id").select("word", "id", "place").filter(~F.contains("word", F.lit("X")))


def write_word_index(sequences: DataFrame, name: str, buckets: int = 64) -> DataFrame:
    """The index as a table bucketed and sorted by word, so that searches that join with it don't shuffle it again."""
    word_index(sequences).write.bucketBy(buckets, "word").sortBy("word").mode("overwrite").saveAsTable(name)
    return sequences.sparkSession.table(name)


def neighbours(words: DataFrame, least: int = WORD_SCORE, scores: dict = MATRIX) -> DataFrame:
    """(word, neighbour) of the distinct words in a column word and all words of the 22 residues that score enough against them.

    Letter by letter, with the most that the letters after it can add: there are under 24^3 distinct words."""
    out = words.select("word").distinct().withColumn("neighbour", F.lit("")).withColumn("total", F.lit(0))
    pairs = substitution(words.sparkSession, scores)
    for k in range(WORD):
        letter = F.col("word").substr(k + 1, 1)
        cells = F.broadcast(pairs.filter("b <> 'X'").select(F.col("a").alias("_a"), F.col("b").alias("_b"), "score"))
        out = out.join(cells, letter == F.col("_a")).select("word", F.concat("neighbour", "_b").alias("neighbour"), (F.col("total") + F.col("score")).alias("total"))
        rest = F.lit(0)
        for after in range(k + 1, WORD):
            highest = F.create_map(*[F.lit(x) for a in RESIDUES for x in (a, max(scores[a, b] for b in RESIDUES if b != "X"))])
            rest = rest + highest[F.col("word").substr(after + 1, 1)]
        out = out.filter(F.col("total") + rest >= least)
    return out.select("word", "neighbour")


def query_words(queries: DataFrame, least: int = WORD_SCORE) -> DataFrame:
    """(word, query_id, q) of everything that a word of a sequence to be searched may hit; q is the place in the query, from 0."""
    words = words_of(queries, "id").select(F.col("id").alias("query_id"), F.col("place").alias("q"), F.col("word").alias("own"))
    near = neighbours(words.select(F.col("own").alias("word")), least).withColumnRenamed("word", "own")
    return words.join(near, "own").select(F.col("neighbour").alias("word"), "query_id", "q")


def seeds(queries: DataFrame, index: DataFrame, letters: int | None = None, least: int = WORD_SCORE) -> DataFrame:
    """(query_id, target_id, q, t) of the hits of all queries' words in an index.

    letters: how many letters the queries have, if known; few are broadcast, so that the index is neither shuffled nor sorted. Beyond
    that both sides are shuffled by word; a word is dealt by its targets to SALTS keys, the few query words once for each, since
    some words are in most sequences.
    """
    hits = query_words(queries, least)
    targets = index.select("word", F.col("id").alias("target_id"), F.col("place").alias("t"))
    if letters is not None and letters * 40 <= BROADCAST_WORDS:
        joined = targets.join(F.broadcast(hits), "word")
    else:
        salted = targets.withColumn("_salt", F.pmod(F.xxhash64("target_id"), F.lit(SALTS)).cast("int"))
        joined = salted.join(hits.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["word", "_salt"])
    return joined.select("query_id", "target_id", "q", "t")


def second_hits(found: DataFrame, window: int = HIT_WINDOW) -> DataFrame:
    """Adds `second` to seeds: whether an earlier one is on its diagonal, not overlapping it and nearer than the window.

    Diagonals lie one after another on one axis, further apart than the window reaches, so that a window's partition is a pair and
    not a diagonal, of which there are as many as letters. Rows are dealt by pair, which serves what comes after as well."""
    axis = F.shiftleft((F.col("q") - F.col("t")).cast("long"), 32) + F.col("q")
    pair = Window.partitionBy("query_id", "target_id").orderBy(axis).rangeBetween(1 - window, -WORD - 1)
    return found.withColumn("second", F.count("*").over(pair) > 0)


def pair_seeds(found: DataFrame, window: int = HIT_WINDOW) -> DataFrame:
    """(query_id, target_id, diagonals, places, second) of the seeds of pairs that have a second hit, sorted by diagonal (q - t) and place in the
    query: a row a pair, with nine bytes a seed and lists at most as long as the two sequences allow."""
    seed = F.struct((F.col("q") - F.col("t")).alias("d"), "q", "second")
    rows = second_hits(found, window).groupBy("query_id", "target_id").agg(F.sort_array(F.collect_list(seed)).alias("s"), F.max("second").alias("_any")).filter("_any")
    return rows.select("query_id", "target_id", F.col("s.d").alias("diagonals"), F.col("s.q").alias("places"), F.col("s.second").alias("second"))


def _stable_order(keys: np.ndarray) -> np.ndarray:
    """The stable order of numbers from 0, by 16 bits at a time."""
    order = np.argsort(keys.astype(np.uint16), kind="stable")
    high, most = keys >> 16, int(keys.max(initial=0)) >> 16
    while most:
        order = order.take(np.argsort(high.take(order).astype(np.uint16), kind="stable"))
        high, most = high >> 16, most >> 16
    return order


class Words:
    """What the words of some queries hit: for each word of three residues the numbers of the queries and the places there."""

    def __init__(self, names: list, word: np.ndarray, query: np.ndarray, place: np.ndarray, width: int):
        order = np.argsort(word, kind="stable")
        self.names, self.width, self.query, self.place = names, width, query[order].astype(np.int32), place[order].astype(np.int32)
        self.begin = np.searchsorted(word[order], np.arange(len(RESIDUES) ** WORD + 2))

    def seeds(self, rows: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(row, query's number, diagonals, places, second) of the seeds of each pair, as from pair_seeds(), but of all pairs that have any."""
        upto = np.append(0, np.cumsum([len(r) for r in rows]))
        first = 0
        while first < len(rows):
            last = max(first + 1, int(np.searchsorted(upto, upto[first] + LETTERS, "right")) - 1)
            yield from self._found(first, rows[first:last])
            first = last

    def _found(self, number: int, rows: list[str]):
        """Those of some rows, the first of which has this number."""
        size = np.array([len(r) for r in rows])
        behind = np.cumsum(size)
        letter = NUMBER[np.frombuffer("".join(rows).encode("latin-1", "replace"), np.uint8)]
        code = np.full(len(letter), len(RESIDUES) ** WORD)
        word = np.zeros(max(0, len(letter) - WORD + 1), np.int64)
        for k in range(WORD):
            word = word * len(RESIDUES) + letter[k : k + len(word)]
        code[: len(word)] = word
        for k in range(1, WORD):  # no word goes on in the next row
            code[(behind - k)[size >= k]] = len(RESIDUES) ** WORD
        many = self.begin[code + 1] - self.begin[code]
        upto = np.append(0, np.cumsum(many))[np.append(0, behind)]
        lines = np.append(0, np.cumsum(size + self.width)) * len(self.names)  # diagonals
        first = 0
        while first < len(rows):
            last = max(first + 1, min(int(np.searchsorted(x, x[first] + most, "right")) - 1 for x, most in ((upto, SORTED), (lines, 1 << 16))))
            yield from self._sorted(number + first, size[first:last], slice(behind[first] - size[first], behind[last - 1]), code, many)
            first = last

    def _sorted(self, first: int, size: np.ndarray, some: slice, code: np.ndarray, many: np.ndarray):
        code, many = code[some], many[some]
        total = int(many.sum())
        if not total:
            return
        # Diagonals of all pairs are numbered through: of a row, those of each query one after another, from low to high. Seeds are made in
        # order of their places in the row, so that a stable order by diagonal leaves them in order of their places in the query.
        room = size + self.width
        base = (np.cumsum(room) - room) * len(self.names)
        at = np.arange(total, dtype=np.int32) + np.repeat((self.begin[code] - (np.cumsum(many) - many)).astype(np.int32), many)
        start = np.repeat(base + size + np.cumsum(size) - size, size) - np.arange(len(code))
        line = np.repeat(start.astype(np.int32), many)
        places = self.place.take(at)
        line += places
        if len(self.names) > 1:
            line += np.repeat(np.repeat(room.astype(np.int32), size), many) * self.query.take(at)
        order = _stable_order(line)
        line, places = line.take(order), places.take(order)
        axis = line * np.int64(self.width + HIT_WINDOW) + places
        second = np.zeros(total, bool)
        for k in range(1, WORD + 2):  # on a diagonal, no more than WORD lie too near before a seed
            gap = axis[k:] - axis[:-k]
            second[k:] |= (gap > WORD) & (gap < HIT_WINDOW)
        begin = (base[:, None] + room[:, None] * np.arange(len(self.names))).ravel()
        ends = np.append(np.searchsorted(line, begin), total).tolist()
        for pair, (a, b) in enumerate(zip(ends, ends[1:])):
            if a < b:
                row = pair // len(self.names)
                yield first + row, pair % len(self.names), line[a:b] - (begin[pair] + size[row]), places[a:b], second[a:b]


def words_by_query(queries: DataFrame, least: int = WORD_SCORE) -> list[Words]:
    """The words that the queries may hit, brought to the driver; for few queries."""
    found = query_words(queries, least).toArrow()
    names, number = np.unique(found.column("query_id").to_numpy(), return_inverse=True)
    place = found.column("q").to_numpy().astype(np.int64)
    letter = NUMBER[np.frombuffer("".join(found.column("word").to_pylist()).encode(), np.uint8)].reshape(-1, WORD)
    word = letter @ (len(RESIDUES) ** np.arange(WORD - 1, -1, -1))
    width = np.zeros(len(names), np.int64)
    np.maximum.at(width, number, place + 1)
    part = (np.cumsum(width) - width) // TOGETHER
    out = []
    for k in np.unique(part):
        own = np.flatnonzero(part == k)
        here = np.isin(number, own)
        out.append(Words(names[own].tolist(), word[here], number[here] - own[0], place[here], int(width[own].max())))
    return out


def seed_counts(queries: DataFrame, sequences: DataFrame, letters: int) -> DataFrame:
    """(query_id, target_id, seeds, second_hits, diagonals) of the pairs of queries and sequences (both id, seq) that have seeds; letters as for seeds().

    The seeds of few queries are found, sorted and counted where a sequence is, so that none is shuffled; only those of rows that share
    an id are brought together, as are all where there are many queries."""

    def counted(found: DataFrame) -> DataFrame:
        diagonal = F.when(F.col("second"), F.col("q") - F.col("t"))
        return found.groupBy("query_id", "target_id").agg(F.count("*").alias("seeds"), F.count_if("second").alias("second_hits"), F.count_distinct(diagonal).alias("diagonals"))

    def brought(some: DataFrame) -> DataFrame:
        return counted(second_hits(seeds(queries, word_index(some), letters)))

    if letters * 40 > BROADCAST_WORDS:
        return brought(sequences)
    tables = words_by_query(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column("id"), [s or "" for s in batch.column("seq").to_pylist()]
            for words in tables:
                out = [(k, words.names[query], len(d), int(second.sum()), int(np.count_nonzero(np.diff(d[second]))) + bool(second.any())) for k, query, d, _, second in words.seeds(rows)]
                if out:
                    row, *rest = zip(*out)
                    columns = [pa.array(rest[0], pa.int64()), ids.take(pa.array(row)), *(pa.array(x, pa.int64()) for x in rest[1:])]
                    yield pa.RecordBatch.from_arrays(columns, ["query_id", "target_id", "seeds", "second_hits", "diagonals"])

    repeated = sequences.groupBy("id").count().filter("count > 1").select(F.col("id").alias("_id"))
    types = f"query_id long, target_id {sequences.schema['id'].dataType.simpleString()}, seeds long, second_hits long, diagonals long"
    few = repeated.limit(BROADCAST_WORDS).count()
    if not few:
        return sequences.mapInArrow(run, types)
    repeated = F.broadcast(repeated) if few < BROADCAST_WORDS else repeated
    same = F.col("id").eqNullSafe(F.col("_id"))
    return sequences.join(repeated, same, "left_anti").mapInArrow(run, types).unionByName(brought(sequences.join(repeated, same, "left_semi")))
