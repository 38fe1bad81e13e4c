"""Language-model scores by online logistic context mixing.

A text is the sequence of its words (A-Z lower-cased) and an end. Words are counted over all
training texts. The SYMBOLS most frequent words and the end are symbols of their own; any other word is the symbol of
its class (drawn from its first and last bytes) and then chosen within the class: by its discounted
count if it was seen, otherwise it is spelt in bytes by a second model of the same kind.

Symbols are coded by a Huffman tree, so each is a few binary decisions. For each decision several
predictors, keyed by hashes of the tree's node with the symbols before it, hold counts of both
outcomes. Their log odds are combined by weights that are chosen by how much two of the predictors
have seen (the gate) and learnt online: each shard of the corpus predicts a batch, moves the
weights along the gradient, then adds the batch to its counts. The result is refined by an adaptive
table of how often decisions came true at each predicted odds. Counts of shards are summed, weights
averaged. A text's log probability over its bytes gives bits per byte.

Defined cases: a null or empty text is just an end; with no training text at all the base takes N
and V as 0 and all counts as 0; repeated rows and repeated ids are scored each; training rows are
told by doc_id (null as empty text); an empty table gives an empty table; only the named columns are read;
texts are scored whole. Words are joined to their counts by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldline.llm.common import crc_mod, pieces, stored, table, tidy

NAME = "op5_context_mixing_lm"
SYMBOLS, HOT, CLASSES, LONGEST = 2047, 1 << 17, 128, 64
BITS, ORDERS, GATES, STEPS = 20, 3, 16, 64
BLOCK = 1 << 15
FIRST, BATCH = 20_000, 80_000  # decisions learnt from at once, at first and at most
SLICE = 1 << 15  # of these worked on at once, for the processor's cache
PART = 40_000  # symbols of a text learnt from at once
SHARD = 2_000_000  # tokens that a shard has at least
DISCOUNT, SMOOTH = 0.6, 0.1
END = SYMBOLS + CLASSES


def huffman(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each symbol where its path begins and how long it is; nodes and bits of all paths."""
    heap = [(float(w), i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    up: dict[int, tuple[int, int]] = {}
    fresh = len(weights)
    while len(heap) > 1:
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        up[i], up[j] = (fresh, 0), (fresh, 1)
        heapq.heappush(heap, (a + b, fresh))
        fresh += 1
    begins, sizes, nodes, bits = [], [], [], []
    for s in range(len(weights)):
        path = []
        while s in up:
            s, bit = up[s]
            path.append((s - len(weights), bit))
        begins.append(len(nodes))
        sizes.append(len(path))
        nodes += [n for n, _ in reversed(path)]
        bits += [b for _, b in reversed(path)]
    return np.array(begins, np.int64), np.array(sizes, np.int64), np.array(nodes, np.uint32), np.array(bits, np.uint8)


class Decisions:
    """Turns symbol sequences into binary decisions with the slots of their predictors."""

    def __init__(self, weights: np.ndarray, first_order: int):
        self.begins, self.sizes, nodes, self.bits = huffman(weights)
        self.first_order = first_order
        self.nodes = nodes * np.uint32(0x9E3779B1)
        self.alone = slot_of(self.nodes).astype(np.intp)  # without any symbol before

    def of(self, symbols: np.ndarray, lengths: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """Bits, slots for each predictor and symbol index of each decision; lengths are those of the sequences.

        The first symbols of a sequence, as many as known says, are context alone."""
        place = np.arange(len(symbols)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        n = self.sizes.take(symbols)
        if known is not None and known.any():
            n = np.where(place < np.repeat(known, lengths), 0, n)
        ends = np.cumsum(n)
        at = np.arange(int(ends[-1]) if len(ends) else 0)
        at += np.repeat(self.begins.take(symbols) - ends + n, n)
        nodes = self.nodes.take(at)
        slots, context = [] if self.first_order else [self.alone.take(at)], np.zeros(len(symbols), np.uint32)
        for k in range(1, self.first_order + ORDERS):
            before = np.where(place >= k, np.roll(symbols, k) + 1, 0).astype(np.uint32)
            context = (context + before + np.uint32(k)) * np.uint32(0x85EBCA6B)
            context ^= context >> np.uint32(15)
            if k >= self.first_order:
                slots.append(slot_of(nodes ^ np.repeat(context, n)).astype(np.intp))
        return self.bits.take(at), slots, np.repeat(np.arange(len(symbols)), n)


def slot_of(h: np.ndarray) -> np.ndarray:
    h = h * np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x27D4EB2F)
    h >>= np.uint32(32 - BITS)
    return h


@dataclass
class Mixer:
    """Log odds and confidence of each predictor's slots, weights by gate, the refining table."""

    odds: list[np.ndarray]
    seen: list[np.ndarray]
    weights: np.ndarray
    refined: np.ndarray

    @staticmethod
    def view(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log odds and a confidence from 0 to 3 of slots with counts (outcome 0, outcome 1)."""
        total = counts[:, 0] + counts[:, 1]
        return Mixer.log_odds(counts), (total > 0).view(np.uint8) + (total > 3) + (total > 30)

    @staticmethod
    def log_odds(counts: np.ndarray) -> np.ndarray:
        odds = counts[:, 1] + np.float32(0.2)
        odds /= counts[:, 0] + np.float32(0.2)
        return np.log(odds, out=odds)

    def bits_cost(self, bits: np.ndarray, slots: list[np.ndarray]) -> np.ndarray:
        """Natural log of the probability of each decision's outcome."""
        gate = (self.seen[-2].take(slots[-2]) * np.uint8(4) + self.seen[-1].take(slots[-1])).astype(np.intp)
        z = mixed_odds(self.weights, gate, [o.take(s) for o, s in zip(self.odds, slots)])
        p = (chance(z) + self.refined.take(step(z))) * np.float32(0.5)
        p -= 1 - bits
        return np.log(np.abs(p, out=p), out=p)


def mixed_odds(weights: np.ndarray, gate: np.ndarray, x: list[np.ndarray]) -> np.ndarray:
    """The predictors' log odds combined by the weights of each decision's gate."""
    z = weights[:, 0].take(gate)
    z *= x[0]
    for k, a in enumerate(x[1:], 1):
        w = weights[:, k].take(gate)
        w *= a
        z += w
    return np.clip(z, -12, 12, out=z)


def chance(z: np.ndarray) -> np.ndarray:
    """Of outcome 1 at these log odds."""
    p = np.exp(-z)
    p += 1
    return np.reciprocal(p, out=p)


def step(z: np.ndarray) -> np.ndarray:
    return np.minimum(((z + 12) * np.float32(STEPS / 24)).astype(np.uint8), STEPS - 1)


def learn(batches: Iterator[tuple[np.ndarray, ...]], decisions: Decisions) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """A shard's counts (predictor, slot, outcome), weights, refining counts and number of decisions."""
    counts = np.zeros((ORDERS, 1 << BITS, 2), np.int32)
    weights, hits, total, rate = np.full((GATES, ORDERS), 0.4), np.zeros((STEPS, 2)), 0, 0.5
    for batch in batches:
        bits, slots, _ = decisions.of(*batch)
        if not len(bits):
            continue
        n, power, pull = np.zeros(GATES), np.ones(GATES), np.zeros((ORDERS, GATES))
        for at in range(0, len(bits), SLICE):
            part = slice(at, at + SLICE)
            found = [c.view(np.int64).ravel().take(s[part]).view(np.int32).reshape(-1, 2).astype(np.float32) for c, s in zip(counts, slots)]
            view = [Mixer.view(c) for c in found[-2:]]
            x = [*map(Mixer.log_odds, found[:-2]), *(v[0] for v in view)]
            gate = (view[0][1] * np.uint8(4) + view[1][1]).astype(np.intp)
            z = mixed_odds(weights.astype(np.float32), gate, x)
            error = bits[part] - chance(z)
            n += np.bincount(gate, minlength=GATES)
            power += np.bincount(gate, sum(a * a for a in x[1:]) + x[0] * x[0], GATES)
            pull += [np.bincount(gate, error * a, GATES) for a in x]
            hits += np.bincount(step(z) * np.uint8(2) + bits[part], minlength=2 * STEPS).reshape(STEPS, 2)
        for k in range(ORDERS):
            weights[:, k] += rate * pull[k] / power * 4 * (n > 0)
        rate = max(0.05, rate * 0.97)
        for c, s in zip(counts, slots):
            np.add.at(c.reshape(-1), (s << 1) | bits, np.int32(1))
        total += len(bits)
    return counts, weights, hits, total


def emitted(shard: tuple[np.ndarray, np.ndarray, np.ndarray, int]) -> Iterator[pa.RecordBatch]:
    """Rows (block, values): the counts in blocks, and at -1 the weights times their decisions, the refining counts and the decisions."""
    counts, weights, hits, total = shard
    if total:
        for k, part in enumerate(counts.reshape(-1, BLOCK)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.astype("<i4").tobytes()], pa.binary())], ["block", "values"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([np.concatenate([(weights * total).ravel(), hits.ravel(), [total]]).astype("<f8").tobytes()], pa.binary())], ["block", "values"])


def merged(shards: DataFrame) -> Mixer:
    """The sum over shards. A partition adds up its blocks as they come; the model's size is fixed."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(v, "<f8" if k < 0 else "<i4").astype(np.float64)
                sums[k] = sums[k] + part if k in sums else part
        for k, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([v.astype("<f8" if k < 0 else "<f4").tobytes()], pa.binary())], ["block", "values"])

    counts, rest = np.zeros((ORDERS * (2 << BITS) // BLOCK, BLOCK), np.float32), np.zeros(GATES * ORDERS + 2 * STEPS + 1)
    for row in shards.repartition("block").mapInArrow(add, "block int, values binary").toLocalIterator():
        if row["block"] < 0:
            rest = np.frombuffer(row["values"], "<f8")
        else:
            counts[row["block"]] = np.frombuffer(row["values"], "<f4")
    views = [Mixer.view(c) for c in counts.reshape(ORDERS, 1 << BITS, 2)]
    total = rest[-1]
    weights = rest[: GATES * ORDERS].reshape(GATES, ORDERS) / total if total else np.full((GATES, ORDERS), 0.4)
    hits = rest[GATES * ORDERS : -1].reshape(STEPS, 2)
    middle = 1 / (1 + np.exp(-((np.arange(STEPS) + 0.5) * 24 / STEPS - 12)))
    return Mixer([v[0] for v in views], [v[1] for v in views], weights.astype(np.float32), ((hits[:, 1] + 8 * middle) / (hits.sum(1) + 8)).astype(np.float32))


SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
#: crc32 of four bytes is the xor of what each of them gives at its place.
AFFIX = np.array([[zlib.crc32(bytes(k) + bytes([x]) + bytes(3 - k)) ^ (zlib.crc32(bytes(4)) if k else 0) for x in range(256)] for k in range(4)], np.uint32)
SINGLE = np.array([zlib.crc32(bytes([x, x])) for x in range(256)], np.uint32)


def words_in(texts: pa.Array) -> tuple[pa.BinaryArray, np.ndarray]:
    """The words of all texts in one array, and how many each text has."""
    raw = [t or b"" for t in texts.cast(pa.binary()).to_pylist()]
    data = np.frombuffer(b" ".join([b"", *raw, b""]).lower(), np.uint8)
    inside = ~SPACE.take(data)
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    counts = np.diff(np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in raw)])))
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]), counts


def parts_of(batch: pa.RecordBatch, column: int, size: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about so many bytes of text, or one longer text."""
    at = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // size
    edges = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(batch)]
    for a, b in zip(edges, edges[1:]):
        if a < b:
            yield batch.slice(a, b - a)


def letters_of(words: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The words' bytes, and where each word begins and the last one ends."""
    _, offsets, data = words.buffers()
    return np.frombuffer(data or b"", np.uint8), np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int32)


def classes_of(words: pa.BinaryArray) -> np.ndarray:
    """crc32 of the words' first two and last two bytes, modulo CLASSES; no word is empty."""
    letters, offsets = letters_of(words)
    first, last = offsets[:-1], offsets[1:] - 1
    more = (last > first).astype(np.int32)
    a = letters.take(first)
    h = AFFIX[0].take(a) ^ AFFIX[1].take(letters.take(first + more)) ^ AFFIX[2].take(letters.take(last - more)) ^ AFFIX[3].take(letters.take(last))
    return (np.where(more, h, SINGLE.take(a)) % CLASSES).astype(np.int64)


def key_of(word: bytes) -> bytes:
    """The word, or a digest in place of a long one."""
    return word if len(word) <= LONGEST else hashlib.md5(word).digest()


class Lexicon:
    """The frequent words (key, count, class): their counts, and the symbol of any word."""

    def __init__(self, hot: list[tuple[bytes, int, int]], n: int, v: int, ends: int, class_counts: dict[int, tuple[int, int]]):
        self.index = {w: k for k, (w, _, _) in enumerate(hot)}
        self.keys = pa.array([w for w, _, _ in hot], pa.binary())
        self.counts = np.array([c for _, c, _ in hot], np.int64)
        self.classes = np.array([k for _, _, k in hot], np.int64)
        self.n, self.v, self.ends = n, v, ends
        self.class_n, self.class_v = (np.array([class_counts.get(k, (0, 0))[j] for k in range(CLASSES)], np.float64) for j in (0, 1))
        weights = np.ones(END + 1)
        weights[: min(len(hot), SYMBOLS)] += self.counts[:SYMBOLS]
        weights[SYMBOLS : SYMBOLS + CLASSES] += self.class_n
        weights[END] += ends
        self.weights = weights

    def codes(self, words: pa.BinaryArray | list[bytes], most: int = HOT) -> np.ndarray:
        """Each word's place among the first `most` of the frequent ones plus one (0: none) above 16 bits of its symbol."""
        words = words if isinstance(words, pa.Array) else pa.array(words, pa.binary())
        place = pc.fill_null(pc.index_in(words, self.keys[:most]), -1).to_numpy().astype(np.int64)
        for i in np.flatnonzero(np.diff(letters_of(words)[1]) > LONGEST).tolist():
            k = self.index.get(key_of(words[i].as_py()), -1)
            place[i] = k if k < most else -1
        symbol = np.where(place < SYMBOLS, place, -1)
        other = np.flatnonzero(symbol < 0)
        symbol[other] = SYMBOLS + classes_of(words.take(pa.array(other)))
        return (place + 1) << 16 | symbol


def symbol_batches(batches: Iterator[pa.RecordBatch], lexicon: Lexicon, column: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Symbols, lengths and how many symbols are context alone: very long texts come in parts that begin with the last ORDERS before."""
    parts: list[np.ndarray] = []
    known: list[int] = []
    size, most = 0, FIRST // 8
    for batch in batches:
        for part in parts_of(batch, column):
            words, counts = words_in(part.column(column))
            flat = np.insert(lexicon.codes(words, SYMBOLS) & 0xFFFF, np.cumsum(counts), END)
            for codes in np.split(flat, np.cumsum(counts + 1)[:-1]):
                for at in range(0, len(codes), PART):
                    known.append(min(at, ORDERS))
                    parts.append(codes[at - known[-1] : at + PART])
                    size += len(parts[-1])
                    if size >= most:
                        yield np.concatenate(parts), np.array([len(p) for p in parts]), np.array(known)
                        parts, known, size, most = [], [], 0, min(most * 5 // 4, BATCH // 8)
    if parts:
        yield np.concatenate(parts), np.array([len(p) for p in parts]), np.array(known)


BYTE_END = 256


def spelling_batches(words: Iterator[pa.BinaryArray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes with an end behind each word, and the words' lengths with it."""
    symbols, lengths, most = np.zeros(0, np.int64), np.zeros(0, np.int64), FIRST // 8
    for part in words:
        letters, offsets = letters_of(part)
        symbols = np.append(symbols, np.insert(letters[offsets[0] : offsets[-1]].astype(np.int64), offsets[1:] - offsets[0], BYTE_END))
        lengths = np.append(lengths, np.diff(offsets) + 1)
        ends = np.cumsum(lengths)
        first = begin = 0
        while (last := int(np.searchsorted(ends, begin + most))) < len(ends):
            end = int(ends[last])
            yield symbols[begin:end], lengths[first : last + 1]
            first, begin, most = last + 1, end, min(most * 5 // 4, BATCH // 8)
        symbols, lengths = symbols[begin:], lengths[first:]
    if len(lengths):
        yield symbols, lengths


@dataclass
class Model:
    lexicon: Lexicon
    words: Mixer
    bytes: Mixer
    byte_weights: np.ndarray
    counts: DataFrame


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over all texts; partial counts leave a task whenever they have grown large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.Array] = []
        counts = none = pa.table({"word": pa.array([], pa.binary()), "c": pa.array([], pa.int64())})

        def added() -> pa.Table:
            word, c = pc.value_counts(pa.chunked_array(waiting, pa.binary())).flatten()
            waiting.clear()
            both = pa.concat_tables([counts, pa.table({"word": word, "c": c})])
            return both.group_by("word", use_threads=False).aggregate([("c", "sum")]).rename_columns(["word", "c"])

        for batch in batches:
            for part in parts_of(batch, 0):
                waiting.append(words_in(part.column(0))[0])
                if sum(map(len, waiting)) > 1_000_000:
                    counts = added()
                    if len(counts) > 500_000:
                        yield from counts.to_batches(50_000)
                        counts = none
        counts = added()
        yield from counts.to_batches(50_000)
        counts = none
        tidy()

    return texts.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def fit(training: DataFrame) -> Model:
    """Learns from every row of training (text)."""
    spark = training.sparkSession
    counts = stored(word_counts(training).withColumn("h", F.xxhash64("word")))
    sums = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    ends = training.count()
    n_bytes = F.length("word")
    affix = F.concat(F.expr("substring(word, 1, 2)"), F.when(n_bytes >= 2, F.expr("substring(word, -2, 2)")).otherwise(F.col("word")))
    # At most HOT words come to the driver, long ones as digests.
    keyed = counts.select(F.when(n_bytes <= LONGEST, F.col("word")).otherwise(F.unhex(F.md5("word"))).alias("key"), "c", (F.crc32(affix) % CLASSES).alias("k"))
    top = keyed.orderBy(F.desc("c"), "key").limit(HOT).toArrow()
    hot = list(zip(*(top.column(n).to_pylist() for n in ("key", "c", "k")), strict=True))
    own = spark.createDataFrame([(w,) for w, _, _ in hot[:SYMBOLS]], "key binary")
    rare = keyed.join(F.broadcast(own), "key", "left_anti")
    classes = {r["k"]: (r["n"], r["v"]) for r in rare.groupBy("k").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    lexicon = Lexicon(hot, (sums["n"] or 0) + ends, sums["v"] + (ends > 0), ends, classes)
    shared = spark.sparkContext.broadcast(lexicon)

    def learn_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        yield from emitted(learn(symbol_batches(batches, lex, 0), Decisions(lex.weights, 0)))
        tidy()

    def byte_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BYTE_END + 1, np.int64)
        for batch in batches:
            raw = batch.column(0).to_pylist()
            total += np.bincount(np.frombuffer(b"".join(raw), np.uint8), minlength=BYTE_END + 1)
            total[BYTE_END] += len(raw)
        yield pa.RecordBatch.from_arrays([pa.array(range(BYTE_END + 1), pa.int32()), pa.array(total)], ["byte", "n"])

    # Shards are the input's splits, joined where they are small; the first of a shard's predictions know little.
    shards = max(1, lexicon.n // SHARD)
    words = merged(training.select("text").coalesce(shards).mapInArrow(learn_words, "block int, values binary"))
    # Spelling is learnt from the words seen least, which are most like those never seen.
    few = counts.filter("c <= 2").select("word")
    weights = np.ones(BYTE_END + 1)
    for r in few.mapInArrow(byte_counts, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect():
        weights[r["byte"]] += r["n"]

    def learn_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from emitted(learn(spelling_batches(b.column(0) for b in batches), Decisions(weights, 1)))
        tidy()

    return Model(lexicon, words, merged(few.coalesce(shards).mapInArrow(learn_bytes, "block int, values binary")), weights, counts)


def score(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, n_known, train_tokens, base_score, score, spelt_score, bits_per_byte) of each row.

    base_score and score have the same events: the words seen in training, and one for all others.
    spelt_score also has the bytes of those others, and bits_per_byte follows from it."""
    spark = documents.sparkSession
    lex = model.lexicon
    shared = spark.sparkContext.broadcast((lex, model.words))
    floor = math.log10(lex.n + SMOOTH * (lex.v + 1)) if lex.n + lex.v else math.log10(SMOOTH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, mixer = shared.value
        made = Decisions(lexicon.weights, 0)
        base = np.append(np.log10(lexicon.counts + SMOOTH), 0.0)  # the last one is for words that aren't frequent
        inside = np.zeros(len(lexicon.counts) + 1)  # log10 of a frequent word's share of its class
        other = np.arange(len(lexicon.counts)) >= SYMBOLS
        inside[:-1][other] = np.log10((lexicon.counts[other] - DISCOUNT) / lexicon.class_n[lexicon.classes[other]])
        for batch in batches:
            for part in parts_of(batch, 1):
                words, counts = words_in(part.column(1))
                lengths = counts + 1
                codes = lexicon.codes(words)
                flat = np.insert(codes, np.cumsum(counts), END)
                place, end = (flat >> 16) - 1, np.cumsum(lengths) - 1
                row = np.repeat(np.arange(len(part)), lengths)
                logp = np.zeros(len(part))
                edges = [0]
                for k in range(len(part)):  # about SLICE decisions at a time, whole texts
                    if k == len(part) - 1 or end[k + 1] + 1 - edges[-1] > SLICE // 8:
                        edges.append(int(end[k]) + 1)
                for a, b in zip(edges, edges[1:]):
                    first, last = row[a], row[b - 1]
                    bits, slots, of = made.of(flat[a:b] & 0xFFFF, lengths[first : last + 1])
                    logp += np.bincount(row[a:b][of], mixer.bits_cost(bits, slots), len(part))
                known = place >= 0
                b0 = np.bincount(row, base[place], len(part)) + math.log10(lexicon.ends + SMOOTH)
                s0 = logp / math.log(10) + np.bincount(row, inside[place], len(part))
                # Of the other words each text has one row: by text, then by word.
                other = np.flatnonzero(codes < 1 << 16)
                coded = pc.dictionary_encode(words.take(pa.array(other)))
                names = coded.dictionary
                texts, c = np.unique(np.repeat(np.arange(len(part)), counts)[other] * max(1, len(names)) + coded.indices.to_numpy(), return_counts=True)
                texts, name = np.divmod(texts, max(1, len(names)))
                held = part.column(2).to_numpy(zero_copy_only=False).astype(bool)[texts]
                values = [
                    pa.array(np.array([xxhash.xxh64_intdigest(w, 42) for w in names.to_pylist()], np.uint64).view(np.int64)[name]),
                    pa.array(c.astype(np.int32)),
                    pa.array(classes_of(names)[name].astype(np.int32)),
                    names.take(pa.array(np.where(held, name, 0), mask=~held)),
                ]
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(texts, np.arange(len(part) + 1)).astype(np.int32)), pa.StructArray.from_arrays(values, ["h", "m", "k", "word"]))
                found = np.bincount(row, known, len(part)).astype(np.int64) + (lexicon.ends > 0)
                n_bytes = np.diff(letters_of(words)[1][np.cumsum([0, *counts])]).astype(np.int64) + np.maximum(counts, 1)  # spaces, and an end
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lengths), pa.array(found), pa.array(b0), pa.array(s0), pa.array(n_bytes), lists], NAMES)
        tidy()

    NAMES = [id_col, "n_tokens", "known", "base", "part", "n_bytes", "rare"]
    kind = documents.schema[id_col].dataType.simpleString()
    rows = documents.select(id_col, text_col, (crc_mod(id_col, 10) == 0).alias("held"))
    rows = rows.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, known long, base double, part double, n_bytes long, rare array<struct<h:long,m:int,k:int,word:binary>>")
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()))

    # The other words get their counts by a join; no word in it is frequent.
    asked = rows.select("row", F.explode("rare").alias("r")).select("row", "r.*")
    joined = asked.join(model.counts.select("h", "c"), "h", "left")
    classes = spark.createDataFrame([(k, float(n), float(v)) for k, (n, v) in enumerate(zip(lex.class_n, lex.class_v))], "k int, class_n double, class_v double")
    joined = joined.join(F.broadcast(classes), "k")
    share = F.when(F.col("c").isNotNull(), F.log10((F.col("c") - DISCOUNT) / F.col("class_n")))
    seen = joined.filter("c is not null").groupBy("row").agg(F.sum("m").alias("found"), F.sum(F.col("m") * F.log10(F.col("c") + SMOOTH)).alias("b"), F.sum(F.col("m") * share).alias("s"))
    spelling = spark.sparkContext.broadcast((model.bytes, model.byte_weights))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, weights = spelling.value
        made = Decisions(weights, 1)
        for batch in batches:
            for part in pieces(batch, 2000):
                logs: list[float] = []
                for symbols, lengths in spelling_batches(iter([pc.fill_null(part.column(2), b"")])):
                    bits, slots, of = made.of(symbols, lengths)
                    word = np.repeat(np.arange(len(lengths)), lengths)
                    logs += np.bincount(word[of], mixer.bits_cost(bits, slots), len(lengths)).tolist()
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.array(logs) / math.log(10)), part.column(3), part.column(4)], ["row", "m", "spelt", "class_n", "class_v"])

    new = joined.filter("c is null").select("row", "m", "word", "class_n", "class_v").mapInArrow(spell, "row long, m int, spelt double, class_n double, class_v double")
    # What discounting has left of the class; all of it if the class is new.
    left = F.when(F.col("class_n") > 0, F.log10(DISCOUNT * F.col("class_v") / F.col("class_n"))).otherwise(0.0)
    unseen = new.groupBy("row").agg(F.sum("m").alias("n_new"), F.sum(F.col("m") * left).alias("s_new"), F.sum(F.col("m") * F.col("spelt")).alias("spelt"))
    all_rows = rows.drop("rare").join(seen, "row", "left").join(unseen, "row", "left").na.fill(0, ["found", "b", "s", "n_new", "s_new", "spelt"])
    base_score = F.col("base") + F.col("b") + F.col("n_new") * math.log10(SMOOTH) - F.col("n_tokens") * floor
    total = F.col("part") + F.col("s") + F.col("s_new")
    return all_rows.select(id_col, "n_tokens", (F.col("known") + F.col("found")).alias("n_known"), F.lit(lex.n).cast("long").alias("train_tokens"), base_score.alias("base_score"), total.alias("score"), (total + F.col("spelt")).alias("spelt_score"), (-(total + F.col("spelt")) * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    scored = score(documents, fit(documents.filter(crc_mod("doc_id", 10) != 0).select("text")))
    return scored.select("doc_id", (crc_mod("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "spelt_score", "bits_per_byte")
