"""Phrase collocations: counts by suffix automata of shards, scores by the weakest cut, longer phrases before their parts.

A task reads its texts in shards of a bounded number of words and builds for each the generalised suffix automaton of its pieces, cut
at a depth. Suffix links form the tree of what precedes the ends: a node's parent is its phrase without the first word. That tree
is made from the ends alone, a depth at a time, by numbering pairs (node of the depth before, preceding word); nodes with the same count as
a child have the same ends and are one state with it. A state stands for the phrases of the lengths from `shortest` to `longest`
that end at `end`, all with its count of ends, and its link goes to the state of the next shorter phrase.

Counts are added up over shards by Spark. A phrase can't be frequent unless what its suffix link leads to is, and its
mirror image, the phrase without the last word; so from three words on only phrases are sent for which both may be
frequent, by a bitmap of the frequent ones of the length before. The bitmap has a bounded size: where it is full, more
rows are sent, with the same result. By the same two links a longer phrase tells which shorter ones it may subsume; it suffices to
look one word further, since what lies between two candidates is a candidate and at least as frequent as the longer.

Defined cases: null and empty texts have no phrases; a null language is `und`; repeated rows count each; ties go to the
smaller phrase by bytes; an empty table gives an empty table; extra columns aren't read; a text is read whole, of any length,
its words dealt to several automata with the words before them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from foldline.llm.common import pieces, stored, table

NAME = "op12_phrase_collocations"
SHARD_BYTES, SHARD_WORDS, WORD_BITS = 2 << 20, 1 << 18, 21
MAP_BITS = 27
SALTS = 64


class SuffixAutomaton:
    """The states of pieces of words (numbers from 1, below 2^21), cut at a depth; arrays with an entry for each state."""

    def __init__(self, words: np.ndarray, pieces: np.ndarray, depth: int, skip: int = 0):
        """pieces: the number of each word's piece. Ends among the first skip words aren't counted; they are what precedes others."""
        ends, node = np.arange(skip, len(words)), None
        count, parent, end, level, base = [], [], [], [], 0
        for d in range(1, depth + 1):
            if d > 1:
                ok = (ends >= d - 1) & (pieces[np.maximum(ends - d + 1, 0)] == pieces[ends])
                ends, node = ends[ok], node[ok]
            if not len(ends):
                break
            pair = words[ends - d + 1].astype(np.int64) if d == 1 else ((node - (base - size)) << WORD_BITS) | words[ends - d + 1]
            _, first, number, n = np.unique(pair, return_index=True, return_inverse=True, return_counts=True)
            parent.append(np.full(len(n), -1) if d == 1 else node[first])
            count.append(n)
            end.append(ends[first])
            level.append(np.full(len(n), d))
            size = len(n)
            node, base = number + base, base + size
        self.count, self.parent, self.end, self.level = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (count, parent, end, level))
        # A node with a child of the same count is one state with it.
        has = np.flatnonzero(self.parent >= 0)
        heirs = has[self.count[has] == self.count[self.parent[has]]]
        same = np.zeros(len(self.count), bool)  # whether a node belongs to its child's state
        same[self.parent[heirs]] = True
        top = np.arange(len(self.count))
        for d in range(2, depth + 1):
            deeper = heirs[self.level[heirs] == d]
            top[deeper] = top[self.parent[deeper]]
        states = np.flatnonzero(~same)
        self.longest, self.shortest = self.level[states], self.level[top[states]]
        state_of = np.full(len(self.count), -1)
        state_of[states] = np.arange(len(states))
        for d in range(depth, 1, -1):
            deeper = heirs[self.level[heirs] == d]
            state_of[self.parent[deeper]] = state_of[deeper]
        above = self.parent[top[states]]
        self.link = np.where(above >= 0, state_of[above], -1)
        self.count, self.end = self.count[states], self.end[states]

    def phrases(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The ends and counts of all phrases of so many words."""
        some = (self.shortest <= length) & (length <= self.longest)
        return self.end[some], self.count[some]


def _hashes(words: list[str], lang: str) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang)
    return np.array([xxhash.xxh64_intdigest(w, seed) for w in words], np.uint64)


def _places(hashes: np.ndarray, ends: np.ndarray, length: int, bits: int) -> np.ndarray:
    """Where phrases stand in a bitmap, by the hashes of the words up to their ends."""
    h = np.zeros(len(ends), np.uint64)
    for k in range(length - 1, -1, -1):
        h = (h ^ hashes[ends - k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - bits)).astype(np.int64)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of texts and the numbers of their pieces."""
    parts = pc.split_pattern_regex(pc.ascii_lower(texts), pattern="[.,;:!?\\x0A-\\x0D]").flatten()
    lists = pc.split_pattern(pc.replace_substring(parts, pattern="\t", replacement=" "), pattern=" ")
    words, piece = lists.flatten(), pc.list_parent_indices(lists)
    there = pc.not_equal(words, "")
    return words.filter(there), piece.filter(there).to_numpy(zero_copy_only=False)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array]]:
    """(language, texts) of about SHARD_BYTES; a longer text is a shard by itself."""
    held: dict[str, list[pa.Array]] = {}
    size: dict[str, int] = {}
    for batch in (part for whole in batches for part in pieces(whole)):
        langs = pc.fill_null(batch.column(0), "und")
        for lang in pc.unique(langs).to_pylist():
            texts = batch.column(1).filter(pc.equal(langs, lang)).drop_null().cast(pa.large_string())
            lengths = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
            at = 0
            while at < len(texts):
                room = SHARD_BYTES - size.get(lang, 0) + (int(lengths[at - 1]) if at else 0)
                to = max(int(np.searchsorted(lengths, room, side="right")), at + 1)
                held.setdefault(lang, []).append(texts.slice(at, to - at))
                size[lang] = size.get(lang, 0) + int(lengths[to - 1]) - (int(lengths[at - 1]) if at else 0)
                at = to
                if size[lang] >= SHARD_BYTES or at < len(texts):
                    size.pop(lang)
                    yield lang, pa.concat_arrays(held.pop(lang))
        if sum(size.values()) > 4 * SHARD_BYTES:  # many languages
            for lang in list(held):
                size.pop(lang)
                yield lang, pa.concat_arrays(held.pop(lang))
    for lang, texts in held.items():
        yield lang, pa.concat_arrays(texts)


def _counted(docs: DataFrame, lengths: tuple[int, ...], frequent=None, bits: int = 0) -> DataFrame:
    """(lang, phrase, n) of the phrases of these lengths; the phrase "" has the number of all words.

    frequent: a broadcast bitmap of the phrases a word shorter; only phrases with both parts in it are counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        depth = max(lengths)
        for lang, texts in _shards(batches):
            pa.default_memory_pool().release_unused()
            words, piece = words_of(texts)
            if not len(words):
                continue
            if 1 in lengths:
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([""]), pa.array([len(words)])], ["lang", "phrase", "n"])
            for at in range(0, len(words), SHARD_WORDS):
                low = max(at - depth + 1, 0)
                coded = words.slice(low, min(at + SHARD_WORDS, len(words)) - low).dictionary_encode()
                numbers, own = coded.indices.to_numpy().astype(np.int64) + 1, piece[low : low + len(coded)]
                automaton = SuffixAutomaton(numbers, own, depth, at - low)
                for length in lengths:
                    ends, n = automaton.phrases(length)
                    if frequent is not None:
                        hashes = _hashes(coded.dictionary.to_pylist(), lang)[numbers - 1]
                        places = [_places(hashes, part, length - 1, bits) for part in (ends, ends - 1)]
                        keep = np.logical_and(*[(frequent.value[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1 for p in places])
                        ends, n = ends[keep], n[keep]
                    for k in range(0, len(ends), 100_000):
                        some = ends[k : k + 100_000]
                        parts = [coded.dictionary.take(pa.array(numbers[some - b] - 1)) for b in range(length - 1, -1, -1)]
                        text = pc.binary_join_element_wise(*parts, pa.scalar(" ", parts[0].type)) if length > 1 else parts[0]
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), text.cast(pa.string()), pa.array(n[k : k + 100_000])], ["lang", "phrase", "n"])

    rows = docs.mapInArrow(run, "lang string, phrase string, n long")
    return rows.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _bitmap(frequent: DataFrame, length: int, bits: int) -> np.ndarray:
    """The places of phrases of so many words as 2^bits bits; made of blocks of 4 KB, at most 2^MAP_BITS bits in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang in pc.unique(batch.column(0)).to_pylist():
                words = pc.split_pattern(batch.column(1).filter(pc.equal(batch.column(0), lang)), pattern=" ").flatten().dictionary_encode()
                hashes = _hashes(words.dictionary.to_pylist(), lang)[words.indices.to_numpy()]
                yield pa.RecordBatch.from_arrays([pa.array(_places(hashes, np.arange(length - 1, len(hashes), length), length, bits))], ["place"])

    blocks = frequent.select("lang", "phrase").mapInArrow(run, "place long").groupBy(F.expr("place div 32768").alias("block")).agg(F.bitmap_construct_agg(F.col("place") % 32768).alias("bits"))
    out = np.zeros((max(1, 2**bits >> 15), 4096), np.uint8)
    for block, value in blocks.toLocalIterator():
        out[block] = np.frombuffer(value, np.uint8)
    return out.reshape(-1)


def counts(docs: DataFrame, text: str, lang: str, least: int = 10, most_words: int = 3) -> DataFrame:
    """(lang, phrase, words, n) of all phrases of up to most_words words that occur at least so often, and of all words together (phrase "")."""
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    first = _counted(rows, (1, 2)[:most_words]).filter((F.col("n") >= least) | (F.col("phrase") == ""))
    levels = [stored(first.withColumn("words", F.when(F.col("phrase") == "", 0).otherwise(1 + F.regexp_count("phrase", F.lit(" ")))))]
    for length in range(3, most_words + 1):
        below = levels[-1].filter(F.col("words") == length - 1)
        bits = min(MAP_BITS, max(15, (16 * below.count()).bit_length()))
        shared = docs.sparkSession.sparkContext.broadcast(_bitmap(below, length - 1, bits))
        level = _counted(rows, (length,), shared, bits).filter(F.col("n") >= least)
        levels.append(stored(level.withColumn("words", F.lit(length))))
        shared.destroy()
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def _long(c: Column) -> Column:
    return c.cast("decimal(15,0)")


def scored(known: DataFrame, swallow: int = 50) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the candidates among counts: phrases of two words and more, without those that occur in a
    longer one with at least `swallow` per cent of their number. Products have up to 38 digits, exactly."""
    cands = known.filter("words >= 2").select("lang", "phrase", "words", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    at = F.explode(F.sequence(F.lit(1), F.col("words") - 1))
    cuts = cands.select("*", at.alias("k")).select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice("w", F.col("k") + 1, F.col("words")), " ").alias("right"))
    left, right = (known.select("lang", F.col("phrase").alias(side), F.col("n").alias(name)) for side, name in (("left", "l"), ("right", "r")))
    score = F.expr("(a_ * a_ * 1000000) div (l_ * r_)")
    each = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).withColumns({"a_": _long(F.col("a")), "l_": _long(F.col("l")), "r_": _long(F.col("r"))}).withColumn("score", score)
    weakest = each.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a")).alias("cut"))
    # What a longer candidate's links lead to: the phrase without its first word, and without its last.
    links = F.explode(F.array(F.slice("w", F.lit(2), F.col("words") - 1), F.slice("w", F.lit(1), F.col("words") - 1)))
    longer = cands.filter("words > 2").select("lang", "a", links.alias("w")).groupBy("lang", F.array_join("w", " ").alias("phrase")).agg(F.max("a").alias("over"))
    kept = weakest.join(longer, ["lang", "phrase"], "left").filter(F.col("over").isNull() | (100 * F.col("over") < swallow * F.col("cut.a")))
    # One row for each language.
    words = F.broadcast(known.filter("words = 0").select("lang", F.col("n").alias("all")))
    return kept.join(words, "lang").select("lang", "phrase", "cut.a", "cut.l", "cut.r", F.col("all").alias("n"), "cut.score")


def best(rows: DataFrame, most: int) -> DataFrame:
    """The first rows of each language, with rank; drawn in parts of a language first, so that no task reads all of one."""
    order = [F.desc("score"), F.desc("a"), "phrase"]
    part = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    parts = rows.withColumn("_part", part).withColumn("_nr", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).filter(F.col("_nr") <= most)
    return parts.drop("_part", "_nr").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= most)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = counts(table(spark, sf_dir, "documents"), "text", "lang")
    top = best(scored(known), 2000)
    return top.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, regexp_extract_all(unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')), '[^ 	]+') as w from documents),
ends as (select lang, w, unnest(range(1, len(w) + 1)) as i from pieces),
phrases as (select lang, array_to_string(w[i:i + k - 1], ' ') as phrase, k, count(*) as n from ends, (values (1), (2), (3)) v(k) where i + k - 1 <= len(w) group by all),
totals as (select lang, sum(n)::bigint as n from phrases where k = 1 group by lang),
cands as (select lang, phrase, k, n as a, string_split(phrase, ' ') as w from phrases where k >= 2 and n >= 10),
cuts as (
  select c.lang, c.phrase, c.a, j, l.n as l, r.n as r, ((c.a::hugeint * c.a * 1000000) // (l.n::hugeint * r.n))::bigint as score
  from (select *, unnest(range(1, k)) as j from cands) c
  join phrases l on l.lang = c.lang and l.phrase = array_to_string(c.w[1:j], ' ') join phrases r on r.lang = c.lang and r.phrase = array_to_string(c.w[j + 1:], ' ')),
weakest as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, j) = 1),
longer as (select lang, phrase, max(a) as over from (select lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:], ' ')]) as phrase from cands where k = 3) group by lang, phrase),
kept as (select w.* from weakest w left join longer o on o.lang = w.lang and o.phrase = w.phrase where o.over is null or 100 * o.over < 50 * w.a)
select k.lang, row_number() over (partition by k.lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, t.n, score
from kept k join totals t on t.lang = k.lang qualify rank <= 2000
"""
