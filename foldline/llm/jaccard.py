"""N-gram Jaccard join by T-occurrence search (DivideSkip) over prefix blocks.

Documents with equal shingle sets are one class from the start. Two different sets that link share at
least ceil(t |x|) shingles, t being num/den. So of the first |x| - ceil(t |x|) + 1 shingles of x and
the like number of y, in one order of all shingles, one is shared: these are a set's keys. The order
puts common shingles last, rarest first, so that no passage that many documents share becomes a key
unless a set has hardly anything else. Which shingles are common is counted over all documents
(the counts of less than LEAST in BATCH shingles are left out); the order decides about the
work alone, never about what is found: any order that all sets share gives the same links.

Of two linked sets the one that isn't larger, x, shares at least ceil(2 t / (1 + t) |x|) shingles with the other, so the shared
key is among its first |x| - ceil(2 t / (1 + t) |x|) + 1, its short keys. A key that is nobody's short key joins nobody, nor
does one join a set with smaller ones of which it is no short key. Texts of one template that differ too much to link thus share no block:
what makes them differ are rare shingles, which take up their short keys.

Sets that share a key form a block, cut where neighbours in size are too far apart to link. Each
set has a sketch: the parity of the number of its shingles in each of some bits. Two sets differ in
at least as many shingles as their sketches differ in bits, so pairs whose sketches differ
in more than linked sets may differ are ruled out without their sets.

What is left is searched by T-occurrence: the block's sets are turned into inverted
lists; for a query set of which T shingles must occur elsewhere, the T - 1 longest of its lists are
set aside, the short rest is merged with a heap, and each candidate met there is probed by binary
search in the long lists until T is reached or can't be. Exact sizes then decide.

Large groups are cut down before that: first each block's pivot (the class that shares most
keys) is searched among the block's classes, in chunks, which joins most near copies. Then, in blocks whose
classes are still in several components, the pairs that the sketches allow connect classes to areas;
only classes outside the component that most of their area is in are searched against the area,
again in chunks. Candidates known to be connected to the query are skipped, since
components stay the same. So no pair list of a group is ever made, no group is held in one task, and no
link between different components is lost.

Shingles are 64-bit hashes of words; sets count as equal by 128 bits of their hash.

Defined cases: null, empty and blank texts have an empty set and link with nothing; shorter texts
than a shingle are one shingle; ties have no influence; rows of one doc_id are one document, which
has the links of all its texts (n_shingles is each row's own); a null doc_id makes no links, but its row has the component of its text if other
documents have that text; an empty table gives an empty table; only the
named columns are read; texts of any length are handled whole.
"""

from __future__ import annotations

import hashlib
import heapq
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from foldline.llm.common import Memo, broadcast_below, forget, pieces, stored, table
from foldline.llm.components import components

NAME = "op6_ngram_jaccard_join"
CHUNK = 400  # sets in a task's inverted lists
BATCH, LEAST = 2_000_000, 3  # shingles that a task counts at once; fewer occurrences there aren't reported
COMMON, RANKED = 32, 1_000_000  # occurrences from which a shingle is ranked as common; the most that are ranked
SKETCH_BITS = 1 << 16  # at most; larger sets are told apart less well
NODES = 4_000_000  # ids up to which they are broadcast
ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


class Shingler:
    """Sorted distinct shingle hashes of a text: A-Z lower-cased, words between ASCII white space."""

    def __init__(self, k: int):
        self.k = k
        self.words = Memo(lambda w: xxhash.xxh3_64_intdigest(w), 600_000)

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()
        h = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        n = len(h) - self.k + 1
        if n < 1:
            return np.array([xxhash.xxh3_64_intdigest(h.tobytes())], np.uint64) if len(h) else h
        out = np.full(n, np.uint64(self.k))
        for j in range(self.k):
            out = mixed(out * ODD + h[j : j + n])
        return np.unique(out)


def outlines(documents: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, set_id) of (doc_id, text), and rows (shingle, times) of shingles that occur often in a part of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, seen, size = Shingler(k), [], 0
        names = ["doc_id", "n", "set_id", "shingle", "times"]

        def often() -> pa.RecordBatch:
            shingles, times = np.unique(np.concatenate(seen), return_counts=True)
            keep = times >= LEAST
            none = [pa.nulls(int(keep.sum()), t) for t in (pa.int64(), pa.int64(), pa.binary())]
            return pa.RecordBatch.from_arrays([*none, pa.array(shingles[keep].view(np.int64)), pa.array(times[keep])], names)

        for batch in batches:
            for part in pieces(batch):
                sets = [of(t) for t in part.column(1).to_pylist()]
                ids = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                none = [pa.nulls(len(sets), pa.int64())] * 2
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.binary()), *none], names)
                seen += sets
                size += sum(map(len, sets))
                if size > BATCH:
                    yield often()
                    seen, size = [], 0
        if size:
            yield often()

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, set_id binary, shingle long, times long")


def common_shingles(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most common shingles of (shingle, times), RANKED at most, and their ranks, rarest first."""
    sums = stored(counts.groupBy("shingle").agg(F.sum("times").alias("times")).filter(F.col("times") >= COMMON))
    levels = sums.groupBy(F.floor(F.log2("times")).cast("int").alias("level")).count().orderBy(F.desc("level")).collect()  # 64 rows at most
    total, least = 0, 1 << 62
    for level, n in levels:
        total += n
        if total > RANKED:
            break
        least = 1 << level
    got = sums.filter(F.col("times") >= least).toArrow()
    forget(sums)
    shingles, times = got["shingle"].to_numpy().view(np.uint64), got["times"].to_numpy()
    order = np.argsort(shingles)
    shingles, times = shingles[order], times[order]
    rank = np.empty(len(shingles), np.int64)
    rank[np.lexsort((shingles, times))] = np.arange(len(shingles))
    return shingles, rank


class Prefixes:
    """The keys of a set: its first shingles in an order that has the common ones last. Its short keys are the first ones of these."""

    def __init__(self, num: int, den: int, common: np.ndarray, rank: np.ndarray):
        self.num, self.den, self.common, self.rank = num, den, common, rank

    def short(self, n: int) -> int:
        """How many keys of a set of n shingles are short ones."""
        return n - -(-2 * self.num * n // (self.den + self.num)) + 1

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        n = len(shingles)
        if self.den * n < self.num * (n + 1):  # links with equal sets only
            return shingles[:0]
        size = n - -(-self.num * n // self.den) + 1
        if not len(self.common):
            return shingles[:size]
        at = np.minimum(np.searchsorted(self.common, shingles), len(self.common) - 1)
        known = self.common[at] == shingles
        rare = shingles[~known][:size]
        if len(rare) == size:
            return rare
        late = shingles[known][np.argsort(self.rank[at[known]])]
        return np.concatenate([rare, late[: size - len(rare)]])


def sketch(shingles: np.ndarray) -> bytes:
    bits = min(max(64, 1 << (len(shingles) - 1).bit_length()), SKETCH_BITS)
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


class Sketches:
    """Which pairs of sizes and sketches may belong to linked sets."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def may_link(self, n: int, a: bytes, m: int, b: bytes) -> bool:
        if self.den * min(n, m) < self.num * max(n, m):
            return False
        if len(a) > len(b):
            a, b = b, a
        x, y, size = int.from_bytes(a, "little"), int.from_bytes(b, "little"), 8 * len(b)
        while size > 8 * len(a):
            size //= 2
            y = (y >> size) ^ (y & ((1 << size) - 1))
        return (self.den + self.num) * (x ^ y).bit_count() <= (self.den - self.num) * (n + m)


def signatures(num: int, den: int, k: int, common: tuple[np.ndarray, np.ndarray], spark: SparkSession) -> Callable[[DataFrame], DataFrame]:
    """Turns (node, text) into (node, n, sketch, keys, short) of the sets that have keys; the first `short` of these are short ones."""
    ranked = spark.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, keys_of = Shingler(k), Prefixes(num, den, *ranked.value)
        for batch in batches:
            for part in pieces(batch):
                rows = []
                for node, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    s = of(text)
                    if len(keys := keys_of(s)):
                        rows.append((node, len(s), sketch(s), keys.view(np.int64)))
                if rows:
                    nodes, sizes, sketches, keys = zip(*rows, strict=True)
                    ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys)))
                    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary()), lists, pa.array([keys_of.short(n) for n in sizes], pa.int32())], ["node", "n", "sketch", "keys", "short"])

    return lambda df: df.mapInArrow(run, "node long, n long, sketch binary, keys array<long>, short int")


def shingle_sets(k: int) -> Callable[[DataFrame], DataFrame]:
    """Turns (node, text) into (node, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Shingler(k)
        for batch in batches:
            for part in pieces(batch, 200):
                sets = [of(t).view(np.int64) for t in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["node", "shingles"])

    return lambda df: df.mapInArrow(run, "node long, shingles array<long>")


def of_nodes(documents: DataFrame, nodes: DataFrame, made: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What `made` makes of the documents that a stored table names.

    Few ids are broadcast, so that no text is shuffled; beyond that the much smaller results are joined.
    """
    texts = documents.select(F.col("doc_id").cast("long").alias("node"), "text")
    if nodes.count() <= NODES:
        return made(texts.join(F.broadcast(nodes), "node", "left_semi"))
    return made(texts.filter("node is not null")).join(nodes, "node", "left_semi")


class Lists:
    """Inverted lists over sets, for T-occurrence searches."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = [len(s) for s in sets]
        tokens = np.concatenate(sets)
        owners = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.lexsort((owners, tokens))
        tokens, self.owners = tokens[order], owners[order].tolist()
        self.tokens, first = np.unique(tokens, return_index=True)
        self.bounds = np.append(first, len(tokens))

    def search(self, query: np.ndarray, least: int, wanted) -> Iterator[tuple[int, int]]:
        """(set, occurrences) of the sets that at least `least` of the query's shingles occur in and that are wanted."""
        at = np.searchsorted(self.tokens, query)
        query, at = query[at < len(self.tokens)], at[at < len(self.tokens)]
        at = at[self.tokens[at] == query]
        if len(at) < least:
            return
        lengths = self.bounds[at + 1] - self.bounds[at]
        order = at[np.argsort(lengths, kind="stable")]
        short, long = order[: len(order) - least + 1].tolist(), order[len(order) - least + 1 :].tolist()
        owners, bounds = self.owners, self.bounds.tolist()
        merged = heapq.merge(*(owners[bounds[t] : bounds[t + 1]] for t in short))
        now, met = -1, 0
        for d in [*merged, -2]:
            if d == now:
                met += 1
                continue
            if now >= 0 and wanted(now):
                for done, t in enumerate(long):
                    if met + len(long) - done < least:
                        break
                    place = bisect_left(owners, now, bounds[t], bounds[t + 1])
                    met += place < bounds[t + 1] and owners[place] == now
                if met >= least:
                    yield now, met
            now, met = d, 1


def search_blocks(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b), enough of them to connect all that links connect, within each (block, chunk).

    rows: block, chunk, node, component, query and indexed (booleans), shingles. A chunk's indexed
    sets are bounded in number; queries of a chunk are handled one after another.
    """

    def run(group):
        nodes, comps = group.column("node").to_numpy(), group.column("component").to_numpy()
        sets = [np.asarray(s, np.int64).view(np.uint64) for s in group.column("shingles").to_numpy(zero_copy_only=False)]
        indexed = [i for i, x in enumerate(group.column("indexed").to_pylist()) if x]
        queries = [i for i, x in enumerate(group.column("query").to_pylist()) if x]
        found: list[tuple[int, int]] = []
        if indexed and queries:
            lists, up = Lists([sets[i] for i in indexed]), {}

            def top(c):
                while c in up:
                    c = up[c]
                return c

            smallest = min(lists.sizes)
            for q in queries:
                size, mine = len(sets[q]), top(comps[q])
                least = -(-num * (size + max(smallest, -(-num * size // den))) // (num + den))

                def wanted(d):
                    other = lists.sizes[d]
                    return den * min(size, other) >= num * max(size, other) and top(comps[indexed[d]]) != top(comps[q])

                for d, met in lists.search(sets[q], max(least, 1), wanted):
                    if den * met >= num * (size + lists.sizes[d] - met):
                        i = indexed[d]
                        found.append((nodes[q], nodes[i]))
                        a, b = top(comps[q]), top(comps[i])
                        if a != b:
                            up[max(a, b)] = min(a, b)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})

    return rows.groupBy("block", "chunk").applyInArrow(run, "a long, b long")


def _chunk(n_col: str, id_col: str):
    """Which chunk of CHUNK rows at about the mean a row of a block with n_col rows is in."""
    return F.pmod(F.xxhash64(id_col), F.greatest(F.lit(1), F.ceil(F.col(n_col) / CHUNK)))


def blocks_of(keyed: DataFrame, num: int, den: int) -> DataFrame:
    """(block, node, size): the nodes that share a key and that other nodes of like size share it with, if it is a short key of the smaller ones."""
    rows = keyed.select("node", "n", "short", F.posexplode("keys").alias("at", "key")).repartition("key")
    own = F.col("at") < F.col("short")
    upwards = Window.partitionBy("key").orderBy("n").rangeBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("smaller", F.max(F.when(own, F.col("n"))).over(upwards)).filter(den * F.col("smaller") >= num * F.col("n")).select("node", "n", "key")
    by_size = Window.partitionBy("key").orderBy("n", "node")
    before, after = F.lag("n").over(by_size), F.lead("n").over(by_size)
    rows = rows.select("key", "n", "node", before.alias("before"), after.alias("after"), F.lag("node").over(by_size).alias("last"))
    rows = rows.filter("last is null or last <> node or before <> n")  # rows of one document and size are one
    joins, joined = F.coalesce(den * F.col("before") >= num * F.col("n"), F.lit(False)), F.coalesce(den * F.col("n") >= num * F.col("after"), F.lit(False))
    rows = rows.select("key", "n", "node", joins.alias("joins"), joined.alias("joined")).withColumn("run", F.sum(F.when(F.col("joins"), 0).otherwise(1)).over(by_size))
    rows = rows.filter("joins or joined").withColumn("size", F.count("*").over(Window.partitionBy("key", "run")))
    return rows.filter("size > 1").select(F.xxhash64("key", "run").alias("block"), "node", "size")


def allowed(pairs: DataFrame, info: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (block, node) of nodes that may link by their sizes and sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may_link = Sketches(num, den).may_link
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(2, 6)]
            keep = pa.array([may_link(*x) for x in zip(*columns, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["block", "node"])

    other = info.select(F.col("node").alias("block"), F.col("n").alias("m"), F.col("sketch").alias("pivot_sketch"))
    both = pairs.join(info, "node").join(other, "block")
    return both.select("block", "node", "n", "sketch", "m", "pivot_sketch").mapInArrow(run, "block long, node long")


def allowed_in_blocks(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) that connect what the allowed pairs of nodes in different components connect.

    rows: block, chunk, node, component, query, indexed, n, sketch; the rows of a chunk are sorted to each other and
    handled as they stream by. A node that is in an allowed pair is also named by a pair with itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may_link = Sketches(num, den).may_link

        def found(group: list[tuple]) -> Iterator[tuple[int, int]]:
            up: dict[int, int] = {}

            def top(x):
                while (y := up.setdefault(x, x)) != x:
                    x = y
                return x

            active = set()
            indexed = [x for x in group if x[5]]
            for q in group:
                if q[4]:
                    for d in indexed:
                        if d[3] != q[3] and d[2] != q[2] and may_link(q[6], q[7], d[6], d[7]):
                            active |= {q[2], d[2]}
                            a, b = top(q[2]), top(d[2])
                            if a != b:
                                up[max(a, b)] = min(a, b)
                                yield q[2], d[2]
            for x in active:
                yield x, x

        def groups() -> Iterator[list[tuple]]:
            group: list[tuple] = []
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if group and group[0][:2] != row[:2]:
                        yield group
                        group = []
                    group.append(row)
            if group:
                yield group

        out: list[tuple[int, int]] = []
        for group in groups():
            out += found(group)
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

    rows = rows.select("block", "chunk", "node", "component", "query", "indexed", "n", "sketch")
    return rows.repartition("block", "chunk").sortWithinPartitions("block", "chunk").mapInArrow(run, "a long, b long")


def chunked(rows: DataFrame) -> DataFrame:
    """rows (block, node, component, query, size) dealt to chunks: each row is in one, queries are asked in all."""
    rows = rows.withColumn("chunk", _chunk("size", "node"))
    chunks = F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.col("size") / CHUNK)).cast("long") - 1)
    small = rows.filter(F.col("size") <= CHUNK).withColumn("indexed", F.lit(True))
    large = rows.filter(F.col("size") > CHUNK)
    asked = large.filter("query").withColumn("chunk", F.explode(chunks)).withColumn("indexed", F.lit(False))
    return small.unionByName(large.withColumn("query", F.lit(False)).withColumn("indexed", F.lit(True))).unionByName(asked)


def jaccard_components(documents: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(doc_id, n_shingles, component_id): documents link if their k-word shingle sets have a Jaccard
    similarity of num/den or more; component_id is the smallest doc_id that links lead to."""
    first = stored(outlines(documents, k))
    rows = first.filter("times is null").select("doc_id", "n", "set_id")
    named = rows.filter("set_id is not null and doc_id is not null")
    classes = stored(named.groupBy("set_id").agg(F.min("doc_id").alias("node")))
    common = common_shingles(first.filter("times is not null").select("shingle", "times"))
    repeated = not rows.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty()

    # Blocks, and in each the class that shares most.
    nodes = stored(classes.select("node").distinct())
    keyed = stored(of_nodes(documents, nodes, signatures(num, den, k, common, documents.sparkSession)))
    info = keyed.select("node", "n", "sketch").distinct() if repeated else keyed.select("node", "n", "sketch")
    shared = stored(blocks_of(keyed, num, den))
    weights = stored(shared.groupBy("node").agg(F.sum("size").alias("weight")))
    best = Window.partitionBy("block").orderBy(F.desc("weight"), "node")
    placed = stored(shared.join(broadcast_below(weights), "node").select("block", "node", "size", F.first("node").over(best).alias("pivot")))
    forget(shared, weights, nodes)

    # First each pivot among its blocks' classes.
    star = stored(placed.filter("node <> pivot").select(F.col("pivot").alias("block"), "node").distinct())
    star = stored(allowed(star, info, num, den))
    counts = stored(star.groupBy("block").agg(F.count("*").alias("size")))
    members = star.join(broadcast_below(counts), "block").select("block", "node", _chunk("size", "node").alias("chunk"))
    probes = members.select("block", F.col("block").alias("node"), "chunk").distinct()
    searched = members.withColumn("query", F.lit(False)).unionByName(probes.withColumn("query", F.lit(True)))
    searched = searched.select("block", "chunk", "node", F.col("node").alias("component"), "query", (~F.col("query")).alias("indexed"))

    def searched_with_sets(searched: DataFrame) -> DataFrame:
        near = stored(searched.select("node").distinct())
        sets = of_nodes(documents, near, shingle_sets(k))
        sets = sets.distinct() if repeated else sets
        links = stored(search_blocks(searched.join(sets, "node"), num, den))
        forget(near)
        return links

    links = searched_with_sets(searched)
    known = components(links)
    for end in ("node", "pivot"):
        own = known.select(F.col("node").alias(end), F.col("component").alias(f"{end}_component"))
        placed = placed.join(broadcast_below(own), end, "left").withColumn(f"{end}_component", F.coalesce(f"{end}_component", end))

    # Then, where pairs of other components are allowed in a block, those outside the largest one of their area.
    placed = stored(placed.filter("size > 2").select("block", "node", "size", F.col("node_component").alias("component"), (F.col("node_component") != F.col("pivot_component")).alias("query")))
    several = stored(placed.filter("query").select("block").distinct())
    left = chunked(placed.join(broadcast_below(several), "block", "left_semi"))
    pairs = stored(allowed_in_blocks(left.join(info, "node"), num, den).distinct())
    if pairs.isEmpty():
        found = known
    else:
        areas = components(pairs).withColumnRenamed("component", "block")
        inside = stored(areas.join(broadcast_below(known), "node", "left").select("block", "node", F.coalesce("component", "node").alias("component")))
        parts = inside.groupBy("block", "component").agg(F.count("*").alias("n"))
        several = stored(parts.groupBy("block").agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("largest"), F.sum("n").alias("size"), F.count("*").alias("parts")).filter("parts > 1"))
        rest = inside.join(broadcast_below(several), "block").select("block", "node", "component", (F.col("component") != F.col("largest")).alias("query"), "size")
        more = searched_with_sets(chunked(rest).select("block", "chunk", "node", "component", "query", "indexed"))
        found = known if more.isEmpty() else components(known.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    forget(keyed, placed)

    if repeated:  # all texts of a document are linked by it
        ids = named.join(classes, "set_id").select("doc_id", "node").join(found, "node", "left").select("doc_id", F.coalesce("component", "node").alias("part"))
        same = ids.groupBy("doc_id").agg(F.min("part").alias("least")).filter("least is not null").join(ids, "doc_id").select(F.col("part").alias("a"), F.col("least").alias("b"))
        found = components(stored(same).union(found.select("node", "component")))
    joined = classes.join(found, "node", "left").select("set_id", F.coalesce("component", "node").alias("component_id"))
    return rows.join(joined, "set_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), 3, 90, 100)
