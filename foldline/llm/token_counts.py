"""Edit-aware token counts: a segment tree of pre-tokens for each document.

The leaves hold runs of pre-tokens (cut where white space begins, where no pre-token reaches over)
in order; inner nodes hold the sums of characters and tokens below them. An edit is found by
descending through the character sums; only the chunks it touches and one chunk on either side are
cut and encoded again, after which the sums on the paths of the touched leaves are set anew. All
state belongs to one document, so rows are handled by themselves.

Defined cases: a null text counts as empty; null or empty edits leave the count; places beyond the
text's end count as its end, and an end before its start as the start; null replacements count as
empty; repeated rows give repeated results; an empty table gives an empty table; texts of any
length are handled whole. Edits are applied in the order of the array, each to the text so far.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldline.llm.bpe import CHUNK, RANKS, ByteBPE, _shared, codec
from foldline.llm.common import table

NAME = "op4_edit_aware_token_counts"
LEAF = 32


class CountTree:
    """Sums of characters and tokens over the leaves of a complete binary tree."""

    def __init__(self, text: str, made: ByteBPE):
        self.made, self.encoded = made, 0
        chunks, counts = self._count(text)
        self.leaves = [(chunks[i : i + LEAF], counts[i : i + LEAF]) for i in range(0, len(chunks), LEAF)] or [([], [])]
        self.width = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for k, (c, n) in enumerate(self.leaves):
            self.chars[self.width + k], self.tokens[self.width + k] = sum(map(len, c)), sum(n)
        for k in range(self.width - 1, 0, -1):
            self.chars[k], self.tokens[k] = self.chars[2 * k] + self.chars[2 * k + 1], self.tokens[2 * k] + self.tokens[2 * k + 1]

    def _count(self, text: str) -> tuple[list[str], list[int]]:
        chunks = CHUNK.findall(text)
        ids = self.made.chunk_ids(set(chunks))
        return chunks, [len(ids[c]) // 4 for c in chunks]

    def _find(self, place: int) -> tuple[int, int]:
        """Leaf and chunk that hold the character at place (the last ones for the text's end)."""
        if place >= self.chars[1]:
            leaf = next((k for k in range(len(self.leaves) - 1, -1, -1) if self.leaves[k][0]), 0)
            return leaf, max(len(self.leaves[leaf][0]) - 1, 0)
        node = 1
        while node < self.width:
            node *= 2
            if place >= self.chars[node]:
                place -= self.chars[node]
                node += 1
        leaf = node - self.width
        for k, c in enumerate(self.leaves[leaf][0]):
            if place < len(c):
                return leaf, k
            place -= len(c)
        raise AssertionError

    def _before(self, leaf: int, chunk: int) -> tuple[int, int] | None:
        while chunk == 0:
            leaf -= 1
            if leaf < 0:
                return None
            chunk = len(self.leaves[leaf][0])
        return leaf, chunk - 1

    def _after(self, leaf: int, chunk: int) -> tuple[int, int] | None:
        chunk += 1
        while chunk >= len(self.leaves[leaf][0]):
            leaf, chunk = leaf + 1, 0
            if leaf >= len(self.leaves):
                return None
        return leaf, chunk

    def _start(self, leaf: int, chunk: int) -> int:
        at, node = sum(map(len, self.leaves[leaf][0][:chunk])), self.width + leaf
        while node > 1:
            if node % 2:
                at += self.chars[node - 1]
            node //= 2
        return at

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces the characters from start to end by new."""
        size = self.chars[1]
        start = min(max(start, 0), size)
        end = min(max(end, start), size)
        first, last = self._find(start), self._find(max(end - 1, start))
        first, last = self._before(*first) or first, self._after(*last) or last
        begin = self._start(*first)
        a, b = first[0], last[0]
        old = "".join(c for k in range(a, b + 1) for c in self.leaves[k][0][first[1] if k == a else 0 : last[1] + 1 if k == b else None])
        chunks, counts = self._count(old[: start - begin] + new + old[end - begin :])
        self.encoded += len(chunks)
        head, tail = [x[: first[1]] for x in self.leaves[a]], [x[last[1] + 1 :] for x in self.leaves[b]]
        self.leaves[a] = (head[0] + chunks + tail[0], head[1] + counts + tail[1])
        for k in range(a + 1, b + 1):
            self.leaves[k] = ([], [])
        for k in range(a, b + 1):
            node = self.width + k
            self.chars[node], self.tokens[node] = sum(map(len, self.leaves[k][0])), sum(self.leaves[k][1])
        level = {(self.width + k) // 2 for k in range(a, b + 1)}
        while level and max(level):
            for k in level:
                if k:
                    self.chars[k], self.tokens[k] = self.chars[2 * k] + self.chars[2 * k + 1], self.tokens[2 * k] + self.tokens[2 * k + 1]
            level = {k // 2 for k in level if k > 1}

    def text(self) -> str:
        return "".join(c for chunks, _ in self.leaves for c in chunks)


def count_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits", ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(id_col, tokens_before, tokens_after, chunks_before, chunks_encoded, edited): edits_col is an
    array of structs (start, end, replacement) in characters; edited is the text after all edits."""
    data = _shared(df.sparkSession, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(data.value, pattern)
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                texts = [t or "" for t in part.column(1).to_pylist()]
                made.chunk_ids(set().union(*map(CHUNK.findall, texts)))
                out = []
                for text, edits in zip(texts, part.column(2).to_pylist()):
                    tree = CountTree(text, made)
                    before, chunks = tree.tokens[1], sum(len(c) for c, _ in tree.leaves)
                    for e in edits or []:
                        if e:
                            tree.edit(e["start"] or 0, e["end"] or 0, e["replacement"] or "")
                    out.append((before, tree.tokens[1], chunks, tree.encoded, tree.text()))
                columns = [pa.array(x, pa.string() if k == 4 else pa.int64()) for k, x in enumerate(zip(*out))]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], [id_col, "tokens_before", "tokens_after", "chunks_before", "chunks_encoded", "edited"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col, edits_col).mapInArrow(run, f"`{id_col}` {kind}, tokens_before long, tokens_after long, chunks_before long, chunks_encoded long, edited string")


def sample_edits(text_col: str = "text", id_col: str = "doc_id"):
    """Four edits spread over a text: each replaces up to six characters at a place drawn from the id."""
    size = F.length(F.coalesce(F.col(text_col), F.lit("")))

    def one(k: int):
        start = F.pmod(F.crc32(F.concat_ws("/", F.col(id_col).cast("string"), F.lit(str(k))).cast("binary")), size + 1)
        new = ["", " ", "insertion of words", "Ab1 ,\n"][k]
        return F.struct(start.cast("long").alias("start"), (start + F.lit(6 if k != 2 else 0)).cast("long").alias("end"), F.lit(new).alias("replacement"))

    return F.array(*[one(k) for k in range(4)])


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with four edits each: token counts before and after, and how much was encoded again."""
    rows = table(spark, sf_dir, "documents").withColumn("edits", sample_edits())
    return count_edits(rows).select("doc_id", "tokens_before", "tokens_after", "chunks_before", "chunks_encoded", F.sha2("edited", 256).alias("edited_sha256"))
