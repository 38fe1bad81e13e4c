"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A vocabulary is a rank file (one line a token: base64 bytes, rank). Its merges follow from the
ranks: a token of rank r is made of the two parts that the lower ranks leave of it. Texts are cut
by a pattern into pre-tokens; a pre-token never reaches over the start of a run of white space, so
texts are first cut there and the results for each such chunk are remembered (a bounded number).

Defined cases: a null text counts as empty and has no tokens; a row is handled by itself, so
repeated rows give repeated results; an empty table gives an empty table; only the named columns
are read, so extra columns can't clash; texts of any length are handled whole.
"""

from __future__ import annotations

import base64
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from foldline.llm.common import table, tidy

NAME = "op3_byte_level_bpe"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Unicode's White_Space, which is what \s in the pattern stands for.
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNK = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
KEPT, LONGEST_KEPT = 300_000, 48


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(others)) for b in range(256)]


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


class ByteBPE:
    """Encoder and decoder for one rank file and one pattern."""

    def __init__(self, data: bytes, pattern: str = public_tokenizers.PATTERN):
        import regex
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives each core a task

        self.ranks = read_ranks(data)
        letters = byte_letters()
        spelled = {token: "".join(letters[b] for b in token) for token in self.ranks}
        merges = [tuple("".join(letters[b] for b in part) for part in self._parts(token, rank)) for token, rank in sorted(self.ranks.items(), key=lambda x: x[1]) if len(token) > 1]
        self.library = Tokenizer(models.BPE(vocab={spelled[t]: r for t, r in self.ranks.items()}, merges=merges))
        self.pattern = regex.compile(pattern)
        self.exact = pre_tokenizers.Split(Regex(pattern), "isolated")
        # Letters and numbers of a newer Unicode version than others' are cut by the library itself.
        everything = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
        self.newer = frozenset(c for c in regex.findall(r"[\p{L}\p{N}]", everything) if unicodedata.category(c) == "Cn")
        self.letters = dict(enumerate(letters))
        self.kept: dict[str, bytes] = {}
        self.kept_matches: dict[str, bytes] = {}
        size = max(self.ranks.values()) + 1
        lengths, pieces = np.zeros(size, np.int64), [b""] * size
        for token, rank in self.ranks.items():
            lengths[rank], pieces[rank] = len(token), token
        self.lengths, self.starts = lengths, np.cumsum(lengths) - lengths
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        #: Whether a token begins within a character.
        self.inside = np.array([bool(p) and (p[0] & 0xC0) == 0x80 for p in pieces])

    def _parts(self, token: bytes, below: int) -> list[bytes]:
        """What the merges of lower ranks leave of a token."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            found = [(self.ranks.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            rank, i = min(found)
            if rank >= below:
                raise ValueError(f"rank {below} is not made of two tokens of lower rank")
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def split(self, chunk: str) -> list[str]:
        """The matches of the pattern, which cover a chunk."""
        if chunk.isascii() or self.newer.isdisjoint(chunk):
            return self.pattern.findall(chunk)
        return [piece for piece, _ in self.exact.pre_tokenize_str(chunk)]

    def _match_ids(self, matches: list[str]) -> list[bytes]:
        """Packed ids of pre-tokens that are merged each by itself."""
        spelled = [m.encode().decode("latin-1").translate(self.letters) for m in matches]
        out: list[bytes] = []
        for at in range(0, len(spelled), 500):
            part = spelled[at : at + 500]
            found = self.library.encode_batch_fast([part], is_pretokenized=True, add_special_tokens=False)[0]
            ids = np.array(found.ids, "<u4")
            ends = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum([len(s) for s in part])) + 1
            raw, ends = ids.tobytes(), [0, *(ends * 4).tolist()]
            out += [raw[i:j] for i, j in zip(ends, ends[1:])]
        return out

    def chunk_ids(self, chunks: set[str]) -> dict[str, bytes]:
        """A mapping that has the packed ids of all these chunks."""
        fresh = [c for c in chunks if c not in self.kept]
        matches = [self.split(c) for c in fresh]
        distinct = set().union(*matches)
        new = [m for m in distinct if m not in self.kept_matches]
        self.kept_matches.update(zip(new, self._match_ids(new)))
        of = self.kept_matches.__getitem__
        self.kept.update((c, of(m[0]) if len(m) == 1 else b"".join(map(of, m))) for c, m in zip(fresh, matches))
        ids = self.kept
        if len(self.kept) > KEPT:  # only what these texts have stays
            self.kept = {c: ids[c] for c in chunks if len(c) <= LONGEST_KEPT}
        if len(self.kept_matches) > KEPT:
            self.kept_matches = {m: of(m) for m in distinct if len(m) <= LONGEST_KEPT}
        return ids

    def forget(self) -> None:
        """Empties what is remembered of texts, which is large; a worker keeps the codec itself for its next task."""
        self.kept, self.kept_matches = {}, {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        out, at = [], 0
        while at < len(texts):  # as many texts at a time as have about two million characters
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= 2_000_000):
                size, end = size + len(texts[end]), end + 1
            cut = [CHUNK.findall(t) for t in texts[at:end]]
            ids = self.chunk_ids(set().union(*cut))
            out += [b"".join(map(ids.__getitem__, c)) for c in cut]
            at = end
        return out

    def decode(self, packed: bytes) -> bytes:
        ids = np.frombuffer(packed, "<u4").astype(np.int64)
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        if not len(ids):
            return b""
        return self.bytes[np.repeat(self.starts[ids] - ends + lengths, lengths) + np.arange(ends[-1])].tobytes()

    def offsets(self, packed: bytes, text: str) -> tuple[np.ndarray, np.ndarray]:
        """First and end character of each token; the tokens that share a split character both have it."""
        lengths = self.lengths[np.frombuffer(packed, "<u4").astype(np.int64)]
        ends = np.cumsum(lengths)
        raw = np.frombuffer(text.encode(), np.uint8)
        character = np.cumsum((raw & 0xC0) != 0x80) - 1
        return character[ends - lengths], character[ends - 1] + 1


_made: dict[tuple[int, int, str], ByteBPE] = {}


def codec(data: bytes, pattern: str) -> ByteBPE:
    """One codec a worker process."""
    key = (len(data), hash(data), pattern)
    if key not in _made:
        _made.clear()
        _made[key] = ByteBPE(data, pattern)
    return _made[key]


def _shared(spark: SparkSession, ranks: str):
    """The rank file (under a megabyte) for all executors."""
    with open(ranks, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN, offsets: bool = False) -> DataFrame:
    """(id_col, n_tokens, n_split, ids): ids are packed little-endian 32-bit integers; n_split counts
    tokens that begin within a character. With offsets also starts and ends, in characters."""
    data = _shared(df.sparkSession, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(data.value, pattern)
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                texts = [t or "" for t in part.column(1).to_pylist()]
                packed = made.encode(texts)
                columns = [part.column(0), pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array([int(made.inside[np.frombuffer(p, "<u4")].sum()) for p in packed], pa.int64()), pa.array(packed, pa.binary())]
                names = [id_col, "n_tokens", "n_split", "ids"]
                if offsets:
                    pairs = [made.offsets(p, t) for p, t in zip(packed, texts)]
                    columns += [pa.array([p[k].tolist() for p in pairs], pa.list_(pa.int32())) for k in (0, 1)]
                    names += ["starts", "ends"]
                yield pa.RecordBatch.from_arrays(columns, names)
        made.forget()
        tidy()

    kind = df.schema[id_col].dataType.simpleString()
    more = ", starts array<int>, ends array<int>" if offsets else ""
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, n_split long, ids binary{more}")


def decode(df: DataFrame, keep: list[str], ids_col: str = "ids", ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """The columns in keep, the packed ids, and their bytes as column decoded; null ids count as none."""
    data = _shared(df.sparkSession, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(data.value, pattern)
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                raw = pa.array([made.decode(p or b"") for p in part.column(len(keep)).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, raw], [*keep, ids_col, "decoded"])

    chosen = df.select(*keep, ids_col)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema)
    return chosen.mapInArrow(run, f"{fields}, decoded binary")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    made = decode(encode(table(spark, sf_dir, "documents")), ["doc_id", "n_tokens", "n_split"])
    return made.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "n_split")
