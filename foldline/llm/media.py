"""Media columns: signature sniffing of binary values.

Aho-Corasick locates the magic bytes of all formats, and the marks that some of them end with, in one pass over a value; a validator of the
format then confirms structure and length at each place found. A value that is valid media from its
first byte gets that type whatever was declared; valid media elsewhere in it, behind or within others,
are listed with the offset of the innermost media that holds them, and can be carved out.

Defined cases: a null value counts as no bytes and keeps its declared type; bytes that only look
like a signature fail validation and yield nothing; equal values give equal results; a value is
looked at whole; an empty table gives an empty table; only the named columns are read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldline.llm.common import stored, table

NAME = "op1_media_signature_sniffing"
UNIT, FILL, RATE = 576, 255, 8000
UNKNOWN = "application/octet-stream"


# Each validator gets the bytes, where a signature begins and the places of the marks; it returns the length of the media or 0.
Marks = dict[bytes, list[int]]
#: What ends a JPEG, a PDF (after its table's place) and a ZIP.
JPEG_END, PDF_END, PDF_TABLE, ZIP_END = MARKS = (b"\xff\xd9", b"%%EOF", b"startxref", b"PK\5\6")
JPEG_MARK = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")  # not stuffing, restart or fill
PIECE = 1 << 16


def _riff(data: bytes, at: int, marks: Marks) -> int:
    """Chunks of a RIFF file must fill its stated length; WAVE needs a format and samples that fit it."""
    if len(data) < at + 12:
        return 0
    end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    kind, place, seen = data[at + 8 : at + 12], at + 12, {}
    if kind not in (b"WAVE", b"AVI ", b"WEBP") or end > len(data):
        return 0
    while place + 8 <= end:
        name, size = data[place : place + 4], struct.unpack_from("<I", data, place + 4)[0]
        seen.setdefault(name, (place + 8, size))
        place += 8 + size + size % 2
    if place != end or not seen:
        return 0
    if kind == b"WAVE":
        if b"fmt " not in seen or b"data" not in seen or seen[b"fmt "][1] < 16:
            return 0
        _, channels, rate, second, block, bits = struct.unpack_from("<HHIIHH", data, seen[b"fmt "][0])
        if not block or block != channels * bits // 8 or second != rate * block or seen[b"data"][1] % block:
            return 0
    return end - at


def _png(data: bytes, at: int, marks: Marks) -> int:
    place, first = at + 8, True
    while place + 12 <= len(data):
        size, name = struct.unpack_from(">I", data, place)[0], data[place + 4 : place + 8]
        if first != (name == b"IHDR") or place + 12 + size > len(data):
            return 0
        if zlib.crc32(data[place + 4 : place + 8 + size]) != struct.unpack_from(">I", data, place + 8 + size)[0]:
            return 0
        place, first = place + 12 + size, False
        if name == b"IEND":
            return place - at
    return 0


def _gif(data: bytes, at: int, marks: Marks) -> int:
    def blocks(p: int) -> int:
        while p < len(data) and data[p]:
            p += data[p] + 1
        return p + 1 if p < len(data) else 0

    if len(data) < at + 13:
        return 0
    place = at + 13 + (3 << (data[at + 10] & 7) + 1 if data[at + 10] & 0x80 else 0)
    while place < len(data):
        if data[place] == 0x3B:
            return place + 1 - at
        if data[place] == 0x21:
            place = blocks(place + 2)
        elif data[place] == 0x2C and place + 10 < len(data):
            flags = data[place + 9]
            place = blocks(place + 11 + (3 << (flags & 7) + 1 if flags & 0x80 else 0))
        else:
            return 0
        if not place:
            return 0
    return 0


def _jpeg(data: bytes, at: int, marks: Marks) -> int:
    """Segments by their lengths and the scans between them, up to the end mark outside of both."""
    place, scanned = at + 2, False
    last = marks[JPEG_END][-1] if marks[JPEG_END] else -1
    while place < last and place + 4 <= len(data) and data[place] == 0xFF and data[place + 1] != 0xD9:
        mark, size = data[place + 1], struct.unpack_from(">H", data, place + 2)[0]
        if not 0xC0 <= mark <= 0xFE or size < 2:
            return 0
        place += 2 + size
        if mark == 0xDA:
            found = JPEG_MARK.search(data, place)
            if not found:
                return 0
            place, scanned = found.start(), True
    return place + 2 - at if scanned and data[place : place + 2] == JPEG_END else 0


def _bmp(data: bytes, at: int, marks: Marks) -> int:
    if len(data) < at + 30:
        return 0
    size, _, begin, head = struct.unpack_from("<IIII", data, at + 2)
    return size if head in (12, 40, 52, 56, 64, 108, 124) and 14 + head <= begin <= size <= len(data) - at else 0


def _after(places: list[int], at: int) -> int:
    k = bisect_left(places, at)
    return places[k] if k < len(places) else -1


def _pdf(data: bytes, at: int, marks: Marks) -> int:
    """Up to the first end mark behind the place of a table, which must be digits."""
    table_at = _after(marks[PDF_TABLE], at)
    end = _after(marks[PDF_END], table_at) if table_at >= 0 else -1
    return end + len(PDF_END) - at if end >= 0 and data[table_at + len(PDF_TABLE) : end].strip().isdigit() else 0


def _zip(data: bytes, at: int, marks: Marks) -> int:
    """Up to the first end record whose directory ends just before it and belongs to this beginning."""
    k = bisect_left(marks[b"zip"], (at, at)) if b"zip" in marks else 0
    end = marks[b"zip"][k][1] if k < len(marks.get(b"zip", [])) and marks[b"zip"][k][0] == at else -1
    return end + 22 + struct.unpack_from("<H", data, end + 20)[0] - at if end >= 0 else 0


def _zip_ends(data: bytes, ends: list[int]) -> list[tuple[int, int]]:
    """(beginning, end record) of what may be ZIP files: the record says how far back they begin."""
    found = []
    for end in ends:
        if end + 22 <= len(data):
            size, begin = struct.unpack_from("<II", data, end + 12)
            if end - begin - size >= 0 and end + 22 + struct.unpack_from("<H", data, end + 20)[0] <= len(data):
                found.append((end - begin - size, end))
    return sorted(found)


def _gzip(data: bytes, at: int, marks: Marks) -> int:
    """Inflated piece by piece, nothing of it kept."""
    work, view, place = zlib.decompressobj(31), memoryview(data), at
    try:
        while not work.eof and place < len(data):
            piece = view[place : place + PIECE]
            place += len(piece)
            work.decompress(piece, PIECE)
            while work.unconsumed_tail and not work.eof:
                work.decompress(work.unconsumed_tail, PIECE)
    except zlib.error:
        return 0
    return place - len(work.unused_data) - at if work.eof else 0


def _flac(data: bytes, at: int, marks: Marks) -> int:
    """Metadata blocks up to the last one; frames run to the end of the value."""
    place, first = at + 4, True
    while place + 4 <= len(data):
        kind, size = data[place], int.from_bytes(data[place + 1 : place + 4], "big")
        if first and (kind & 0x7F or size != 34):
            return 0
        place, first = place + 4 + size, False
        if kind & 0x80:
            return len(data) - at if place <= len(data) else 0
    return 0


def _mp4(data: bytes, at: int, marks: Marks) -> int:
    """Boxes from ftyp on; the signature stands behind the first box's length."""
    place, names = at, []
    while place + 8 <= len(data):
        size, name = struct.unpack_from(">I", data, place)[0], data[place + 4 : place + 8]
        if size < 8 or place + size > len(data) or not name.isalnum():
            break
        names.append(name)
        place += size
    return place - at if names[:1] == [b"ftyp"] and {b"moov", b"mdat", b"meta"} & set(names) else 0


#: Magic bytes, how far behind the media's first byte they stand, type, validator.
SIGNATURES = [
    (b"RIFF", 0, "audio/wav", _riff),
    (b"\x89PNG\r\n\x1a\n", 0, "image/png", _png),
    (b"GIF87a", 0, "image/gif", _gif),
    (b"GIF89a", 0, "image/gif", _gif),
    (b"\xff\xd8\xff", 0, "image/jpeg", _jpeg),
    (b"BM", 0, "image/bmp", _bmp),
    (b"%PDF-", 0, "application/pdf", _pdf),
    (b"PK\x03\x04", 0, "application/zip", _zip),
    (b"\x1f\x8b\x08", 0, "application/gzip", _gzip),
    (b"fLaC", 0, "audio/flac", _flac),
    (b"ftyp", 4, "video/mp4", _mp4),
]
RIFF_TYPES = {b"WAVE": "audio/wav", b"AVI ": "video/x-msvideo", b"WEBP": "image/webp"}


class Sniffer:
    def __init__(self) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for k, (magic, *_) in enumerate(SIGNATURES):
            self.automaton.add_word(magic.decode("latin-1"), (k, magic))
        for mark in MARKS:
            self.automaton.add_word(mark.decode("latin-1"), (-1, mark))
        self.automaton.make_automaton()

    def find(self, data: bytes) -> tuple[int, list[tuple[int, int, str, int | None]]]:
        """How many signatures there are, and (offset, length, type, offset of the innermost media around it) of valid media."""
        marks: dict = {mark: [] for mark in MARKS}
        places = []
        for end, (k, magic) in self.automaton.iter(data.decode("latin-1")):
            if k < 0:
                marks[magic].append(end + 1 - len(magic))
            elif (at := end + 1 - len(magic) - SIGNATURES[k][1]) >= 0:
                places.append((at, k))
        if marks[ZIP_END]:
            marks[b"zip"] = _zip_ends(data, marks[ZIP_END])
        found, around = [], []
        for at, k in sorted(places):
            while around and around[-1][1] <= at:
                around.pop()
            if size := SIGNATURES[k][3](data, at, marks):
                kind = RIFF_TYPES[data[at + 8 : at + 12]] if data[at : at + 4] == b"RIFF" else SIGNATURES[k][2]
                found.append((at, size, kind, around[-1][0] if around else None))
                if not around or at + size <= around[-1][1]:
                    around.append((at, at + size))
        return len(places), found


def sniff(df: DataFrame, id_col: str, media_col: str, declared_col: str) -> DataFrame:
    """(id_col, declared_type, media_type, n_signatures, embedded, media): embedded is an array of
    (offset, length, type, container) of all media in a value but the one that is the value's type; container is
    the offset of the innermost media around it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Sniffer()
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                kinds, counts, inside = [], [], []
                for data, declared in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    n, found = s.find(data or b"")
                    whole = next((kind for o, _, kind, _ in found if o == 0), None)
                    kinds.append(whole or declared)
                    counts.append(n)
                    inside.append([{"offset": o, "length": z, "type": k, "container": c} for o, z, k, c in found if o])
                spans = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("container", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(kinds, pa.string()), pa.array(counts, pa.int64()), pa.array(inside, spans), part.column(1)], [id_col, "declared_type", "media_type", "n_signatures", "embedded", "media"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, F.col(media_col).cast("binary"), F.col(declared_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, declared_type string, media_type string, n_signatures long, embedded array<struct<offset:long,length:long,type:string,container:long>>, media binary")


def carve(sniffed: DataFrame, id_col: str) -> DataFrame:
    """A row for each embedded piece of media: (id_col, offset, media_type, media)."""
    return sniffed.select(id_col, "media", F.explode("embedded").alias("e")).select(id_col, F.col("e.offset").alias("offset"), F.col("e.type").alias("media_type"), F.expr("substring(media, int(e.offset + 1), int(e.length))").alias("media"))


def wav(payload: bytes, rate: int = RATE) -> bytes:
    """A one-channel file of 8-bit samples."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload)) + payload


def wav_samples(media: bytes) -> bytes:
    place = 12
    while media[place : place + 4] != b"data":
        place += 8 + (size := struct.unpack_from("<I", media, place + 4)[0]) + size % 2
    return media[place + 8 : place + 8 + struct.unpack_from("<I", media, place + 4)[0]]


def text_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, declared_type, media): UTF-8 texts, filled up to a multiple of 576 bytes, as samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                raw = [(t or "").encode() for t in part.column(1).to_pylist()]
                media = [wav(r + bytes([FILL]) * (-len(r) % UNIT or UNIT * (not r))) for r in raw]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array([UNKNOWN] * len(raw)), pa.array(media, pa.binary())], [id_col, "n_bytes", "declared_type", "media"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, declared_type string, media binary")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores all texts as media, reads them back, sniffs the stored bytes, takes the samples out."""
    kept = stored(text_media(table(spark, sf_dir, "documents")))
    sniffed = sniff(kept.select(F.struct("doc_id", "n_bytes").alias("key"), "media", "declared_type"), "key", "media", "declared_type")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, declared, kind, n, inside, media in zip(*(c.to_pylist() for c in batch.columns)):
                payload = wav_samples(media)
                out.append((key["doc_id"], key["n_bytes"], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), f"{declared}>{kind} {len(payload)} samples, {n} signatures, {inside} media inside, mean {sum(payload) / len(payload):.4f}"))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names)

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return sniffed.select("key", "declared_type", "media_type", "n_signatures", F.size("embedded"), "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
