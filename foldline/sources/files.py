"""Sequence files and reports as Spark data sources: FASTA read in byte ranges and written in parts, reports written a file each.

    register(spark)
    spark.read.format("fasta").load("/data/bank")          # file, place, id, defline, seq, fault
    df.select("id", "defline", "seq").write.format("fasta").mode("append").save("/data/out")
    write_reports(lines, "/data/reports")                   # (query_id, section, place, row, line)

Files are reached through pyarrow's file systems (local and shared folders, hdfs, s3, gs). Tasks write below _temporary, in a
folder of their job; the driver moves what the successful attempts name. What failed attempts leave there is never read.
"""

from __future__ import annotations

import bz2
import gzip
import io
import os
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SPLIT, ROWS, WIDTH = 64 << 20, 500, 72
PACKED = {".gz": gzip.GzipFile, ".bz2": bz2.BZ2File}


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), os.path.abspath(path)


@dataclass
class Range(InputPartition):
    """The records of a file that begin from start on and before end."""

    path: str = ""
    start: int = 0
    end: int = 0
    value: object = field(default=None, repr=False)


def ranges(size: int, split: int) -> list[tuple[int, int]]:
    """A file's bytes in parts; an empty file is one empty part."""
    return [(at, min(at + split, size)) for at in range(0, max(size, 1), split)]


def records(stream: io.BufferedIOBase, start: int, end: int) -> Iterator[tuple[int, str | None, str]]:
    """(place, head, letters) of the records that begin in a range of a file's bytes; a head of None has what stands before the first record.

    stream stands at start, or one byte before it if start isn't 0: whoever owns the byte at which a line begins owns the line."""
    at = start
    if start:
        at = start - 1 + len(stream.readline())
    place, head, letters, inside = at, None, [], start == 0
    for line in stream:
        if line.startswith(b">"):
            if inside and (head is not None or letters):
                yield place, head, "".join(letters)
            if at >= end:
                return
            place, head, letters, inside = at, line[1:].decode("utf-8", "replace").rstrip("\r\n"), [], True
        elif inside and (text := "".join(line.decode("utf-8", "replace").split())):
            letters.append(text)
        elif not inside and at >= end:
            return
        at += len(line)
    if inside and (head is not None or letters):
        yield place, head, "".join(letters)


class FastaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("split", SPLIT))

    def partitions(self) -> list[InputPartition]:
        fs, path = file_system(self.path)
        info = fs.get_file_info(path)
        if info.type == pafs.FileType.NotFound:
            raise ValueError(f"there is no {self.path}")
        files = [info] if info.type == pafs.FileType.File else [f for f in fs.get_file_info(pafs.FileSelector(path, recursive=True)) if f.type == pafs.FileType.File and not any(x.startswith(("_", ".")) for x in posixpath.relpath(f.path, path).split("/"))]
        out = []
        for f in sorted(files, key=lambda f: f.path):
            # A compressed file is read by one task: there is no telling where its lines begin.
            parts = [(0, 1 << 62)] if posixpath.splitext(f.path)[1] in PACKED else ranges(f.size, self.split)
            out += [Range(path=f.path, start=a, end=b) for a, b in parts]
        return out or [Range()]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = file_system(self.path)
        raw = fs.open_input_file(partition.path)
        unpack = PACKED.get(posixpath.splitext(partition.path)[1])
        stream = io.BufferedReader(unpack(fileobj=raw) if unpack is gzip.GzipFile else unpack(raw), 1 << 20) if unpack else io.BufferedReader(raw, 1 << 20)
        if partition.start:
            stream.seek(partition.start - 1)
        rows: list[tuple] = []
        for place, head, letters in records(stream, partition.start, partition.end):
            name, _, rest = (head or "").partition(" ")
            fault = "no record at the beginning" if head is None else "no id" if not name else "no letters" if not letters else None
            rows.append((partition.path, place, name, rest, letters, fault))
            if len(rows) >= ROWS:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)


READ = pa.schema([("file", pa.string()), ("place", pa.int64()), ("id", pa.string()), ("defline", pa.string()), ("seq", pa.string()), ("fault", pa.string())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), READ)], schema=READ)


@dataclass
class Written(WriterCommitMessage):
    """The files of an attempt: where they are, and what they are to be called."""

    files: list


class PartsWriter(DataSourceArrowWriter):
    """Writes files below _temporary; the driver gives them their names once all tasks are through."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.width = options["path"], overwrite, int(options.get("width", WIDTH))
        self.job = uuid.uuid4().hex

    def _folder(self) -> tuple[pafs.FileSystem, str, str, int]:
        from pyspark import TaskContext

        fs, path = file_system(self.path)
        task = TaskContext.get()
        number, attempt = (task.partitionId(), task.taskAttemptId()) if task else (0, 0)
        folder = f"{path}/_temporary/{self.job}/{number}-{attempt}"
        fs.create_dir(folder, recursive=True)
        return fs, path, folder, number

    def commit(self, messages: list) -> None:
        fs, path = file_system(self.path)
        if self.overwrite:
            for f in fs.get_file_info(pafs.FileSelector(path)):
                if f.type == pafs.FileType.File:
                    fs.delete_file(f.path)
        for message in messages:
            for made, name in message.files if message else []:
                fs.move(made, f"{path}/{name}")
        self._clear()
        fs.open_output_stream(f"{path}/_SUCCESS").close()

    def abort(self, messages: list) -> None:
        self._clear()

    def _clear(self) -> None:
        fs, path = file_system(self.path)
        if fs.get_file_info(f"{path}/_temporary/{self.job}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{path}/_temporary/{self.job}")


class FastaWriter(PartsWriter):
    """Columns id, defline and seq; letters wrapped. A null seq has no record."""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, _, folder, number = self._folder()
        made = f"{folder}/part.fasta"
        with fs.open_output_stream(made) as out:
            for batch in iterator:
                for name, rest, seq in zip(*(batch.column(c).to_pylist() for c in ("id", "defline", "seq"))):
                    if seq is not None:
                        head = f">{name or ''} {rest}" if rest else f">{name or ''}"
                        lines = [seq[k : k + self.width] for k in range(0, len(seq), self.width)]
                        out.write(("\n".join([head, *lines]) + "\n").encode())
        return Written([(made, f"part-{number:05d}-{uuid.uuid4().hex[:12]}.fasta")])


class ReportWriter(PartsWriter):
    """Lines (query_id, line), those of a query together and in order: a file for each query, named after it."""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, _, folder, _ = self._folder()
        files, out, owner = [], None, None
        for batch in iterator:
            for query, line in zip(batch.column("query_id").to_pylist(), batch.column("line").to_pylist()):
                if out is None or query != owner:
                    if out is not None:
                        out.close()
                    owner, name = query, f"{quote(str(query), safe='')}.sto"
                    files.append((f"{folder}/{name}", name))
                    out = fs.open_output_stream(files[-1][0])
                out.write(((line or "") + "\n").encode())
        if out is not None:
            out.close()
        return Written(files)


class Fasta(DataSource):
    """Options: split, bytes of a file that a task reads; width of written lines."""

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return "file string, place long, id string, defline string, seq string, fault string"

    def reader(self, schema) -> DataSourceReader:
        return FastaReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return FastaWriter(self.options, overwrite)


class Reports(DataSource):
    @classmethod
    def name(cls) -> str:
        return "reports"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return ReportWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Fasta)
    spark.dataSource.register(Reports)


def write_reports(lines: DataFrame, path: str, order: tuple[str, ...] = ("section", "place", "row")) -> None:
    """A file for each query with its lines in order; a task sorts its queries' lines, spilling if they are many, and streams them."""
    register(lines.sparkSession)
    dealt = lines.repartition("query_id").sortWithinPartitions("query_id", *order)
    dealt.select("query_id", "line").write.format("reports").mode("append").save(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value) of the text files of a folder, files named as they are without folder and suffix; whole files, since lines are numbered."""
    from pyspark.sql import functions as F

    whole = spark.read.option("wholetext", "true").option("pathGlobFilter", "*.sto").text(path).select(F.col("_metadata.file_name").alias("name"), "value")
    file = F.url_decode(F.url_decode(F.regexp_replace("name", r"\.sto$", "")))  # Spark quotes the names of files once more
    return whole.select(file.alias("file"), F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("line_no", "value"))
