"""Sharding by size-tiered compaction, with DataFrame operations only.

A store is a folder with runs (folders of immutable Parquet shards) and manifests. A manifest is a
small table that lists the shards of one version: run, tier, path, bytes, rows. Arrivals are
appended as small runs, all arrivals of a batch in one pass. Compaction merges
runs of similar size, as soon as there are enough of them, into files of the target size in a run
of the next tier. Readers open the files that the manifest lists, nothing else.

A version comes about by one small file, v<number>, made without overwriting, that names the version's manifest,
which was written before. Whoever finds the number taken starts again from the newer version. A writer that dies before
that leaves only files that no version names. One that dies while writing those few bytes leaves a file without a whole line:
no reader counts it, and once it is older than the grace time the next writer moves it away (so that a late
writer's bytes are lost) and takes the number. That a file is made without overwriting is up to the file system: HDFS assures
it; Hadoop's local file system and most object stores look first and write then, so that there only one writer may commit at a time.

Expiry deletes runs that an earlier version lists and the last two don't, and those earlier manifests; not before the grace time has
passed since a version was superseded, so that whoever began to read it while it was the newest can finish. Runs that no version ever listed may be another writer's: they go after ORPHAN_S only.

Defined cases: nulls in any column and repeated rows are kept as they are; an empty batch adds a
version without shards; columns of any name may be stored except arrival, run and tier, which are
refused; a text is never split between shards.
"""

from __future__ import annotations

import math
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldline.llm.common import crc_mod, shared_dir, table

NAME = "op2_size_tiered_compaction"
MANIFEST = "version long, run string, tier int, path string, bytes long, rows long"
OWN = {"arrival", "run", "tier"}
ORPHAN_S = 86_400.0


class ShardStore:
    def __init__(self, spark: SparkSession, path: str, schema, target_bytes: int = 128 << 20, fan_in: int = 4, ratio: float = 3.0, grace_s: float = 600.0, tries: int = 50):
        if OWN & {f.name.lower() for f in schema.fields}:
            raise ValueError(f"columns may not be named {sorted(OWN)}")
        self.spark, self.path, self.schema, self.target, self.fan_in, self.ratio = spark, path.rstrip("/"), schema, target_bytes, fan_in, ratio
        self.grace_s, self.tries = grace_s, tries
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # -- versions -----------------------------------------------------------------------------

    def _named(self, number: int) -> str | None:
        """The manifest that a version file names; None if it isn't there or not whole."""
        path = self._path(f"{self.path}/manifest/v{number:012d}")
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return text[:-1] if text.endswith("\n") else None

    def _versions(self) -> list[int]:
        """The numbers of the version files, also of those that aren't whole, newest first."""
        found = self._fs.globStatus(self._path(f"{self.path}/manifest/v[0-9]*"))
        return sorted((int(s.getPath().getName()[1:]) for s in found or []), reverse=True)

    def version(self) -> int:
        """The newest committed version; 0 if there is none."""
        return next((v for v in self._versions() if self._named(v)), 0)

    def manifest(self, version: int | None = None) -> DataFrame:
        v = self.version() if version is None else version
        if not v:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/{self._named(v)}")

    def _set_aside(self, path) -> None:
        """Takes the name from a version file that isn't whole; one that has become whole meanwhile gets it back."""
        aside = self._path(f"{self.path}/manifest/_dead-{uuid.uuid4().hex}")
        if not self._fs.rename(path, aside):
            return
        stream = self._fs.open(aside)
        whole = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").endswith("\n")
        stream.close()
        if whole:
            self._fs.rename(aside, path)
        else:
            self._fs.delete(aside, False)

    def _age(self, path) -> float:
        return time.time() - self._fs.getFileStatus(path).getModificationTime() / 1000

    def _commit(self, base: int, entries: DataFrame) -> bool:
        """Makes entries version base + 1 unless another writer has done so."""
        name = f"m-{uuid.uuid4().hex}"
        entries.withColumn("version", F.lit(base + 1).cast("long")).select(*MANIFEST.replace(",", "").split()[::2]).coalesce(1).write.parquet(f"{self.path}/manifest/{name}")
        path = self._path(f"{self.path}/manifest/v{base + 1:012d}")
        while not self._named(base + 1):
            try:
                out = self._fs.create(path, False)
            except Exception:
                # Another writer is about to write the few bytes, or has died before it could.
                if not self._fs.exists(path):
                    raise
                if self._age(path) > self.grace_s:
                    self._set_aside(path)
                else:
                    time.sleep(0.2)
                continue
            out.write((name + "\n").encode())
            out.close()
            break
        if self._named(base + 1) == name:
            return True
        self._fs.delete(self._path(f"{self.path}/manifest/{name}"), True)
        return False

    # -- reading ------------------------------------------------------------------------------

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, with the run and tier of their shard."""
        return self._rows(self.manifest(version))

    def _rows(self, shards: DataFrame) -> DataFrame:
        # Names of files, one for each target_bytes or so, come to the driver, which lists them in any case.
        paths = [f"{self.path}/{r['run']}/{r['path'].rpartition('/')[2]}" for r in shards.select("run", "path").collect()]
        if not paths:
            return self.spark.createDataFrame([], self.schema).select("*", F.lit("").alias("run"), F.lit(0).alias("tier"))
        rows = self.spark.read.schema(self.schema).parquet(*sorted(paths))
        run = F.regexp_extract("_metadata.file_path", r"/(t\d+/[^/]+)/[^/]+$", 1)
        return rows.select("*", run.alias("run")).withColumn("tier", F.regexp_extract("run", r"^t(\d+)/", 1).cast("int"))

    def _shards(self, below: str) -> DataFrame:
        """Manifest entries of the files below a folder: sizes from the listing, rows from the footers."""
        files = self.spark.read.schema(self.schema).parquet(below).groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes")).agg(F.count("*").alias("rows"))
        run = F.regexp_extract("path", r"/(t\d+/[^/]+)/[^/]+$", 1)
        return files.select(F.lit(0).cast("long").alias("version"), run.alias("run"), F.regexp_extract(run, r"^t(\d+)/", 1).cast("int").alias("tier"), "path", "bytes", "rows")

    # -- writing ------------------------------------------------------------------------------

    def append(self, df: DataFrame, arrival) -> int:
        """Adds rows; those of each value of the column arrival become one run of small shards."""
        batch = uuid.uuid4().hex[:12]
        df.select(*[F.col(f"`{f.name}`") for f in self.schema.fields], arrival.cast("int").alias("arrival")).write.option("compression", "zstd").partitionBy("arrival").parquet(f"{self.path}/t0/{batch}")
        # The folders t0/<batch>/arrival=<k> are named t0/<batch>-<k>: a run each.
        for s in self._fs.globStatus(self._path(f"{self.path}/t0/{batch}/arrival=*")) or []:
            self._fs.rename(s.getPath(), self._path(f"{self.path}/t0/{batch}-{s.getPath().getName().partition('=')[2]}"))
        self._fs.delete(self._path(f"{self.path}/t0/{batch}"), True)
        if not self._fs.globStatus(self._path(f"{self.path}/t0/{batch}-*")):
            fresh = self.spark.createDataFrame([], MANIFEST)
        else:
            fresh = self._shards(f"{self.path}/t0/{batch}-*")
        for _ in range(self.tries):
            if self._commit(base := self.version(), self.manifest(base).unionByName(fresh)):
                return base + 1
        raise RuntimeError(f"other writers were faster {self.tries} times; the rows aren't appended")

    def plan(self, version: int | None = None) -> list[list[dict]]:
        """The next merges: fan_in runs each, of sizes within a factor. Runs, not shards or rows, come to the driver."""
        runs = [r.asDict() for r in self.manifest(version).groupBy("run").agg(F.max("tier").alias("tier"), F.sum("bytes").alias("bytes")).orderBy("bytes", "run").collect()]
        groups: list[list[dict]] = []
        while runs:
            group = [r for r in runs[: self.fan_in] if r["bytes"] <= self.ratio * runs[0]["bytes"]]
            if len(group) == self.fan_in:
                groups.append(group)
                runs = runs[self.fan_in :]
            else:
                runs = runs[1:]
        return groups

    def compact(self) -> int:
        """Merges until no fan_in runs are of similar size; returns the version reached."""
        while groups := self.plan(base := self.version()):
            made = []
            for group in groups:
                name = f"t{max(r['tier'] for r in group) + 1}/{uuid.uuid4().hex[:12]}"
                files = max(1, math.ceil(sum(r["bytes"] for r in group) / self.target))
                rows = self._rows(self.manifest(base).filter(F.col("run").isin([r["run"] for r in group]))).drop("run", "tier")
                rows.coalesce(files).write.option("compression", "zstd").parquet(f"{self.path}/{name}")  # joins input splits; nothing is shuffled
                made.append(self._shards(f"{self.path}/{name}"))
            gone = [r["run"] for g in groups for r in g]
            for _ in range(self.tries):
                known = self.manifest(base)
                if known.filter(F.col("run").isin(gone)).select("run").distinct().count() < len(gone):
                    raise RuntimeError("another writer has merged the same runs; compact again")
                entries = known.filter(~F.col("run").isin(gone))
                for m in made:
                    entries = entries.unionByName(m)
                if self._commit(base, entries):
                    break
                base = self.version()  # rows were appended meanwhile
            else:
                raise RuntimeError(f"other writers were faster {self.tries} times; compact again")
            self.expire()
        return self.version()

    def expire(self) -> None:
        """Deletes earlier versions than the last two and their runs, and runs that never became part of one for ORPHAN_S."""
        versions = self._versions()
        whole = [v for v in versions if self._named(v)]
        # A version's time runs from the commit of the one after it.
        old = [v for later, v in zip(whole[1:], whole[2:]) if self._age(self._path(f"{self.path}/manifest/v{later:012d}")) >= self.grace_s]
        runs = {v: {r["run"] for r in self.manifest(v).select("run").distinct().collect()} for v in whole}
        kept = {run for v in whole if v not in old for run in runs[v]}
        for run in {run for v in old for run in runs[v]} - kept:
            self._fs.delete(self._path(f"{self.path}/{run}"), True)
        for v in old:  # after the runs: who dies before this deletes them once more
            name = self._named(v)
            self._fs.delete(self._path(f"{self.path}/manifest/v{v:012d}"), False)
            self._fs.delete(self._path(f"{self.path}/manifest/{name}"), True)
        for pattern, used in (("t*/*", {run for own in runs.values() for run in own}), ("manifest/m-*", {f"manifest/{self._named(v)}" for v in whole if v not in old})):
            for s in self._fs.globStatus(self._path(f"{self.path}/{pattern}")) or []:
                name = f"{s.getPath().getParent().getName()}/{s.getPath().getName()}"
                if name not in used and self._age(s.getPath()) > ORPHAN_S:
                    self._fs.delete(s.getPath(), True)


ARRIVALS = 17


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in 17 batches, are appended and compacted; every row with the tier that holds it."""
    documents = table(spark, sf_dir, "documents")
    store = ShardStore(spark, f"{shared_dir(spark)}/store", documents.schema, target_bytes=32 << 20, grace_s=0)  # nobody else reads it
    store.append(documents, crc_mod("doc_id", ARRIVALS))
    version = store.compact()
    return store.read(version).select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"), "lang", "source", "n_chars", "tier", F.lit(version).cast("long").alias("version"))
