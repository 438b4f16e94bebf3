"""Sharding with size-tiered compaction and an atomically committed manifest (native DataFrame code only).

Arrivals are appended as small immutable Parquet shards. Shards of similar size (one tier) are merged into files of the
target size as soon as there are ``fanout`` of them. Readers see only what a manifest lists. A new manifest version
is written aside, claimed by the exclusive creation of an empty file, and renamed into place: of two writers of one version
one gets the claim, the other a conflict. A crash at any point leaves the previous version whole; a claim that was never
made good is taken over after CLAIM_SECONDS. Files that no manifest lists are removed by vacuum().

This holds for stores with an exclusive create and an atomic rename of a file: HDFS, POSIX file systems, and object stores
whose connector offers both. Elsewhere one writer at a time must be seen to.

Nulls, empty and very long texts, repeated rows and any extra columns are stored and read back as they are; an empty table
adds no rows, but its version.

Scale notes: a merge reads and writes each byte once and shuffles nothing: neighbouring read partitions are joined
by coalesce(). The manifest has a line for each shard, not for each row. Every row is rewritten at most once for each tier.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TARGET_BYTES = 128 << 20
FANOUT = 4
SHARD_ROWS = 2_000
#: After so long a version that was claimed and not committed is another writer's to take.
CLAIM_SECONDS = 600


class CommitConflict(RuntimeError):
    """Another writer committed the same version first."""


class Shard(NamedTuple):
    path: str
    rows: int
    bytes: int


class ShardStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # manifest

    def _file(self, version: int) -> str:
        return f"{self.root}/_manifest/{version:020d}.json"

    def version(self) -> int:
        """The newest committed version; 0 before the first commit."""
        at = self._path(f"{self.root}/_manifest")
        if not self._fs.exists(at):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        return max((int(n[:20]) for n in names if n.endswith(".json") and n[:20].isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "schema": None, "shards": []}
        stream = self._fs.open(self._path(self._file(version)))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        got = json.loads(text)
        got["shards"] = [Shard(*s) for s in got["shards"]]
        return got

    def commit(self, base: int, shards: list[Shard], schema: str) -> int:
        """Publish version base + 1. The claim keeps other writers away, the rename is the commit; it never replaces a version."""
        version = base + 1
        final = self._path(self._file(version))
        claim = self._path(f"{self.root}/_manifest/{version:020d}.claim")
        if self._fs.exists(final) or not self._claimed(claim):
            raise CommitConflict(f"version {version} is taken")
        aside = self._path(f"{self.root}/_manifest/.{version:020d}-{uuid.uuid4().hex}")
        out = self._fs.create(aside, False)
        try:
            out.write(bytearray(json.dumps({"version": version, "schema": schema, "shards": sorted(shards)}).encode()))
            out.hsync()
        finally:
            out.close()
        if self._fs.exists(final) or not self._fs.rename(aside, final):
            self._fs.delete(aside, False)
            raise CommitConflict(f"version {version} is taken")
        return version

    def _claimed(self, claim) -> bool:
        """Whether this writer made the claim; an old one is removed first, so that one writer makes it anew."""
        from py4j.protocol import Py4JJavaError

        if self._fs.exists(claim) and time.time() - self._fs.getFileStatus(claim).getModificationTime() / 1000 > CLAIM_SECONDS:
            self._fs.delete(claim, False)
        self._fs.mkdirs(claim.getParent())
        try:
            self._fs.create(claim, False).close()
        except Py4JJavaError as taken:
            if "AlreadyExists" not in str(taken.java_exception):
                raise
            return False
        return True

    # data

    def _write(self, df: DataFrame, rows_per_shard: int | None) -> list[Shard]:
        run = f"{self.root}/data/{uuid.uuid4().hex}"
        writer = df.write
        if rows_per_shard:
            writer = writer.option("maxRecordsPerFile", rows_per_shard)
        writer.parquet(run)
        sizes = {s.getPath().getName(): s.getLen() for s in self._fs.listStatus(self._path(run)) if s.getPath().getName().endswith(".parquet")}
        counted = self.spark.read.schema(df.schema).parquet(run).groupBy(F.col("_metadata.file_name").alias("f")).count().collect()
        return [Shard(f"{run}/{r.f}", r["count"], sizes[r.f]) for r in counted]

    def append(self, df: DataFrame, rows_per_shard: int = SHARD_ROWS) -> int:
        """Add the rows as small shards: no shuffle, each task writes its own. Adding no rows still commits."""
        before = self.manifest()
        return self.commit(before["version"], before["shards"] + self._write(df, rows_per_shard), df.schema.json())

    def tiers(self, shards: list[Shard], target: int = TARGET_BYTES, fanout: int = FANOUT) -> dict[int, list[Shard]]:
        """Shards still below half the target, by the whole part of the logarithm of their size."""
        out: dict[int, list[Shard]] = {}
        for s in sorted(shards):
            if s.bytes < target / 2:
                out.setdefault(int(math.log(max(s.bytes, 1), fanout)), []).append(s)
        return out

    def compact(self, target: int = TARGET_BYTES, fanout: int = FANOUT) -> list[int]:
        """Merge full tiers until none is left; the versions committed, oldest first."""
        done = []
        while True:
            now = self.manifest()
            full = {t: some for t, some in self.tiers(now["shards"], target, fanout).items() if len(some) >= fanout}
            if not full:
                return done
            some = full[min(full)]
            size, rows = sum(s.bytes for s in some), sum(s.rows for s in some)
            files = max(1, round(size / target))
            merged = self._write(self._read(some, now["schema"]).coalesce(files), None)
            if sum(s.rows for s in merged) != rows:
                raise RuntimeError(f"a merge of {rows} rows wrote {sum(s.rows for s in merged)}")
            gone = set(some)
            done.append(self.commit(now["version"], [s for s in now["shards"] if s not in gone] + merged, now["schema"]))

    def _read(self, shards: list[Shard], schema: str) -> DataFrame:
        from pyspark.sql.types import StructType

        kind = StructType.fromJson(json.loads(schema))
        if not shards:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*[s.path for s in shards])

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, the newest by default."""
        m = self.manifest(version)
        if m["schema"] is None:
            raise ValueError("nothing was committed yet")
        return self._read(m["shards"], m["schema"])

    def vacuum(self, keep: int = 1, older_than_s: float = 86_400) -> int:
        """Remove data files that none of the last ``keep`` versions lists; how many went. Files younger than ``older_than_s`` may
        belong to a writer that hasn't committed yet and stay; 0 only where there is no other writer."""
        before = (time.time() - older_than_s) * 1000 if older_than_s else math.inf
        newest = self.version()
        listed = {s.path for v in range(max(1, newest - keep + 1), newest + 1) for s in self.manifest(v)["shards"]}
        names = {"/".join(p.split("/")[-2:]) for p in listed}
        gone = 0
        data = self._path(f"{self.root}/data")
        for run in self._fs.listStatus(data) if self._fs.exists(data) else []:
            inside = self._fs.listStatus(run.getPath())
            if any(f.getModificationTime() > before for f in inside) or run.getModificationTime() > before:
                continue
            files = [f.getPath() for f in inside]
            used = [f for f in files if f"{run.getPath().getName()}/{f.getName()}" in names]
            for f in files if not used else [f for f in files if f.getName().endswith(".parquet") and f not in used]:
                gone += f.getName().endswith(".parquet")
                self._fs.delete(f, False)
            if not used:
                self._fs.delete(run.getPath(), True)
        return gone
