"""Sharding by size-tiered compaction, with a versioned manifest.

Arrivals are appended as runs: folders of small immutable Parquet files. Runs of similar
size (within a factor fan_in) form a tier; when a tier holds fan_in runs, they are merged
into one run with files of target size. A run whose files have about target size is sealed
and is merged no more. DataFrame functions only: a merge reads whole files side by side and
writes them as one, without a shuffle.

Every change commits a version. A version is a small file that names a manifest table, and
it is renamed into place without overwriting: where the store renames atomically (HDFS), the
second of two writers from one base fails and tries again on the new base. On a local disk
that holds for the threads of one process. A vacuum empties the files of old versions but
leaves their names, so a writer is refused however old its base is. A reader sees the last
committed version, never a half-made change, and what it reads stays until a vacuum: the last
KEEP versions keep all their files. All runs have the columns of the first.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framegate.llm.common import free_name

FAN_IN = 4
SMALL_BYTES = 1 << 20
TARGET_BYTES = 128 << 20
KEEP = 20
TRIES = 50
SEALED = -1
MANIFEST = "run string, tier int, bytes long, n_files long, n_rows long, version long, columns string"
_one_process = threading.Lock()


class Conflict(RuntimeError):
    """Another writer committed the version first."""


@dataclass
class ShardTable:
    """A table of shards under one folder, which driver and executors share."""

    spark: SparkSession
    path: str
    small_bytes: int = SMALL_BYTES
    target_bytes: int = TARGET_BYTES
    fan_in: int = FAN_IN
    keep: int = KEEP

    # -- versions ---------------------------------------------------------------------

    def _fs(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        where = hadoop.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _place(self, version: int) -> str:
        return f"{self.path}/versions/v{version:09d}"

    def versions(self) -> list[int]:
        """The committed versions that no vacuum has removed."""
        fs, where = self._fs(f"{self.path}/versions")
        if not fs.exists(where):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(where) if s.getLen()]
        return sorted(int(n[1:]) for n in names if n.startswith("v"))

    def version(self) -> int:
        """The last committed version; 0 before the first."""
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """One row a run of a version (the last). Its size follows the number of runs."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        folder = self.spark.read.text(self._place(version)).first()[0]
        return self.spark.read.schema(MANIFEST).parquet(folder)

    def commit(self, manifest: DataFrame, base: int) -> int:
        """Makes manifest version base + 1, or raises Conflict where that exists."""
        jvm, name = self.spark._jvm, uuid.uuid4().hex
        folder, aside = f"{self.path}/manifests/{name}", f"{self.path}/aside/{name}"
        manifest.coalesce(1).write.parquet(folder)
        fs, source = self._fs(aside)
        out = fs.create(source)
        out.write(bytearray(f"{folder}\n".encode()))
        out.close()
        _, place = self._fs(self._place(base + 1))
        fs.mkdirs(place.getParent())
        hadoop = jvm.org.apache.hadoop.fs
        keep_old = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
        keep_old[0] = hadoop.Options.Rename.NONE
        context = hadoop.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            with _one_process:
                context.rename(source, place, keep_old)
        except Py4JJavaError as e:
            if not fs.exists(place):
                raise
            fs.delete(source, False)
            fs.delete(self._fs(folder)[1], True)
            raise Conflict(f"version {base + 1} was committed by another writer") from e
        return base + 1

    def _settled(self, change: Callable[[DataFrame, int], DataFrame | None]) -> int:
        """Commits change(manifest, its version), anew on each newer version until no other
        writer comes first. No change (None) commits nothing."""
        for _ in range(TRIES):
            base = self.version()
            new = change(self.manifest(base), base)
            if new is None:
                return base
            try:
                return self.commit(new, base)
            except Conflict:
                continue
        raise Conflict(f"other writers came first {TRIES} times")

    # -- writes -----------------------------------------------------------------------

    def _described(self, runs: list[str]) -> DataFrame:
        """Manifest rows of the runs that hold rows, from Spark's own file metadata; no
        version yet."""
        size, file = F.col("_metadata.file_size"), F.col("_metadata.file_path")
        found = None
        for run in runs:
            per = self.spark.read.parquet(run).select(file.alias("file"), size.alias("size")).groupBy("file").agg(F.first("size").alias("size"), F.count("*").alias("n"))
            one = per.agg(F.sum("size").alias("bytes"), F.count("*").alias("n_files"), F.sum("n").alias("n_rows")).select(F.lit(run).alias("run"), "*")
            kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.spark.read.parquet(run).schema)
            one = one.withColumn("columns", F.lit(kinds))
            found = one if found is None else found.unionByName(one)
        steps = F.floor(F.log(float(self.fan_in), F.greatest(F.col("bytes") / self.small_bytes, F.lit(1.0))))
        sealed = F.col("bytes") >= F.col("n_files") * (self.target_bytes / 2)
        return found.filter("n_files > 0").withColumn("tier", F.when(sealed, SEALED).otherwise(steps).cast("int"))

    def _added(self, runs: list[str], without: list[str] = ()) -> int:
        made = self._described(runs).collect()  # a row a run
        if not made:
            return self.version()
        schema = "run string, bytes long, n_files long, n_rows long, columns string, tier int"
        rows = self.spark.createDataFrame(made, schema)
        added = False

        def change(now: DataFrame, base: int) -> DataFrame | None:
            nonlocal added
            added = not without or now.filter(F.col("run").isin(list(without))).count() == len(without)
            if not added:
                return None  # another writer has merged some of them
            others = {r[0] for r in now.select("columns").distinct().collect()} - {r["columns"] for r in made}
            if others:
                raise ValueError(f"the table has other columns: {others.pop()}")
            left = now.filter(~F.col("run").isin(list(without))) if without else now
            return left.unionByName(rows.withColumn("version", F.lit(base + 1).cast("long")))

        done = False
        try:
            at = self._settled(change)
            done = added
            return at
        finally:
            if not done:
                for run in runs:
                    self._remove(run)

    def _remove(self, path: str) -> None:
        fs, where = self._fs(path)
        fs.delete(where, True)

    def append(self, rows: DataFrame) -> int:
        """Adds arrivals as they are dealt out: a run with a file a task. No rows, no new
        version. All columns are kept, null rows, repeated rows and long texts included; rows
        with other columns than the table's are an error and leave nothing behind."""
        run = f"{self.path}/data/{uuid.uuid4().hex}"
        rows.write.parquet(run)
        return self._added([run])

    def append_each(self, rows: DataFrame, arrival: str) -> int:
        """Adds rows in one pass over them as several arrivals, a run for each value of the
        column arrival (which is kept), in the order of values, null first. The values must be few."""
        folder, part = f"{self.path}/data/{uuid.uuid4().hex}", free_name("arrival_part", rows)
        values = sorted((r[0] for r in rows.select(F.col(arrival)).distinct().collect()), key=lambda v: (v is not None, v))
        at = F.array_position(F.array(*[F.lit(v) for v in values if v is not None]), F.col(arrival)) if any(v is not None for v in values) else F.lit(0)
        rows.withColumn(part, F.coalesce(at, F.lit(0)).cast("int")).write.partitionBy(part).parquet(folder)
        fs, where = self._fs(folder)
        runs = [s.getPath() for s in fs.listStatus(where) if s.isDirectory()]
        runs = [p.toString() for p in sorted(runs, key=lambda p: int(p.getName().split("=")[1]))]
        at = self.version()
        for run in runs:
            at = self._added([run])
        return at

    def compact(self, everything: bool = False) -> int:
        """Merges each tier of fan_in runs or more (everything: all runs that are not sealed),
        from the smallest, until none is left, one commit a merge. Only names of one tier's
        runs reach the driver. Ends with a vacuum."""
        while True:
            now = self.manifest().filter(F.col("tier") != SEALED)
            if everything:
                now = now.withColumn("tier", F.lit(0))
            per = now.groupBy("tier").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.sum("n_files").alias("n_files"))
            made = F.greatest(F.lit(1), F.round(F.col("bytes") / self.target_bytes)).cast("int")
            many = F.col("n") >= (1 if everything else self.fan_in)
            full = per.withColumn("made", made).filter(many & ((F.col("n") > 1) | (F.col("made") < F.col("n_files"))))
            first = full.orderBy("tier").limit(1).collect()
            if not first:
                break
            runs = [r[0] for r in now.filter(F.col("tier") == first[0]["tier"]).select("run").orderBy("version", "run").collect()]
            run = f"{self.path}/data/{uuid.uuid4().hex}"
            self.spark.read.parquet(*runs).coalesce(first[0]["made"]).write.parquet(run)
            self._added([run], without=runs)
            if everything:
                break
        self.vacuum()
        return self.version()

    def vacuum(self, keep: int | None = None) -> None:
        """Removes runs that only versions before the last keep name, then these versions.
        Older readers lose their files; what a writer has not committed yet is in none of
        them and stays."""
        versions = self.versions()
        old, kept = versions[: -(keep or self.keep)], versions[-(keep or self.keep) :]
        if not old:
            return
        named = self.manifest(kept[0]).select("run")
        for v in kept[1:]:
            named = named.union(self.manifest(v).select("run"))
        gone = self.manifest(old[0]).select("run")
        for v in old[1:]:
            gone = gone.union(self.manifest(v).select("run"))
        for (run,) in gone.distinct().join(named, "run", "left_anti").toLocalIterator():
            self._remove(run)
        for v in old:
            folder = self.spark.read.text(self._place(v)).first()[0]
            fs, place = self._fs(self._place(v))
            fs.create(place, True).close()  # empty: the name stays taken
            self._remove(folder)

    # -- reads ------------------------------------------------------------------------

    def read(self, version: int | None = None, shard_file: str | None = None) -> DataFrame | None:
        """The rows of a version (the last), or None before any; with shard_file, also the
        file of each, in a column of that name. Where the table has such a column, that one
        stays and the file's name gets _ after it. Names of runs reach the driver."""
        runs = [r[0] for r in self.manifest(version).select("run").orderBy("version", "run").collect()]
        if not runs:
            return None
        rows = self.spark.read.parquet(*runs)
        return rows.withColumn(free_name(shard_file, rows), F.col("_metadata.file_path")) if shard_file else rows
