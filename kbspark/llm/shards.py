"""Sharded storage with size-tiered compaction.

Arrivals are appended as small immutable Parquet files. Compaction merges runs of files of a similar
size into files of about the target size. What counts is listed in a manifest; each change writes a
new version of it, put in place by one rename that fails if that version is there already. So readers
see a whole version or none, and writers that lose a race find out.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JError, Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Of a file's whole path, what a shard's path holds: folder, partition and name.
_PLACE = r"([^/]+/[^/]+/[^/]+)$"
TARGET_BYTES, FAN_IN, LEAST_BYTES = 128 << 20, 4, 64 << 10
#: Files that one pass merges, and entries of a manifest that are broadcast (of about 150 bytes), at most.
PASS_FILES = 50_000
#: A pass merges about this part of the store: the disk holds the store, that part merged, and the shuffles of the last passes.
PASS_PARTS = 4


class CommitConflict(RuntimeError):
    """Another writer has committed this version."""


@dataclass(frozen=True)
class Shard:
    path: str  # below the store's data folder
    rows: int
    bytes: int

    def tier(self) -> int:
        """Files of one tier differ in size by less than FAN_IN times."""
        return max(0, math.floor(math.log(max(self.bytes, 1) / LEAST_BYTES, FAN_IN)))


def _place():
    return F.regexp_extract(F.col("_metadata.file_path"), _PLACE, 1)


def _listed(listing: DataFrame, n: int) -> DataFrame:
    """A listing of n files, broadcast if it is short enough."""
    return F.broadcast(listing) if n <= PASS_FILES else listing


class ShardStore:
    """A table of documents in a folder that Spark can read and write."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._root = self._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    # -- manifest

    def version(self) -> int:
        """The last version; 0 if nothing was committed."""
        if not self._fs.exists(self._at("manifest")):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at("manifest"))]
        return max([0, *(int(n[1:-5]) for n in names if n.startswith("v"))])

    def shards(self, version: int | None = None) -> list[Shard]:
        version = self.version() if version is None else version
        if not version:
            return []
        stream = self._fs.open(self._at(f"manifest/v{version:09d}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [Shard(**s) for s in json.loads(text)["shards"]]

    def commit(self, base: int, shards: list[Shard]) -> int:
        """Puts version base + 1 in place, or raises CommitConflict."""
        draft = self._at(f"manifest/.{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps({"version": base + 1, "shards": [asdict(s) for s in shards]}).encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        options[0] = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename").NONE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._root.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(self._fs.makeQualified(draft), self._fs.makeQualified(self._at(f"manifest/v{base + 1:09d}.json")), options)
        except Py4JJavaError as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExistsException" in str(e.java_exception):
                raise CommitConflict(f"version {base + 1} is taken") from e
            raise
        return base + 1

    # -- data

    def _write(self, df: DataFrame, by: str, folder: str) -> dict[str, list[Shard]]:
        """Writes df into a new folder; the files by the value of the column `by`."""
        df.write.partitionBy(by).parquet(f"{self.path}/data/{folder}")
        files = self._files(folder)
        rows = {}
        if files:
            counted = self.spark.read.parquet(f"{self.path}/data/{folder}").groupBy(_place().alias("f")).count()
            rows = {r[0]: r[1] for r in counted.collect()}
        out: dict[str, list[Shard]] = {}
        for group, name, size in files:
            path = f"{folder}/{by}={group}/{name}"
            out.setdefault(group, []).append(Shard(path, rows.get(path, 0), size))
        return out

    def _files(self, folder: str) -> list[tuple[str, str, int]]:
        out = []
        for part in self._fs.listStatus(self._at(f"data/{folder}")):
            if "=" in part.getPath().getName():
                out += [(part.getPath().getName().split("=", 1)[1], f.getPath().getName(), f.getLen()) for f in self._fs.listStatus(part.getPath()) if f.getPath().getName().endswith(".parquet")]
        return sorted(out)

    def append(self, df: DataFrame, batch=None) -> int:
        """Adds the rows of df as new files. batch: a column; each of its values becomes a version of its own, in order."""
        version = self.version()
        for _, shards in sorted(self._write(df.withColumn("__batch", F.lit(0) if batch is None else batch), "__batch", uuid.uuid4().hex).items()):
            version = self._add(shards)
        return version

    def _add(self, shards: list[Shard]) -> int:
        """Commits the files on top of whatever is the last version."""
        while True:
            base = self.version()
            try:
                return self.commit(base, [*self.shards(base), *shards])
            except CommitConflict:
                continue

    def plan(self, target_bytes: int = TARGET_BYTES, version: int | None = None) -> list[list[Shard]]:
        """Runs of FAN_IN or more files of one tier, each run up to the target size."""
        tiers: dict[int, list[Shard]] = {}
        for s in self.shards(version):
            if s.bytes < target_bytes / 2:
                tiers.setdefault(s.tier(), []).append(s)
        runs: list[list[Shard]] = []
        for _, shards in sorted(tiers.items()):
            run: list[Shard] = []
            for s in sorted(shards, key=lambda x: (x.bytes, x.path)):
                if run and sum(x.bytes for x in run) + s.bytes > target_bytes:
                    runs.append(run)
                    run = []
                run.append(s)
            runs.append(run)
        return [r for r in runs if len(r) >= FAN_IN or sum(x.bytes for x in r) >= target_bytes / 2 and len(r) > 1]

    def compact(self, target_bytes: int = TARGET_BYTES, keep_old: bool = False) -> int:
        """Merges until no tier has a run left. Returns the version.

        A pass plans from one version, merges runs of 1 / PASS_PARTS of its bytes in one job and commits on
        that version; the merged files' inputs are deleted before the next pass. If another writer has
        committed meanwhile, what the pass wrote is deleted and it is planned anew.
        """
        while True:
            base = self.version()
            runs = self._pass(self.plan(target_bytes, base), sum(s.bytes for s in self.shards(base)) // PASS_PARTS)
            if not runs:
                return base
            folder = uuid.uuid4().hex
            try:
                self._merge(base, runs, folder)
            except (CommitConflict, PySparkException, Py4JError):
                self._fs.delete(self._at(f"data/{folder}"), True)
                if self.version() == base:  # nobody else has changed or deleted anything
                    raise
                continue
            if not keep_old:
                for s in (s for run in runs for s in run):
                    self._fs.delete(self._at(f"data/{s.path}"), False)

    @staticmethod
    def _pass(runs: list[list[Shard]], most_bytes: int) -> list[list[Shard]]:
        """The first of the runs: one at least, of most_bytes and PASS_FILES in all at most."""
        n = files = size = 0
        for run in runs:
            files, size = files + len(run), size + sum(s.bytes for s in run)
            if n and (files > PASS_FILES or size > most_bytes):
                break
            n += 1
        return runs[:n]

    def _merge(self, base: int, runs: list[list[Shard]], folder: str) -> int:
        """Writes each run as one file, by a task of its own, and commits on the version `base`."""
        place = [(s.path, i) for i, run in enumerate(runs) for s in run]
        groups = _listed(self.spark.createDataFrame(place, "__file string, __run int"), len(place))
        old = {s for run in runs for s in run}
        rows = self.spark.read.parquet(*[f"{self.path}/data/{s.path}" for s in sorted(old, key=lambda s: s.path)]).withColumn("__file", _place())
        merged = self._write(rows.join(groups, "__file").drop("__file").repartitionById(len(runs), "__run"), "__run", folder)
        return self.commit(base, [*(s for s in self.shards(base) if s not in old), *(s for run in merged.values() for s in run)])

    def read(self, version: int | None = None) -> DataFrame | None:
        """All rows of a version, with __shard (its number in the manifest) and __shard_rows; None if it has no file."""
        shards = self.shards(version)
        if not shards:
            return None
        listed = _listed(self.spark.createDataFrame([(s.path, i, s.rows) for i, s in enumerate(shards)], "__file string, __shard int, __shard_rows long"), len(shards))
        rows = self.spark.read.parquet(*[f"{self.path}/data/{s.path}" for s in shards]).withColumn("__file", _place())
        return rows.join(listed, "__file").drop("__file")


def store_documents(docs: DataFrame, path: str, arrivals: int = 6, target_bytes: int = TARGET_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Appends docs as `arrivals` batches (by id), compacts them, and reads the store back.

    One row for each row of docs: doc_id, text_sha256, shard, shard_rows, version. Every row and column
    is stored as it is, nulls and repeated rows included; a null text has a null digest. An empty table
    gives an empty one. Columns whose names begin with __ are the store's own.
    """
    store = ShardStore(docs.sparkSession, path)
    batch = F.pmod(F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(0)), F.lit(arrivals))
    store.append(docs, batch)
    version = store.compact(target_bytes)
    rows = store.read(version)
    if rows is None:
        rows = docs.limit(0).withColumns({"__shard": F.lit(0), "__shard_rows": F.lit(0).cast("long")})
    return rows.select(F.col(id_col).alias("doc_id"), F.sha2(F.col(text_col).cast("binary"), 256).alias("text_sha256"), F.col("__shard").alias("shard"), F.col("__shard_rows").alias("shard_rows"), F.lit(version).alias("version"))
