"""A keyed table that is merged when it is read.

An upsert or delete writes what is new, not what it replaces: one small folder of rows, marked as put or
gone. Readers leave out base rows whose key a later change holds, and take each key's last change. Rows
are dealt into buckets by key; folding writes anew only the buckets whose changes have grown large.
What counts is listed in a manifest, of which each change puts a new version in place by one rename that
fails if that version is there already; readers see one whole version.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kbspark.sources.store import latest

#: Changed rows of a bucket, as a share of its base rows, from which folding writes the bucket anew. Versions that stay readable.
FOLD_SHARE, KEPT_VERSIONS = 0.2, 10
#: Names that the store adds to rows on disk.
BUCKET, GONE = "__bucket", "__gone"


class Conflict(RuntimeError):
    """Another writer took the version."""


class MergedTable:
    """keys: columns that identify a row; repo and key, for instance. Keys that are null equal each other."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 16):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        self._jvm = spark._jvm
        self._root = self._jvm.org.apache.hadoop.fs.Path(self.path)
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._root.getFileSystem(self._conf)

    # -- versions

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def versions(self) -> list[int]:
        if not self._fs.exists(self._at("manifest")):
            return []
        return sorted(int(s.getPath().getName()[1:-5]) for s in self._fs.listStatus(self._at("manifest")) if s.getPath().getName().startswith("v"))

    def manifest(self, version: int | None = None) -> dict:
        """schema, buckets, base: {bucket: folder}, folded: {bucket: version}, deltas: [{folder, version, rows: {bucket: n}}], rows: {bucket: n} of the base."""
        known = self.versions()
        if version is None and not known:
            return {"version": 0, "schema": None, "buckets": self.buckets, "base": {}, "folded": {}, "deltas": [], "rows": {}}
        stream = self._fs.open(self._at(f"manifest/v{known[-1] if version is None else version:09d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, state: dict) -> int:
        version = state["version"] + 1
        draft = self._at(f"manifest/draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(state | {"version": version}).encode()))
        out.close()
        rename = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._root.toUri(), self._conf)
        try:
            context.rename(self._fs.makeQualified(draft), self._fs.makeQualified(self._at(f"manifest/v{version:09d}.json")), options)
        except Py4JJavaError as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExistsException" in str(e.java_exception):
                raise Conflict(f"version {version} is taken") from e
            raise
        return version

    # -- changes

    def _bucket(self, count: int) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(count)).cast("int")

    def _write(self, rows: DataFrame, count: int) -> tuple[str, dict[str, int]]:
        """A new folder of rows in buckets, and the rows of each."""
        folder = uuid.uuid4().hex
        rows.withColumn(BUCKET, self._bucket(count)).repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
        schema = rows.withColumn(BUCKET, F.lit(0)).schema
        counts = self.spark.read.schema(schema).parquet(f"{self.path}/{folder}").groupBy(BUCKET).agg(F.count("*").alias("n")).collect()  # one row for each bucket
        return folder, {str(r[BUCKET]): r.n for r in counts}

    def _change(self, rows: DataFrame) -> int:
        taken = {c.lower() for c in rows.columns} & {BUCKET}
        if taken:
            raise ValueError(f"the store has columns of its own called {sorted(taken)}")
        state = self.manifest()
        data = [f for f in rows.schema.fields if f.name != GONE]
        schema = state["schema"] or [[f.name, f.dataType.simpleString()] for f in data]
        if [[f.name, f.dataType.simpleString()] for f in data] != schema:
            raise ValueError("rows must have the table's columns")
        folder, counts = self._write(rows, state["buckets"])
        while True:
            try:
                return self._commit(state | {"schema": schema, "deltas": [*state["deltas"], {"folder": folder, "version": state["version"] + 1, "rows": counts}]})
            except Conflict:  # the rows stand as they are behind whatever came in between
                state = self.manifest()

    def _in_order(self, rows: DataFrame) -> DataFrame:
        state = self.manifest()
        return rows.select(*[name for name, _ in state["schema"]]) if state["schema"] else rows

    def upsert(self, new: DataFrame, order: list[str] | None = None) -> int:
        """Puts rows in place of those with the same keys, or adds them; of several of a key the last in order. Returns the version."""
        if {c.lower() for c in new.columns} & {BUCKET, GONE}:
            raise ValueError(f"the store has columns of its own called {BUCKET}, {GONE}")
        rows = latest(new, self.keys, order) if order else new.dropDuplicates(self.keys)
        return self._change(self._in_order(rows).withColumn(GONE, F.lit(False)))

    def delete(self, keys: DataFrame) -> int:
        """Takes away the rows with these keys; keys that no row has do no harm."""
        state = self.manifest()
        if state["schema"] is None:
            raise ValueError("nothing was stored yet")
        found = keys.select(*self.keys).distinct()
        rows = found.select(*[F.col(n) if n in self.keys else F.lit(None).cast(k).alias(n) for n, k in state["schema"]])
        return self._change(rows.withColumn(GONE, F.lit(True)))

    # -- reading

    def _parts(self, state: dict) -> tuple[DataFrame, DataFrame | None]:
        """Base rows, and the last change of each key that came after its bucket was folded."""
        kinds = ", ".join(f"`{n}` {k}" for n, k in state["schema"])
        base = self.spark.createDataFrame([], f"{kinds}, {BUCKET} int")
        folders: dict[str, list[str]] = {}
        for bucket, folder in state["base"].items():
            folders.setdefault(folder, []).append(bucket)
        for folder, buckets in folders.items():
            rows = self.spark.read.schema(f"{kinds}, {BUCKET} int").parquet(f"{self.path}/{folder}")
            base = base.unionByName(rows.filter(F.col(BUCKET).isin([int(b) for b in buckets])))
        changes = None
        for d in state["deltas"]:
            live = [int(b) for b in d["rows"] if state["folded"].get(b, 0) < d["version"]]
            if live:
                rows = self.spark.read.schema(f"{kinds}, {GONE} boolean, {BUCKET} int").parquet(f"{self.path}/{d['folder']}").filter(F.col(BUCKET).isin(live)).withColumn("__version", F.lit(d["version"]))
                changes = rows if changes is None else changes.unionByName(rows)
        if changes is not None:
            newest = Window.partitionBy(*self.keys).orderBy(F.desc("__version"))
            changes = changes.withColumn("__n", F.row_number().over(newest)).filter("__n = 1").drop("__n", "__version")
        return base, changes

    def _merged(self, state: dict) -> DataFrame:
        base, changes = self._parts(state)
        if changes is None:
            return base
        # few keys change between two foldings, so Spark has this side broadcast if it is small, and the base stays where it is
        changed = changes.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(self.keys)])
        same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(self.keys)]
        on = same[0]
        for s in same[1:]:
            on = on & s
        return base.join(changed, on, "left_anti").unionByName(changes.filter(~F.col(GONE)).drop(GONE))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows, with the columns of the first change."""
        state = self.manifest(version)
        if state["schema"] is None:
            raise ValueError("nothing was stored yet")
        return self._merged(state).drop(BUCKET)

    # -- folding

    def fold(self, share: float = FOLD_SHARE) -> list[int]:
        """Writes the buckets anew whose changes are more than `share` of their base rows. Returns these buckets.

        A change that comes in between stays a change. Versions older than KEPT_VERSIONS go, with folders
        that no kept version names; a reader must have begun on a kept one.
        """
        state = self.manifest()
        changed: dict[str, int] = {}
        for d in state["deltas"]:
            for b, n in d["rows"].items():
                if state["folded"].get(b, 0) < d["version"]:
                    changed[b] = changed.get(b, 0) + n
        due = sorted((b for b, n in changed.items() if n > share * state["rows"].get(b, 0)), key=int)
        if not due:
            return []
        upto = state["version"]
        folder, counts = self._write(self._merged(state).filter(F.col(BUCKET).isin([int(b) for b in due])).drop(BUCKET), state["buckets"])
        while True:
            now = state | {"base": {b: f for b, f in state["base"].items() if b not in due} | {b: folder for b in counts}, "rows": {b: n for b, n in state["rows"].items() if b not in due} | counts}
            now["folded"] = state["folded"] | {b: upto for b in due}
            now["deltas"] = [d for d in state["deltas"] if any(now["folded"].get(b, 0) < d["version"] for b in d["rows"])]
            try:
                self._commit(now)
                break
            except Conflict:
                before, state = state, self.manifest()
                if state["base"] != before["base"] or state["folded"] != before["folded"]:  # someone else folded: what was written is of no use
                    self._fs.delete(self._at(folder), True)
                    return []
        self._sweep()
        return [int(b) for b in due]

    def _sweep(self) -> None:
        known = self.versions()
        for v in known[:-KEPT_VERSIONS]:
            self._fs.delete(self._at(f"manifest/v{v:09d}.json"), False)
        kept = [self.manifest(v) for v in known[-KEPT_VERSIONS:]]
        named = {f for m in kept for f in (*m["base"].values(), *(d["folder"] for d in m["deltas"]))}
        oldest = self._fs.getFileStatus(self._at(f"manifest/v{known[-KEPT_VERSIONS:][0]:09d}.json")).getModificationTime()
        for status in self._fs.listStatus(self._root):
            # younger folders may belong to a change that is still to be committed
            if status.getPath().getName() not in named | {"manifest"} and status.getModificationTime() < oldest:
                self._fs.delete(status.getPath(), True)
