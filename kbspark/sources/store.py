"""Keyed tables: upsert, delete, replace, scan. All give new DataFrames; write() puts one in place."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A new folder for written tables below spark.checkpoint.dir, which driver and executors share; a folder of this machine only for a local master without that setting."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/kbspark-scratch"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


_kept: dict[tuple[str, str, tuple], str] = {}


def _version(df: DataFrame) -> tuple:
    """What stands for the contents of the files that df is read from: their names, sizes and times."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    found = []
    for name in sorted(df.inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(conf).getFileStatus(path)
        found.append((name, status.getLen(), status.getModificationTime()))
    return tuple(found)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, if it is there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def kept(spark: SparkSession, name: str, source: DataFrame, build) -> str:
    """A folder that build(folder) has filled from the files behind `source`, by this application; a new one once those files change, when the old one goes."""
    version = _version(source)
    mine = spark.sparkContext.applicationId, name, version
    if mine not in _kept:
        # one folder for each set of files, whatever became of them
        for other in [k for k in _kept if k[:2] == mine[:2] and {f[0] for f in k[2]} == {f[0] for f in version}]:
            remove(spark, _kept.pop(other))
        path = scratch(spark)
        build(path)
        _kept[mine] = path
    return _kept[mine]


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of the rows with equal keys the last in order."""
    newest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn("__n", F.row_number().over(newest)).filter("__n = 1").drop("__n")


def delete_by(base: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return base.join(keys.select(*on).distinct(), on, "left_anti")


def upsert(base: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None, replace_by: list[str] | None = None) -> DataFrame:
    """base with new rows in place of those with the same keys.

    order: of several new rows of a key the last counts. replace_by: coarser keys (such as the file)
    whose old rows all go, so that a shorter version leaves nothing behind.
    """
    fresh = latest(new, keys, order) if order else new.dropDuplicates(keys)
    return delete_by(base, fresh, replace_by or keys).unionByName(fresh.select(base.columns))


def import_snapshot(base: DataFrame, snapshot: DataFrame, mode: str = "merge", repo: str = "repo_id", name: str = "filename") -> DataFrame:
    """merge: files of the snapshot win; replace: the snapshot's repositories hold nothing else."""
    if mode not in ("merge", "replace"):
        raise ValueError(mode)
    return upsert(base, snapshot, [repo, name], replace_by=[repo] if mode == "replace" else None)


def export_snapshot(pages: DataFrame, repo_id: int) -> DataFrame:
    return pages.filter(F.col("repo_id") == repo_id).select("filename", "content").orderBy("filename")


def write(df: DataFrame, path: str, partition: str = "repo_id") -> None:
    """Replaces the partitions that df has rows of; df must not read from path."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def replace(df: DataFrame, path: str, repo_ids: list[int] | None = None) -> None:
    """Puts df in place of the given repositories' rows, or of all rows; a repository that df has no row of is emptied."""
    if repo_ids is None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("repo_id").parquet(path)
        return
    write(df, path)
    spark = df.sparkSession
    left = {r[0] for r in spark.read.parquet(path).filter(F.col("repo_id").isin(repo_ids)).join(df.select("repo_id").distinct(), "repo_id", "left_anti").select("repo_id").distinct().collect()}
    for repo in left:  # some of those that were asked for
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/repo_id={repo}")
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def scan(spark: SparkSession, path: str, repo_ids: list[int] | None = None, columns: list[str] | None = None) -> DataFrame:
    """Rows of the given partitions and columns alone."""
    rows = spark.read.parquet(path)
    rows = rows if repo_ids is None else rows.filter(F.col("repo_id").isin(repo_ids))
    return rows if columns is None else rows.select(*columns)


def cascade_delete_users(tables: dict[str, DataFrame], users: DataFrame, repos: DataFrame, nullify: tuple[str, ...] = (), repo_nullify: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Every table without what belongs to the users (user_id): their repositories with all that hangs on these, and their own rows.

    In the tables named in nullify a user's rows stay with a null user_id. tables may hold repo_id, user_id or both.
    """
    gone = users.select("user_id").distinct()
    owned = repos.join(gone, repos["owner_id"] == gone["user_id"], "left_semi").select("repo_id")
    held = {n: df for n, df in tables.items() if "repo_id" in df.columns}
    out = {**tables, **cascade_delete(held, owned, repo_nullify)}
    for name, df in out.items():
        if "user_id" not in df.columns:
            continue
        if name in nullify:
            hit = df.join(gone.withColumn("__gone", F.lit(True)), "user_id", "left")
            out[name] = hit.withColumn("user_id", F.when(F.col("__gone").isNull(), F.col("user_id"))).select(df.columns)
        else:
            out[name] = delete_by(df, gone, ["user_id"])
    return out


def cascade_delete(tables: dict[str, DataFrame], repos: DataFrame, nullify: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Every table without the rows of the repositories; in those named in nullify repo_id becomes null instead."""
    gone = repos.select("repo_id").distinct()
    out = {}
    for name, df in tables.items():
        if name in nullify:
            hit = df.join(gone.withColumn("__gone", F.lit(True)), "repo_id", "left")
            out[name] = hit.withColumn("repo_id", F.when(F.col("__gone").isNull(), F.col("repo_id"))).select(df.columns)
        else:
            out[name] = delete_by(df, gone, ["repo_id"])
    return out
