"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from functools import cache

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of the contracts: blank and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of rows that Spark hands to a Python worker at once, unless one row is larger.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share.

    Only where that setting is missing (local tests) a folder of this machine serves.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/kbspark-checkpoints"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, by: str | None = None) -> DataFrame:
    """The rows of df as a table in the shared folder (in folders by the column `by`): computed once, with no lineage behind it."""
    path = shared_dir(df.sparkSession)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kbspark_folder = path
    return out


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of jobs that are over.

    It does so when the driver's garbage collector finds that nothing refers to them, which on a driver with
    memory to spare may be long after. The scheduler holds on to its last job, so a tiny one comes first.
    """
    gc.collect()
    spark.range(1).count()
    spark._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Deletes what written() wrote, once nothing that is still to be computed reads it."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.kbspark_folder)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores in front until df has no such column, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


@cache
def _trim():
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def in_arrow(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(run, schema) with batches of BATCH_BYTES; a worker gives its free memory back when a task ends.

    The session keeps the batch size, which Spark reads when the rows are computed.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if _trim() is not None:
                _trim()(0)

    return df.mapInArrow(tidy, schema)


#: Keys with more than this share of all rows are hot, so there are as many at most; tasks that each of them is spread over.
HOT_KEYS, SALTS = 100_000, 64


def salted_join(rows: DataFrame, keyed: DataFrame, key: str, spread: Column, hashed: bool = False) -> DataFrame:
    """Inner join of rows with the written table `keyed`: one row for each key, with n, the number of its rows (about).

    The rows of a hot key are spread over SALTS tasks by `spread`; keys that have more than one in
    HOT_KEYS of the rows are few, so they are broadcast. hashed: a partition of `keyed` fits a task's
    memory, so it is looked up there and the rows need not be sorted.
    """
    total = keyed.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") > max(1000, total // HOT_KEYS)
    salts = F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    listed = F.broadcast(keyed.filter(hot).select(F.col(key).alias("__hot")))
    salted = rows.join(listed, F.col(key) == F.col("__hot"), "left")
    salted = salted.withColumn("__salt", F.when(F.col("__hot").isNull(), F.lit(0)).otherwise(F.pmod(spread, F.lit(SALTS)).cast("int"))).drop("__hot")
    looked_up = keyed.withColumn("__salt", F.explode(salts))
    return salted.join(looked_up.hint("shuffle_hash") if hashed else looked_up, [key, "__salt"]).drop("__salt")


def ascii_lower(text):
    """Lower-cases A to Z alone, whatever the locale or script."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def slices(batches, column: int, max_bytes: int = 1 << 20):
    """Cuts Arrow batches so that the texts of one piece hold max_bytes at most, or are a single row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, n in enumerate(lengths):
            if i > start and total + n > max_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        yield batch.slice(start)
