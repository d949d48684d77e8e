"""Vectors that say the same: groups by cosine, found by sign hashes with several probes and checked exactly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.operators.dense import usable
from kbspark.sources.store import remove, scratch

#: Bands of sign bits, and bits next to a plane that are also tried flipped; vectors of a bucket that one task compares at once.
BANDS, FLIPS, BLOCK_ROWS = 12, 3, 1000


def components(edges: DataFrame, path: str) -> DataFrame:
    """(node, label): for each node of edges (a, b) the least node in reach. Every round is written below path, so lineage stays short.

    A round takes the least label around a node, then that label's own label: rounds grow with the
    logarithm of a chain's length.
    """
    spark = edges.sparkSession
    edges.select("a", "b").union(edges.select("b", "a")).distinct().write.parquet(f"{path}/edges")
    both, i = spark.read.parquet(f"{path}/edges"), 0
    both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")).select("node", "label").write.parquet(f"{path}/0")
    while True:
        labels = spark.read.parquet(f"{path}/{i}")
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        told = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        i += 1
        told.join(up, "label").select("node", "old", F.least("label", "up").alias("label")).write.parquet(f"{path}/{i}")
        now = spark.read.parquet(f"{path}/{i}")
        if now.filter("old != label").isEmpty():
            return now.select("node", "label")


def _bits(total: int) -> int:
    """Bits of a band: a bucket holds a few vectors on average."""
    return int(np.clip(round(np.log2(max(total, 1))) - 2, 4, 24))


def _linked(width: int, threshold: float):
    """Of rows (scope, code, i, j, block, kind, v), those of a bucket and pair of blocks side by side: a spanning forest (a, b) of each bucket's near pairs.

    Buckets are small and many, so a task goes through those of a batch one after the other; only the last one waits for the next batch.
    """

    def forest(m, kinds, left, right, out):
        near = m[left] @ m[right].T >= threshold
        if left is right:
            if np.count_nonzero(near) == np.count_nonzero(near.diagonal()):
                return
            near = np.triu(near, 1)
        parent = {}

        def top(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        a, b = np.nonzero(near)
        for x, y in zip(left[a].tolist(), right[b].tolist()):
            u, w = top(x), top(y)
            if u != w:
                parent[u] = w
                out.append((kinds[x], kinds[y]))

    def links(rows: pa.RecordBatch, ends: list[int]) -> pa.RecordBatch:
        m = rows.column(6).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        i, j, block, kinds = (rows.column(c).to_numpy() for c in (2, 3, 4, 5))
        every, same, out = np.arange(len(m)), (i == j).tolist(), []
        for begin, end in zip([0, *ends], ends):
            if end - begin > 1:
                part = every[begin:end]
                here = block[begin:end]
                forest(m, kinds, part if same[begin] else part[here == i[begin]], part if same[begin] else part[here == j[begin]], out)
        return pa.RecordBatch.from_pydict({"a": [int(x) for x, _ in out], "b": [int(y) for _, y in out]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    def run(batches):
        held = None
        for batch in batches:
            rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0] if held.num_rows + batch.num_rows else batch
            new = np.zeros(max(rows.num_rows - 1, 0), bool)
            for c in range(4):
                new |= pc.not_equal(rows.column(c)[1:], rows.column(c)[:-1]).to_numpy(zero_copy_only=False)
            ends = (np.flatnonzero(new) + 1).tolist()
            if ends:
                yield links(rows.slice(0, ends[-1]), ends)
            held = rows.slice(ends[-1] if ends else 0)
        if held is not None and held.num_rows:
            yield links(held, [held.num_rows])

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.9, across: bool = True, bands: int = BANDS, flips: int = FLIPS) -> DataFrame:
    """(repo_id, id, group_repo, group_id, members): groups of two or more vectors that are connected by cosines of `threshold` or more.

    vectors: (repo_id, id, embedding). A group has the name of its least (repo_id, id); across says that groups
    may span repositories. Vectors that are null or hold null or non-finite numbers take no part. Links
    are checked on the vectors; a pair at the threshold can be missed where no band brings it together
    (tests allow 3 in 100 of pairs that nothing else connects). Equal vectors are compared once; a
    bucket of many is compared block by block, and a task hands on a spanning forest, not all pairs.
    """
    spark = vectors.sparkSession
    path = scratch(spark)
    rows = usable(vectors, "embedding").select("repo_id", "id", F.col("embedding").cast("array<float>").alias("v"), (F.lit(0) if across else F.col("repo_id")).alias("scope"))
    rows.withColumn("key", F.md5(F.to_json(F.struct("scope", "v")).cast("binary"))).write.parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    kinds = rows.groupBy("key").agg(F.first("scope").alias("scope"), F.first("v").alias("v"))
    kinds.withColumn("kind", F.monotonically_increasing_id()).write.parquet(f"{path}/kinds")
    kinds = spark.read.parquet(f"{path}/kinds")
    total = kinds.count()
    width = rows.select(F.size("v")).first()[0] if total else 1
    bits = _bits(total)
    planes = np.random.default_rng(23).normal(size=(width, bands * bits))
    scope = rows.schema["scope"].dataType.simpleString()

    def hash_signs(batches):
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            m = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
            side = (m @ planes).reshape(len(m), bands, bits)
            code = ((side > 0) * weights).sum(axis=2)
            near = np.argsort(np.abs(side), axis=2, kind="stable")[:, :, :flips]
            tried = np.concatenate([code[:, :, None], code[:, :, None] ^ weights[near]], axis=2) + (np.arange(bands)[None, :, None] << bits)
            ends = pa.array(np.arange(len(m) + 1, dtype=np.int32) * (tried.size // max(len(m), 1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, pa.array(tried.ravel()))], names=["kind", "scope", "v", "codes"])

    kinds.select("kind", "scope", "v").mapInArrow(hash_signs, f"kind bigint, scope {scope}, v array<float>, codes array<bigint>").write.parquet(f"{path}/codes")
    members = spark.read.parquet(f"{path}/codes").select("scope", F.explode("codes").alias("code"), "kind", "v")
    many = members.groupBy("scope", "code").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK_ROWS).withColumn("blocks", F.ceil(F.col("n") / BLOCK_ROWS).cast("int"))
    many.write.parquet(f"{path}/many")
    many = spark.read.parquet(f"{path}/many").select("scope", "code", "blocks")
    dealt = members.join(many, ["scope", "code"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("kind"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, "block").alias("i"), F.greatest(o, "block").alias("j")))
    by = ["scope", "code", "i", "j"]
    dealt = dealt.select("scope", "code", "kind", "v", "block", F.inline(pairs)).select(*by, "block", "kind", "v").repartition(*by).sortWithinPartitions(*by)
    dealt.mapInArrow(_linked(width, threshold), "a bigint, b bigint").distinct().write.parquet(f"{path}/links")
    links = spark.read.parquet(f"{path}/links")
    labels = components(links, f"{path}/rounds")
    named = rows.select("repo_id", "id", "key").join(kinds.select("key", "kind"), "key")
    named = named.join(labels, F.col("kind") == F.col("node"), "left").withColumn("label", F.coalesce("label", "kind"))
    groups = named.groupBy("label").agg(F.min(F.struct("repo_id", "id")).alias("first"), F.count("*").alias("members")).filter("members > 1")
    out = named.join(groups, "label").select("repo_id", "id", F.col("first.repo_id").alias("group_repo"), F.col("first.id").alias("group_id"), "members")
    out.write.parquet(f"{path}/out")
    for part in ("rows", "kinds", "codes", "many", "links", "rounds"):
        remove(spark, f"{path}/{part}")
    return spark.read.parquet(f"{path}/out")
