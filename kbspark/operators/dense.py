"""Dense search: cosine top-k by blocks of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbspark.operators.lexical import best

#: Vectors, and queries, that one task holds at a time, on average.
BLOCK_ROWS, QUERY_ROWS = 8192, 1024
#: Queries that are held against a block of vectors at once.
SLICE_ROWS = 128


def semantic_search(queries: DataFrame, page_vectors: DataFrame, k: int = 15) -> DataFrame:
    """Whole pages by cosine: the k best, without a threshold. page_vectors: (repo_id, filename, embedding)."""
    return dense_topk(queries, page_vectors.select("repo_id", F.col("filename").alias("id"), F.col("filename").alias("file"), "embedding"), k)


def with_metadata(hits: DataFrame, metadata: DataFrame, key: str = "point_id") -> DataFrame:
    """Hits with the rows that a local table holds on them; hits without one are dropped."""
    clash = [c for c in metadata.columns if c != key and c in hits.columns]
    return hits.join(metadata.drop(*clash), key)


def usable(rows: DataFrame, column: str) -> DataFrame:
    """Without vectors that are null, empty, or hold null or non-finite numbers."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(F.col(column).isNotNull() & (F.size(column) > 0) & ~bad)


def _unit(column: pa.ChunkedArray) -> np.ndarray:
    m = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def nearest(asked: pa.Table, rows: pa.Table, wide: int) -> pa.Table:
    """(repo_id, query_id, id, file, score): of each query (q, and low if it is there) the `wide` best rows (id, file, v), ties to the smaller id; none clearly below low."""
    rows = rows.select(["id", "file", "v"]).take(pc.sort_indices(rows.column("id")))
    n, at, near, scores = rows.num_rows, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    if n and asked.num_rows:
        q, v = _unit(asked.column("q")), _unit(rows.column("v"))
        low = asked.column("low").to_numpy().astype(np.float64) if "low" in asked.column_names else np.full(len(q), np.nan)
        low = np.where(np.isnan(low), -np.inf, low - 1e-9)
        for begin in range(0, len(q), SLICE_ROWS):
            score = q[begin : begin + SLICE_ROWS] @ v.T
            kept = score >= low[begin : begin + SLICE_ROWS, None]
            if n > wide and kept.sum(axis=1).max() > wide:
                least = np.partition(score, n - wide, axis=1)[:, n - wide, None]
                most, same = score > least, score == least
                kept &= most | same & (np.cumsum(same, axis=1) <= wide - most.sum(axis=1, keepdims=True))
            r, c = np.nonzero(kept)
            at.append(r + begin)
            near.append(c)
            scores.append(score[r, c])
    at, near = pa.array(np.concatenate(at)), pa.array(np.concatenate(near))
    return pa.table([asked.column("repo_id").take(at), asked.column("query_id").take(at), rows.column("id").take(near), rows.column("file").take(near), pa.array(np.concatenate(scores))], names=["repo_id", "query_id", "id", "file", "score"])


def block_topk(queries: DataFrame, vectors: DataFrame, keys: list[str], wide: int, exclude_self: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(repo_id, query_id, id, file, score): of each query and block of vectors the best `wide` by cosine, among those with equal keys.

    queries: (keys, query_id, q), and low, a score that a hit must reach, or null; vectors: (keys, id, file, v);
    `repo_id` is one of the keys. The rows of a key are dealt into blocks by their number, and each pair of a
    query block and a vector block is one task.
    """
    count = lambda rows, most, name: rows.groupBy(*keys).agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    blocks = F.broadcast(count(queries, QUERY_ROWS, "nq").join(count(vectors, block_rows, "nv"), keys))  # one small row for each key
    left = queries.join(blocks, keys).withColumn("qb", F.pmod(F.xxhash64("query_id"), F.col("nq")).cast("int")).withColumn("vb", F.explode(F.sequence(F.lit(0), F.col("nv") - 1))).drop("nq", "nv")
    right = vectors.join(blocks, keys).withColumn("vb", F.pmod(F.xxhash64("id"), F.col("nv")).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("nq") - 1))).drop("nq", "nv")

    kind = lambda rows, c: rows.schema[c].dataType.simpleString()
    schema = f"repo_id {kind(queries, 'repo_id')}, query_id {kind(queries, 'query_id')}, id {kind(vectors, 'id')}, file {kind(vectors, 'file')}, score double"
    deal = [*keys, "qb", "vb"]
    # both sides may come from one table: their columns get identities of their own
    left, right = (rows.select(*[F.col(c).alias(c) for c in rows.columns]) for rows in (left, right))
    hits = left.groupBy(*deal).cogroup(right.groupBy(*deal)).applyInArrow(lambda a, b: nearest(a, b, wide + exclude_self), schema)
    return hits.filter("id != query_id") if exclude_self else hits


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int, threshold: float | None = None, per_file: int | None = None, oversample: int = 1, exclude_self: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(repo_id, query_id, id, file, score, rank) by cosine.

    queries: (repo_id, query_id, embedding); vectors: (repo_id, id, file, embedding). The best
    k * oversample are cut by threshold, then by per_file, then to k. Every vector of a query's repository
    is read; ivf.ivf_topk() reads the near ones.
    """
    wide = k * oversample
    left = usable(queries, "embedding").select("repo_id", "query_id", F.col("embedding").alias("q"))
    right = usable(vectors, "embedding").select("repo_id", "id", "file", F.col("embedding").alias("v"))
    hits = best(block_topk(left, right, ["repo_id"], wide, exclude_self, block_rows), wide).drop("rank")
    hits = hits if threshold is None else hits.filter(F.col("score") >= threshold)
    if per_file:
        in_file = Window.partitionBy("repo_id", "query_id", "file").orderBy(F.desc("score"), "id")
        hits = hits.withColumn("__n", F.row_number().over(in_file)).filter(F.col("__n") <= per_file).drop("__n")
    return best(hits, k)
