"""Exact top-k search by KD-trees, one for each shard of the vectors.

A tree splits at the median of the widest side and keeps the tight box of each node; its nodes' upper
bounds on a query's inner product come from the boxes. A search takes the node with the best bound
first and ends when no bound can beat the k-th best score so far. That score comes along from
elsewhere: each block of queries first searches one shard, and takes what it found to runs of the
others, one shard after the other.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.llm.common import discard, written

#: Vectors in a shard and in a leaf, queries in a block, shards that one task searches in turn.
SHARD_ROWS, LEAF_ROWS, BLOCK_ROWS, RUN_SHARDS = 2048, 128, 1024, 4
#: Sums of products of smaller numbers than this are exact in doubles.
EXACT = 2.0**52


class KDTree:
    """A tree over whole-number vectors; ids break ties, the smaller first."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.children: list[tuple[int, int] | None] = []
        self.rows: list[np.ndarray] = []
        low, high, least = [], [], []

        def build(rows: np.ndarray) -> int:
            node = len(low)
            part = self.vectors[rows]
            low.append(part.min(axis=0))
            high.append(part.max(axis=0))
            least.append(self.ids[rows].min())
            self.children.append(None)
            self.rows.append(rows)
            sides = high[node] - low[node]
            if len(rows) > LEAF_ROWS:
                half = len(rows) // 2
                # vectors that are all alike are split by id
                cut = np.argsort(part[:, sides.argmax()], kind="stable") if sides.max() > 0 else np.arange(len(rows))
                self.rows[node] = rows[:0]
                self.children[node] = (build(np.sort(rows[cut[:half]])), build(np.sort(rows[cut[half:]])))
            return node

        build(np.arange(len(ids)))
        self.low, self.high, self.least = np.array(low), np.array(high), np.array(least)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """(queries, nodes): no vector of the node has a larger inner product."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, query: np.ndarray, own: int, bounds: np.ndarray, best: list[tuple[float, int]], k: int) -> list[tuple[float, int]]:
        """best: (score, -id) of the k best so far, a heap. Best-first; returns the heap."""
        frontier = [(-bounds[0], 0)]
        while frontier:
            bound, node = heapq.heappop(frontier)
            if len(best) == k and -bound < best[0][0]:
                break
            if len(best) == k and (-bound, -self.least[node]) < best[0]:
                continue
            if self.children[node] is not None:
                for child in self.children[node]:
                    heapq.heappush(frontier, (-bounds[child], child))
                continue
            rows = self.rows[node]
            scores = self.vectors[rows] @ query
            near = np.flatnonzero(scores >= best[0][0]) if len(best) == k else np.arange(len(rows))
            for i in near:
                found = (scores[i], -self.ids[rows[i]])
                if -found[1] == own:
                    continue
                if len(best) < k:
                    heapq.heappush(best, found)
                elif found > best[0]:
                    heapq.heapreplace(best, found)
        return best


def _numbers(vectors: pd.Series) -> np.ndarray:
    """Doubles, if all inner products are exact in them, else Python's whole numbers."""
    out = np.array(vectors.tolist(), np.float64)
    largest = np.abs(out).max(initial=0.0)
    return out if largest * largest * out.shape[1] < EXACT else np.array([[int(x) for x in row] for row in out], object)


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    tree = KDTree(rows["id"].to_numpy(np.int64), _numbers(rows["vector"]))
    return pd.DataFrame({"dim": rows["dim"].iloc[:1], "shard": rows["shard"].iloc[:1], "tree": [pickle.dumps(tree)]})


def _search(k: int):
    def run(key, queries: pd.DataFrame, shards: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(shards):
            vectors = _numbers(queries["vector"])
            heaps = [list(zip(s, (-int(i) for i in ids))) for s, ids in zip(queries["scores"], queries["ids"])]
            for h in heaps:
                heapq.heapify(h)
            trees = [pickle.loads(t) for t in shards.sort_values("shard")["tree"]]
            for tree in trees:
                if tree.vectors.dtype == object or vectors.dtype == object or not np.abs(vectors).max(initial=0) * np.abs(tree.vectors).max() * vectors.shape[1] < EXACT:
                    vectors = np.array([[int(x) for x in row] for row in vectors], object)
                    for part in ("vectors", "low", "high"):
                        setattr(tree, part, np.array([[int(x) for x in row] for row in getattr(tree, part)], object))
                bounds = tree.bounds(vectors)
                heaps = [tree.search(vectors[i], own, bounds[i], heaps[i], k) for i, own in enumerate(queries["id"])]
            for q, had, heap in zip(queries["q"], queries["ids"], heaps):
                # all rows of an id lie in one shard
                new = [(max(-(1 << 63), min((1 << 63) - 1, int(s))), -int(i)) for s, i in heap if -i not in set(had)]
                out.append((q, [s for s, _ in new], [i for _, i in new]))
        return pd.DataFrame(out, columns=["q", "scores", "ids"])

    return run


def whole_numbers(vector: Column) -> Column:
    """floor(256 * x) of each component, as a double without a fraction."""
    finite = lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))  # noqa: E731  floor would make numbers of the others
    return F.transform(vector, lambda x: F.when(finite(x), F.floor(x.cast("double") * 256).cast("double")).otherwise(x.cast("double")))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: of each query the k vectors with the highest inner product.

    Both tables hold an id and an array of whole numbers. A query never finds rows with its own id;
    equal scores go to the smaller id. Only vectors of a query's length are compared with it. Rows
    with a null id, a null or empty vector or a component that is null or not finite take no part. Rows
    that repeat an id are candidates each; among the queries those that agree in id and vector are one
    query, and others that share an id are answered each. Scores beyond a long are cut to its range.
    Other columns play no part; an empty table gives an empty one.
    """
    fine = F.col(id_col).isNotNull() & (F.size(vector_col) > 0) & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))

    def usable(df: DataFrame) -> DataFrame:
        rows = df.filter(F.coalesce(fine, F.lit(False)))
        return rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), F.size(vector_col).alias("dim"))

    rows, asked = usable(vectors), usable(queries).withColumn("q", F.xxhash64("id", "vector")).dropDuplicates(["id", "q"])
    shards, blocks = max(1, -(-rows.count() // SHARD_ROWS)), max(1, -(-asked.count() // BLOCK_ROWS))
    runs = -(-shards // RUN_SHARDS)
    spread = F.xxhash64(F.lit(71), "id")
    trees = written(rows.withColumn("shard", F.pmod(spread, F.lit(shards)).cast("int")).groupBy("dim", "shard").applyInPandas(_build, "dim int, shard int, tree binary"))
    asked = written(asked.withColumn("block", F.pmod(spread, F.lit(blocks)).cast("int")))

    found = "q long, scores array<bigint>, ids array<bigint>"
    nothing = F.array().cast("array<bigint>")
    first = asked.withColumn("scores", nothing).withColumn("ids", nothing)
    dealt = trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    # a block's first shard; every shard serves about as many blocks
    home = F.pmod(F.xxhash64(F.lit(72), "block"), F.lit(shards)).cast("int")
    begun = first.withColumn("shard", home).groupBy("dim", "block", "shard").cogroup(
        dealt.filter(F.col("shard") == home).groupBy("dim", "block", "shard")
    ).applyInPandas(_search(k), found)
    begun = written(begun)
    told = asked.join(begun, "q", "left")
    told = told.select("q", "id", "vector", "dim", "block", F.coalesce("scores", nothing).alias("scores"), F.coalesce("ids", nothing).alias("ids"))
    told = told.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    rest = dealt.filter(F.col("shard") != home).withColumn("run", (F.col("shard") / RUN_SHARDS).cast("int"))
    ended = told.groupBy("dim", "block", "run").cogroup(rest.groupBy("dim", "block", "run")).applyInPandas(_search(k), found)
    hits = ended.unionByName(begun).join(asked.select("q", F.col("id").alias("query_id")), "q")
    hits = hits.select("q", "query_id", F.inline(F.arrays_zip(F.col("ids").alias("vec_id"), F.col("scores").alias("score"))))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    out = written(hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
    discard(trees, asked, begun)
    return out
