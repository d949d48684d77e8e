"""Dense search by an inverted file: vectors are stored by the cell of their nearest centre, and a query reads the cells near it.

The centres are fitted on a bounded sample; every vector is stored. A cell keeps the widest angle
between its centre and its vectors, which bounds what a query can find there: with `exact`, cells
follow until no bound reaches the k-th best score, so the rows are those of a full search.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kbspark.operators.dense import block_topk, usable
from kbspark.operators.lexical import best
from kbspark.sources.store import scratch

#: Vectors that the centres are fitted on, and numbers in them, at most; numbers in all centres, at most.
SAMPLE_ROWS, SAMPLE_NUMBERS, CENTRE_NUMBERS = 20_000, 4 << 20, 4 << 20
MOST_CELLS, ROUNDS = 4096, 12
#: Vectors that are held against all centres at once.
SLICE_ROWS = 1024
#: Vectors of a cell that are written by one task, on average.
FILE_ROWS = 200_000


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def fit_centres(sample: np.ndarray, n_cells: int, rounds: int = ROUNDS, seed: int = 3) -> np.ndarray:
    """Spherical k-means; the first centres are drawn one by one, each far from those before. An empty cell takes the vector that fits its own centre worst."""
    rows, rng = unit(sample), np.random.default_rng(seed)
    centres = rows[[rng.integers(len(rows))]]
    near = rows @ centres[0]
    while len(centres) < min(n_cells, len(rows)):
        far = np.maximum(1 - near, 0) + 1e-12
        i = rng.choice(len(rows), p=far / far.sum())
        centres = np.vstack([centres, rows[i]])
        near = np.maximum(near, rows @ rows[i])
    for _ in range(rounds):
        scores = rows @ centres.T
        cell, fit = scores.argmax(axis=1), scores.max(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, rows)
        for c in np.flatnonzero(np.bincount(cell, minlength=len(centres)) == 0):
            sums[c] = rows[fit.argmin()]
            fit[fit.argmin()] = 1
        centres = unit(sums)
    return centres


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(values) != width * len(column):
        raise ValueError(f"vectors of {width} numbers are expected")
    return values.reshape(-1, width)


@dataclass(frozen=True)
class Ivf:
    """cells: (repo_id, id, file, v, cell), in folders by cell; centres: (cell, centre, least), least being the smallest cosine of a member."""

    cells: DataFrame
    centres: DataFrame

    @staticmethod
    def read(spark: SparkSession, path: str) -> Ivf:
        return Ivf(spark.read.parquet(f"{path}/cells"), spark.read.parquet(f"{path}/centres"))


def build_ivf(vectors: DataFrame, path: str, n_cells: int | None = None) -> Ivf:
    """Writes the index of vectors (repo_id, id, file, embedding). Vectors that are null or hold null or non-finite numbers take no part; others must have equal lengths.

    About as many cells as the square root of the number of vectors, MOST_CELLS and CENTRE_NUMBERS
    permitting. A large cell is written by several tasks.
    """
    spark, rows = vectors.sparkSession, usable(vectors, "embedding")
    total = rows.count()
    width = rows.select(F.size("embedding")).first()[0] if total else 1
    limit = max(1, min(SAMPLE_ROWS, SAMPLE_NUMBERS // width))
    sample = rows.orderBy(F.xxhash64("repo_id", "id"), "repo_id", "id").limit(limit).select("embedding").collect()
    wanted = n_cells or round(total**0.5)
    wanted = max(1, min(wanted, MOST_CELLS, CENTRE_NUMBERS // width))
    centres = fit_centres(np.array([r[0] for r in sample], np.float64), wanted) if total else np.zeros((0, width))

    def place(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                scores = unit(_matrix(part.column(3), width)) @ centres.T
                found = [pa.array(scores.argmax(axis=1), pa.int32()), pa.array(scores.max(axis=1), pa.float64())]
                yield pa.RecordBatch.from_arrays([*part.columns, *found], names=["repo_id", "id", "file", "v", "cell", "fit"])

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("repo_id", "id", "file")}
    placed = rows.select("repo_id", "id", "file", F.col("embedding").cast("array<float>")).mapInArrow(place, ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", v array<float>, cell int, fit double")
    spread = max(1, -(-total // (FILE_ROWS * max(1, len(centres)))))
    placed = placed.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(spread))).sortWithinPartitions("cell", "repo_id")
    placed.write.partitionBy("cell").mode("overwrite").parquet(f"{path}/cells") if total else rows.select("repo_id", "id", "file", F.col("embedding").cast("array<float>").alias("v"), F.lit(0.0).alias("fit"), F.lit(0).alias("cell")).write.mode("overwrite").parquet(f"{path}/cells")
    least = {r.cell: r.least for r in spark.read.parquet(f"{path}/cells").groupBy("cell").agg(F.min("fit").alias("least")).collect()}  # one row for each cell
    listed = [(c, [float(x) for x in centres[c]], float(least[c])) for c in sorted(least)]
    spark.createDataFrame(listed, "cell int, centre array<double>, least double").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    return Ivf.read(spark, path)


def nearest_cells(queries: DataFrame, index: Ivf) -> DataFrame:
    """(repo_id, query_id, q, near): all cells, nearest centre first, each with the best cosine that a vector in it can have."""
    known = index.centres.orderBy("cell").collect()  # MOST_CELLS at most
    cells, centres = np.array([r.cell for r in known], np.int32), np.array([r.centre for r in known], np.float64)
    widest = np.arccos(np.clip([r.least for r in known], -1, 1))
    width = centres.shape[1] if len(known) else 0

    def rank(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                angle = np.arccos(np.clip(unit(_matrix(part.column(2), width)) @ centres.T, -1, 1))
                bound = np.cos(np.maximum(0, angle - widest))
                order = np.argsort(angle, axis=1, kind="stable")
                near = pa.StructArray.from_arrays([pa.array(cells[order].ravel(), pa.int32()), pa.array(np.take_along_axis(bound, order, axis=1).ravel(), pa.float64())], names=["cell", "bound"])
                ends = pa.array(np.arange(len(order) + 1, dtype=np.int32) * len(cells))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(ends, near)], names=["repo_id", "query_id", "q", "near"])

    rows = usable(queries, "embedding")
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("repo_id", "query_id")}
    schema = ", ".join(f"{c} {k}" for c, k in kinds.items()) + f", q {rows.schema['embedding'].dataType.simpleString()}, near array<struct<cell: int, bound: double>>"
    return rows.select("repo_id", "query_id", F.col("embedding").alias("q")).mapInArrow(rank, schema)


def _probe(asked: DataFrame, index: Ivf, wide: int, exclude_self: bool) -> DataFrame:
    """asked: (repo_id, query_id, q, cell), and low, see block_topk(). Reads the folders of the asked cells alone."""
    cells = [r.cell for r in asked.select("cell").distinct().collect()]  # MOST_CELLS at most
    return block_topk(asked, index.cells.filter(F.col("cell").isin(cells)).drop("fit"), ["repo_id", "cell"], wide, exclude_self)


def ivf_topk(queries: DataFrame, index: Ivf, k: int, probes: int = 8, exact: bool = False, threshold: float | None = None, per_file: int | None = None, oversample: int = 1, exclude_self: bool = False) -> DataFrame:
    """dense_topk() over an index: (repo_id, query_id, id, file, score, rank).

    queries: (repo_id, query_id, embedding). A query reads its `probes` nearest cells. With `exact` it then
    reads every further cell whose bound reaches its k-th best score, so nothing is missed. The best
    k * oversample are cut by threshold, then by per_file, then to k.
    """
    spark, wide = queries.sparkSession, k * oversample
    path = scratch(spark)
    nearest_cells(queries, index).write.parquet(f"{path}/near")
    near = spark.read.parquet(f"{path}/near")
    asked = near.select("repo_id", "query_id", "q", F.inline(F.slice("near", 1, probes))).drop("bound")
    hits = best(_probe(asked, index, wide, exclude_self), wide).drop("rank")
    if exact:
        hits.write.parquet(f"{path}/first")
        hits = spark.read.parquet(f"{path}/first")
        last = hits.groupBy("repo_id", "query_id").agg(F.count("*").alias("n"), F.min("score").alias("low")).filter(F.col("n") >= wide)
        rest = near.withColumn("near", F.slice("near", probes + 1, F.greatest(F.size("near") - probes, F.lit(0)))).join(last, ["repo_id", "query_id"], "left")
        # cosines are worked out in doubles: a cell is left out only if its bound is clearly too low
        rest = rest.select("repo_id", "query_id", "q", "low", F.inline("near")).filter(F.col("low").isNull() | (F.col("bound") >= F.col("low") - 1e-6))
        hits = best(hits.unionByName(_probe(rest.drop("bound"), index, wide, exclude_self)), wide).drop("rank")
    hits = hits if threshold is None else hits.filter(F.col("score") >= threshold)
    if per_file:
        in_file = Window.partitionBy("repo_id", "query_id", "file").orderBy(F.desc("score"), "id")
        hits = hits.withColumn("__n", F.row_number().over(in_file)).filter(F.col("__n") <= per_file).drop("__n")
    return best(hits, k)


def probes_for(queries: DataFrame, index: Ivf, k: int, target: float = 0.95, most: int = 200, exclude_self: bool = False) -> int:
    """How many cells a query must read for a share `target` of its k nearest vectors, on average over `most` of the queries.

    Their exact hits are looked up in the cells; where a hit's cell stands among the query's nearest ones says
    how many probes find it.
    """
    sample = queries.orderBy(F.xxhash64("repo_id", "query_id"), "repo_id", "query_id").limit(most)
    hits = ivf_topk(sample, index, k, exact=True, exclude_self=exclude_self).select("repo_id", "query_id", "id")
    placed = hits.join(index.cells.select("repo_id", "id", "cell"), ["repo_id", "id"]).distinct()
    near = nearest_cells(sample, index).select("repo_id", "query_id", F.posexplode("near").alias("at", "c")).select("repo_id", "query_id", "at", F.col("c.cell").alias("cell"))
    places = placed.join(near, ["repo_id", "query_id", "cell"]).groupBy("at").agg(F.count("*").alias("n")).orderBy("at").collect()  # MOST_CELLS at most
    total, found = sum(r.n for r in places), 0
    for r in places:
        found += r.n
        if found >= target * total:
            return r["at"] + 1
    return 1


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(repo_id, query_id, n, found): of the n exact hits of a query, how many were found."""
    key = ["repo_id", "query_id", "id"]
    mark = exact.select(*key).join(found.select(*key).withColumn("hit", F.lit(1)), key, "left")
    return mark.groupBy("repo_id", "query_id").agg(F.count("*").alias("n"), F.count("hit").alias("found"))


def cells_read(queries: DataFrame, index: Ivf, probes: int) -> DataFrame:
    """(repo_id, query_id, cells, vectors): how many cells a search of so many probes reads for a query, and vectors of its repository in them."""
    sizes = index.cells.groupBy("repo_id", "cell").agg(F.count("*").alias("size"))
    asked = nearest_cells(queries, index).select("repo_id", "query_id", F.inline(F.slice("near", 1, probes)))
    return asked.join(sizes, ["repo_id", "cell"], "left").groupBy("repo_id", "query_id").agg(F.count("*").alias("cells"), F.sum(F.coalesce("size", F.lit(0))).alias("vectors"))
