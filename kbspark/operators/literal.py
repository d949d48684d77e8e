"""Literal search over stored pages by positions of three-letter grams.

A query's rarest grams are looked up, their positions intersected, and only pages where these stand as in
the query are read and checked. Queries of fewer than three characters have no gram and read all pages
of their repository.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kbspark.functions import text as X
from kbspark.sources.store import scratch

#: Grams of a query that are looked up, at most; the rest is left to the check of the page.
MOST_GRAMS = 4
#: Folders of grams and of pages; characters of pages whose grams are sorted at once.
FOLDERS, SORTED_CHARS = 64, 2 << 20
#: Tasks that the stretches of a folder are dealt to.
SPREAD = 16


@dataclass(frozen=True)
class GramIndex:
    """grams: (repo_id, gram, first, n, places, folder), see packed(); counts: (repo_id, gram, n); pages: (repo_id, filename, page, content, part)."""

    grams: DataFrame
    counts: DataFrame
    pages: DataFrame

    @staticmethod
    def read(spark: SparkSession, path: str) -> GramIndex:
        counts = spark.read.parquet(f"{path}/counts")
        repo = counts.schema["repo_id"].dataType.simpleString()
        # named, as folders of an empty index hold no file
        grams = spark.read.schema(f"repo_id {repo}, gram bigint, first bigint, n int, places binary, folder int").parquet(f"{path}/grams")
        return GramIndex(grams, counts, spark.read.schema(f"repo_id {repo}, filename string, content string, page bigint, part int").parquet(f"{path}/pages"))


def gram_keys(text: str) -> np.ndarray:
    """One number for each three characters that follow one another."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return points[:-2] << 42 | points[1:-1] << 21 | points[2:]


def packed(page: np.ndarray, at: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Places (page, at) as bytes, one value for each row that begins at starts: steps from page to page, and positions that start anew on each page, as groups of seven bits, the last with its high bit unset."""
    begin = np.zeros(len(page), bool)
    begin[starts] = True
    step = np.diff(page, prepend=0)
    step[begin] = 0
    far = np.where(begin | (step != 0), at, np.diff(at, prepend=0))
    numbers = np.stack([step, far], axis=1).ravel().astype(np.int64)
    # the step is left out where the page stays: the position's lowest bit says so
    numbers[1::2] = numbers[1::2] << 1 | (step != 0)
    kept = np.ones(len(numbers), bool)
    kept[0::2] = step != 0
    # the position first, then the step that it announces
    numbers = numbers.reshape(-1, 2)[:, ::-1].ravel()[kept.reshape(-1, 2)[:, ::-1].ravel()]
    size = np.ones(len(numbers), np.int64)
    for bits in range(7, 63, 7):
        size += numbers >> bits > 0
    ends = np.cumsum(size)
    out = np.empty(ends[-1] if len(ends) else 0, np.uint8)
    for i in range(int(size.max(initial=0))):
        has = size > i
        out[ends[has] - size[has] + i] = (numbers[has] >> 7 * i & 127) | np.where(size[has] > i + 1, 128, 0)
    # where the rows' numbers begin
    before = np.r_[0, np.cumsum(1 + (step != 0))]
    at_byte = np.r_[0, ends][before[np.r_[starts, len(page)]]].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at_byte), pa.py_buffer(out)])


def unpacked(first: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(page, at) of a row's packed() places; first is the page of the first one."""
    raw = np.frombuffer(data, np.uint8).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, raw[:-1] < 128])
    place = np.arange(len(raw)) - np.repeat(starts, np.diff(np.r_[starts, len(raw)]))
    numbers = np.add.reduceat((raw & 127) << 7 * place, starts).tolist()
    page, at, pages, ats, i = first, 0, [], [], 0
    while i < len(numbers):
        x, i = numbers[i], i + 1
        if x & 1:
            page, at, i = page + numbers[i], 0, i + 1
        at += x >> 1
        pages.append(page)
        ats.append(at)
    return np.array(pages, np.int64), np.array(ats, np.int64)


def _postings(repo: pa.DataType):
    def rows(held) -> pa.RecordBatch:
        repos, pages, keys = zip(*sorted(held, key=lambda x: x[1]))  # steps go up
        size = [len(k) for k in keys]
        listed = pa.array(repos, repo).dictionary_encode()
        code = np.repeat(listed.indices.to_numpy(zero_copy_only=False), size)
        page, at = np.repeat(np.array(pages, np.int64), size), np.concatenate([np.arange(n, dtype=np.int32) for n in size])
        key = np.concatenate(keys)
        order = np.lexsort((key, code))
        key, code = key[order], code[order]
        first = np.flatnonzero(np.r_[True, (np.diff(key) != 0) | (np.diff(code) != 0)]) if len(key) else np.zeros(0, np.int64)
        page, at = page[order], at[order]
        n = np.diff(np.r_[first, len(key)]).astype(np.int32)
        return pa.RecordBatch.from_arrays([listed.dictionary.take(pa.array(code[first])), pa.array(key[first]), pa.array(page[first]), pa.array(n), packed(page, at, first)], names=["repo_id", "gram", "first", "n", "places"])

    def run(batches):
        held, total = [], 0
        for batch in batches:
            for r, page, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                held.append((r, page, gram_keys(text)))
                total += len(text)
                if total >= SORTED_CHARS:
                    yield rows(held)
                    held, total = [], 0
        if held:
            yield rows(held)

    return run


def build_grams(pages: DataFrame, path: str) -> GramIndex:
    """Writes the index of pages (repo_id, filename, content); pages may repeat a name. Null contents hold nothing.

    A frequent gram has one row for each stretch of pages, so no gram's positions meet in one task.
    """
    spark = pages.sparkSession
    rows = pages.filter(F.col("content").isNotNull()).select("repo_id", "filename", "content", F.monotonically_increasing_id().alias("page"))
    rows.withColumn("part", F.pmod(F.xxhash64("page"), F.lit(FOLDERS)).cast("int")).write.mode("overwrite").partitionBy("part").parquet(f"{path}/pages")
    repo = pages.schema["repo_id"].dataType.simpleString()
    stored = spark.read.schema(f"repo_id {repo}, filename string, content string, page bigint, part int").parquet(f"{path}/pages")
    texts = stored.select("repo_id", "page", F.lower("content").alias("text")).filter(F.length("text") >= 3)
    kind = texts.limit(0).toArrow().schema.field(0).type
    found = texts.mapInArrow(_postings(kind), f"repo_id {repo}, gram bigint, first bigint, n int, places binary").withColumn("folder", F.pmod(F.xxhash64("repo_id", "gram"), F.lit(FOLDERS)).cast("int"))
    order = ["folder", "repo_id", "gram"]
    dealt = found.repartition("folder", F.pmod(F.xxhash64("first"), F.lit(SPREAD))).sortWithinPartitions(*order)
    dealt.write.mode("overwrite").option("compression", "zstd").partitionBy("folder").parquet(f"{path}/grams")
    grams = spark.read.schema(dealt.schema).parquet(f"{path}/grams")
    grams.groupBy("repo_id", "gram").agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{path}/counts")
    return GramIndex.read(spark, path)


def _query_grams(queries: DataFrame) -> DataFrame:
    """(query_id, repo_id, offset, gram) of the queries of three characters or more."""
    kinds = {c: queries.schema[c].dataType.simpleString() for c in ("query_id", "repo_id")}

    def run(frames):
        for frame in frames:
            out = [(q, r, o, int(g)) for q, r, text in frame.itertuples(index=False) for o, g in enumerate(gram_keys(text))]
            yield pd.DataFrame(out, columns=["query_id", "repo_id", "offset", "gram"])

    rows = queries.select("query_id", "repo_id", F.lower("q").alias("t")).filter(F.length("t") >= 3)
    return rows.mapInPandas(run, f"query_id {kinds['query_id']}, repo_id {kinds['repo_id']}, offset int, gram bigint")


def _places(batches):
    for batch in batches:
        found = [unpacked(first, data) for first, data in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())]
        row = pa.array(np.repeat(np.arange(len(found)), [len(p) for p, _ in found]))
        page, at = (pa.array(np.concatenate([x[i] for x in found] or [np.zeros(0, np.int64)])) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([*[batch.column(c).take(row) for c in range(4)], page, at], names=["query_id", "repo_id", "wanted", "offset", "page", "at"])


def candidates(queries: DataFrame, index: GramIndex) -> DataFrame:
    """(query_id, repo_id, page): pages that hold the rarest grams of a query as far apart as the query does."""
    grams = _query_grams(queries).join(index.counts, ["repo_id", "gram"], "left")
    rarest = Window.partitionBy("query_id", "repo_id").orderBy("n", "offset")
    whole = Window.partitionBy("query_id", "repo_id")
    # a gram that no page holds: nothing is found
    grams = grams.withColumns({"r": F.row_number().over(rarest), "lost": F.max(F.col("n").isNull()).over(whole), "all": F.count("*").over(whole)})
    grams = grams.filter(~F.col("lost") & (F.col("r") <= MOST_GRAMS)).select("query_id", "repo_id", "gram", "offset", F.least("all", F.lit(MOST_GRAMS)).alias("wanted"))
    # written, so that Spark brings few grams to the index
    path = scratch(queries.sparkSession)
    grams.write.parquet(path)
    grams = queries.sparkSession.read.parquet(path)
    folders = [r[0] for r in grams.select(F.pmod(F.xxhash64("repo_id", "gram"), F.lit(FOLDERS)).cast("int")).distinct().collect()]  # FOLDERS at most
    met = index.grams.filter(F.col("folder").isin(folders)).join(grams, ["repo_id", "gram"]).select("query_id", "repo_id", "wanted", "offset", "first", "places")
    kind = lambda c: met.schema[c].dataType.simpleString()
    places = met.mapInArrow(_places, f"query_id {kind('query_id')}, repo_id {kind('repo_id')}, wanted {kind('wanted')}, offset int, page bigint, at bigint")
    starts = places.groupBy("query_id", "repo_id", "page", "wanted", (F.col("at") - F.col("offset")).alias("start")).agg(F.count("*").alias("n"))
    return starts.filter("n = wanted").select("query_id", "repo_id", "page").distinct()


def literal_search(queries: DataFrame, index: GramIndex, around: int = 80) -> DataFrame:
    """(query_id, repo_id, filename, snippet, match_count) of pages that hold the query's text, any case: the rows of graph.literal_search().

    queries: (query_id, repo_id, q), with one row for each query and repository. An empty or null query finds nothing.
    """
    spark, path = queries.sparkSession, scratch(queries.sparkSession)
    candidates(queries, index).write.parquet(path)
    near = spark.read.parquet(path).withColumn("part", F.pmod(F.xxhash64("page"), F.lit(FOLDERS)).cast("int"))
    parts = [r[0] for r in near.select("part").distinct().collect()]  # FOLDERS at most
    pages = index.pages.filter(F.col("part").isin(parts)).drop("part")
    rows = pages.join(near.select("query_id", "repo_id", "page").join(queries, ["query_id", "repo_id"]), ["repo_id", "page"])
    short = queries.filter(F.length(F.lower("q")).between(1, 2))
    if not short.isEmpty():
        rows = rows.unionByName(index.pages.drop("part").join(short, "repo_id"))
    rows = rows.filter(F.contains(F.lower("content"), F.lower("q")))
    return rows.select("query_id", "repo_id", "filename", X.snippet(F.col("content"), F.col("q"), around).alias("snippet"), X.occurrences(F.col("content"), F.col("q")).alias("match_count"))
