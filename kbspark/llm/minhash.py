"""MinHash near-duplicates with circulant signatures.

Two permutations of the 64-bit numbers serve for all coordinates of a signature: the first scatters
the shingles, the second is shifted by one for each further coordinate. Bands of coordinates make
buckets; documents of one bucket are compared on their full sets.

No bucket is ever turned into pairs. In each, one document (that with the most company in all its
buckets) is compared with the others; buckets that still hold several components are then compared
block by block, inside tasks that hold two blocks of bounded size. So no two documents of a bucket are left apart
unless they were compared or are connected through others.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kbspark.llm.common import discard, in_arrow, slices, written
from kbspark.llm.graph import components
from kbspark.llm.hashing import mix, shingle_sets

BAND_ROWS = 4
#: Chance of two documents at the threshold to share no bucket, at most.
MISSED = 1e-5
#: Bytes of texts whose shingles are held at once, unless one is longer.
SLICE_BYTES = 1 << 19
#: Shingles of the documents in a block and documents in a block, on average, at most.
BLOCK_ITEMS, BLOCK_ROWS = 100_000, 1000


def bands_for(similarity: float, rows: int = BAND_ROWS, missed: float = MISSED) -> int:
    return math.ceil(math.log(missed) / math.log(1 - similarity**rows))


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """One row of coordinates for each set; none may be empty."""
    out = np.empty((len(sets), coordinates), np.uint64)
    starts = np.cumsum([0, *map(len, sets)])
    first = 0
    while first < len(sets):  # in pieces that fit a processor's cache
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + 32768, "right")) - 1)
        scattered = mix(np.concatenate(sets[first:last]), 21)
        for k in range(coordinates):
            out[first:last, k] = np.minimum.reduceat(mix(scattered + np.uint64(k), 22), starts[first:last] - starts[first])
        first = last
    return out


def _set_key(values: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    return np.array([mix(values, 31).sum(), mix(values, 32).sum() + np.uint64(len(values))], np.uint64).tobytes()


def _sketches(docs: DataFrame, id_col: str, text_col: str, k: int, bands: int) -> DataFrame:
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches):
        for batch in slices(batches, 1, SLICE_BYTES):
            sets = shingle_sets([t or b"" for t in batch.column(1).to_pylist()], k)
            full = [s for s in sets if len(s)]
            hashed = np.zeros((len(full), bands), np.uint64)
            if full:
                found = signatures(full, bands * BAND_ROWS).reshape(len(full), bands, BAND_ROWS)
                for r in range(BAND_ROWS):
                    hashed = mix(hashed, 41) + found[:, :, r]
                hashed = mix(hashed + np.arange(bands, dtype=np.uint64), 42)
            rows = iter(hashed.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([_set_key(s) if len(s) else None for s in sets], pa.binary()), pa.array([next(rows) if len(s) else None for s in sets], pa.list_(pa.int64()))],
                names=schema.names,
            )

    return in_arrow(docs.select(F.col(id_col), F.col(text_col).cast("binary")), run, schema)


def _full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(key, items) for the wanted (doc_id, key)."""

    def run(batches):
        for batch in slices(batches, 1, SLICE_BYTES):
            sets = shingle_sets(batch.column(1).to_pylist(), k)
            asked = batch.column(0).to_pylist()
            held = [(w, s) for w, s in zip(asked, sets) if len(s) and _set_key(s) == w]
            if held:
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in held], pa.binary()), pa.array([s.view(np.int64) for _, s in held], pa.list_(pa.int64()))], names=["key", "items"])

    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("binary").alias("text"))
    rows = texts.join(wanted, F.col("__id").eqNullSafe(F.col("doc_id"))).select("key", F.coalesce("text", F.lit(b"")).alias("text"))
    return in_arrow(rows, run, "key binary, items array<bigint>").dropDuplicates(["key"])


def _linked(a, b, percent: int):
    shared = F.size(F.array_intersect(a, b))
    return shared * 100 >= (F.size(a) + F.size(b) - shared) * percent


def _compare_blocks(percent: int):
    """Links between the components of two blocks' documents, one for each pair of components."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        items, labels = [np.asarray(x) for x in rows["items"]], rows["label"].tolist()
        sizes = np.array([len(x) for x in items])
        left = np.flatnonzero(rows["block"].to_numpy() == rows["i"].to_numpy())
        right = np.flatnonzero(rows["block"].to_numpy() == rows["j"].to_numpy())
        values, place = np.unique(np.concatenate(items), return_inverse=True)
        owner = np.repeat(np.arange(len(items)), sizes)
        common = np.bincount(place, minlength=len(values)) > 1
        column = np.cumsum(common) - 1
        use = common[place]
        owner, place = owner[use], column[place[use]]
        shared = np.zeros((len(left), len(right)), np.int64)
        row_of, col_of = np.full(len(items), -1), np.full(len(items), -1)
        row_of[left], col_of[right] = np.arange(len(left)), np.arange(len(right))
        for at in range(0, int(common.sum()), 4096):
            now = (place >= at) & (place < at + 4096)
            a, b = np.zeros((len(left), 4096), np.float32), np.zeros((len(right), 4096), np.float32)
            x, y = now & (row_of[owner] >= 0), now & (col_of[owner] >= 0)
            a[row_of[owner[x]], place[x] - at] = 1
            b[col_of[owner[y]], place[y] - at] = 1
            shared += (a @ b.T).astype(np.int64)
        union = sizes[left][:, None] + sizes[right][None, :] - shared
        found = {tuple(sorted((labels[left[x]], labels[right[y]]))) for x, y in zip(*np.nonzero(shared * 100 >= union * percent))}
        found = sorted(p for p in found if p[0] != p[1])
        return pd.DataFrame({"a": [p[0] for p in found], "b": [p[1] for p in found]}, columns=["a", "b"])

    return run


def _blocks(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """labelled: (bucket, key, n, label). Blocks to compare, (bucket, key, label, i, j), of buckets that hold several components.

    Of buckets that hold the same documents one is taken. The documents of a bucket's largest component
    have blocks of their own, which are not compared with each other: where nearly all are one component,
    the pairs of blocks grow with the bucket, not with its square. Also returns a table to discard.
    """
    kinds = labelled.groupBy("bucket", "label").agg(F.count("*").alias("size"), F.sum("n").alias("items"), F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("who"))
    totals = kinds.groupBy("bucket").agg(F.count("*").alias("kinds"), F.max(F.struct("size", "items", "label")).alias("most"), F.sum("size").alias("size"), F.sum("items").alias("items"), F.sum("who").alias("who"))
    one = totals.filter("kinds > 1").groupBy("size", "items", "who").agg(F.min(F.struct("bucket", "most")).alias("x"))
    count = lambda size, items: F.ceil(F.greatest(size / BLOCK_ROWS, items / BLOCK_ITEMS)).cast("int")
    apart = one.select("x.bucket", F.col("x.most.label").alias("major"), count(F.col("size") - F.col("x.most.size"), F.col("items") - F.col("x.most.items")).alias("p"), count(F.col("x.most.size"), F.col("x.most.items")).alias("q"))
    apart = written(apart)
    dealt = labelled.join(apart, "bucket").withColumn("h", F.xxhash64("key"))
    block = F.when(F.col("label") == F.col("major"), F.col("p") + F.pmod("h", "q")).otherwise(F.pmod("h", "p")).cast("int")
    last = F.when(F.col("label") == F.col("major"), F.col("p")).otherwise(F.col("p") + F.col("q")) - 1
    pairs = F.transform(F.sequence(F.lit(0), last), lambda o: F.struct(F.least(o, F.col("block")).alias("i"), F.greatest(o, F.col("block")).alias("j")))
    return dealt.withColumn("block", block).select("bucket", "key", "label", "block", F.inline(pairs)), apart


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept.

    Documents are linked if the Jaccard similarity of their sets of word shingles (A-Z lower-cased) is
    at least `similarity`, a whole number of percent. component_id is the smallest id in reach, kept
    says that it is the document's own. Texts that are null or hold no word have the empty set and are
    linked with nothing; a text of fewer words than a shingle has one shingle. Rows that repeat an id
    are linked like others, and each of them is kept if one is. A null id is never the smallest one
    and never kept, unless no other is in reach. Other columns play no part. An empty table gives an
    empty one.
    """
    percent = round(100 * similarity)
    rows = written(_sketches(docs, id_col, text_col, words, bands_for(similarity)))
    sets = written(rows.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bands").alias("bands")))

    # what a bucket is joined with is written first: joins of two plain shuffles, of which Spark splits hot buckets
    bucketed = sets.select("key", "n", F.explode("bands").alias("bucket"))
    shared = written(bucketed.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1"))
    members = written(bucketed.join(shared, "bucket"))
    company = members.groupBy("key").agg(F.sum("size").alias("company"))
    leaders = written(members.join(company, "key").groupBy("bucket").agg(F.max(F.struct("company", "key"))["key"].alias("leader")))
    stars = written(members.join(leaders, "bucket").filter("key != leader").select("leader", "key").distinct())
    discard(shared, leaders)
    wanted = stars.select("key").union(stars.select("leader")).distinct()
    full = written(_full_sets(docs, sets.select("doc_id", "key").join(wanted, "key"), id_col, text_col, words))
    leading = full.select(F.col("key").alias("leader"), F.col("items").alias("leading"))
    links = stars.join(full, "key").join(leading, "leader").filter(_linked(F.col("items"), F.col("leading"), percent))
    tables = [rows, sets, members, stars, full, labels := components(links.select(F.col("leader").alias("a"), F.col("key").alias("b")))]

    labelled = members.filter("size > 2").join(labels, F.col("key") == F.col("node"), "left").select("bucket", "key", "n", F.coalesce("label", "key").alias("label"))
    blocks, apart = _blocks(labelled)
    more = written(blocks.join(full, "key").groupBy("bucket", "i", "j").applyInPandas(_compare_blocks(percent), "a binary, b binary").distinct())
    tables += [apart, more]
    if not more.isEmpty():
        tables.append(above := components(more))
        above = above.select(F.col("node").alias("label"), F.col("label").alias("top"))
        labels = labels.select(F.col("node").alias("key"), "label").join(above, "label", "left").select(F.col("key").alias("node"), F.coalesce("top", "label").alias("label"))
        alone = above.select(F.col("label").alias("node"), F.col("top").alias("label")).join(labels.select("node"), "node", "left_anti")
        labels = labels.union(alone)

    grouped = sets.select("key", "doc_id").join(labels, F.col("key") == F.col("node"))
    least = grouped.groupBy("label").agg(F.min("doc_id").alias("least"))
    named = grouped.join(least, "label").select("key", "least")
    named = sets.select("key", "doc_id").join(named, "key", "left").select("key", F.coalesce("least", "doc_id").alias("component_id"))
    out = rows.select("doc_id", "n", "key").join(named, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = written(out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")))
    discard(*tables)
    return out
