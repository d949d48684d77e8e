"""Document fingerprints by a threshold-scaled sketch, in DataFrame operations only.

A sketch holds every shingle hash below a fixed fraction of the hash range, so its size follows the
document's, and the share of one sketch that another holds estimates containment, however unequal
the two documents are. Sketches merge by union. A document with no hash below the fraction keeps its
least hash; a merge keeps that one only if nothing is below the fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kbspark.llm.common import ascii_lower

SHINGLE_WORDS = 5
#: Hashes are hexadecimal; those below this are kept: one in eight.
BELOW = "2"
HASH_DIGITS = 12
#: Documents in one bucket of ids, on average, at least; buckets and first cells at most, whatever the table.
BUCKET_ROWS, MOST_BUCKETS, MOST_CELLS = 1000, 500_000, 65_536


def shingle_hashes(text: Column, k: int = SHINGLE_WORDS) -> Column:
    """Hashes of all runs of k words; of a text with fewer words, of all its words together."""
    words = F.filter(F.split(ascii_lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def runs(w: Column) -> Column:
        starts = F.when(F.size(w) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.greatest(F.size(w) - (k - 1), F.lit(1))))
        return F.transform(starts, lambda i: F.substring(F.md5(F.array_join(F.slice(w, i, F.lit(k)), " ").cast("binary")), 1, HASH_DIGITS))

    # a lambda's argument is computed once; a column named in a lambda would be computed for each item
    return F.flatten(F.transform(F.array(words), runs))


def sketch(text: Column, k: int = SHINGLE_WORDS) -> Column:
    """The kept hashes, sorted, joined by commas; empty if the text has no words."""

    def joined(hashes: Column) -> Column:
        kept = F.array_sort(F.array_distinct(F.filter(hashes, lambda h: h < BELOW)))
        return F.coalesce(F.nullif(F.array_join(kept, ","), F.lit("")), F.array_min(hashes), F.lit(""))

    return F.element_at(F.transform(F.array(shingle_hashes(F.coalesce(text, F.lit("")), k)), joined), 1)


def _items(fingerprint: Column) -> Column:
    return F.when(fingerprint == "", F.array().cast("array<string>")).otherwise(F.split(fingerprint, ","))


def merge(a: Column, b: Column) -> Column:
    """The sketch of two documents' shingles together."""
    both = F.array_sort(F.array_union(_items(a), _items(b)))
    below = F.filter(both, lambda h: h < BELOW)
    return F.array_join(F.when(F.size(below) > 0, below).otherwise(F.slice(both, 1, 1)), ",")


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b holds; 1 if both have none, 0 if only a has none."""
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(F.size(F.array_intersect(_items(a), _items(b))) / F.size(_items(a)))


def likeness(a: Column, b: Column) -> Column:
    """The larger of the two containments, 0 to 1."""
    return F.greatest(containment(a, b), containment(b, a))


def _rising(ids: Column, kind: T.DataType, low, high) -> Column:
    """A double that never falls as ids rise from low to high."""
    if isinstance(kind, (T.StringType, T.BinaryType)):  # six bytes after those that all ids share
        a, b = (x.encode() if isinstance(x, str) else bytes(x) for x in (low, high))
        shared = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        digits = F.rpad(F.hex(F.substring(ids.cast("binary"), shared + 1, 6)), 12, "0")
        return F.conv(digits, 16, 10).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(ids).cast("double")
    if isinstance(kind, (T.NumericType, T.BooleanType, T.TimestampType)):
        x = ids.cast("double")
        return F.when(F.isnan(x), F.lit(1e300)).otherwise(F.least(F.greatest(x, F.lit(-1e300)), F.lit(1e300)))
    return F.lit(0.0)


def _bucketed(rows: DataFrame) -> DataFrame:
    """Adds __bucket to rows with __id and __digest: it never falls as (id, digest) rise, null ids first.

    The range of the ids is cut into cells of equal width, and each cell, by what it holds, into buckets
    of equal width, so that neither a far-off id nor a dense stretch fills one bucket. The rows of an id
    that fills a cell alone are cut by digest. The cells' table is broadcast: MOST_CELLS + 1 rows at most.
    """
    low, high, n = rows.agg(F.min("__id"), F.max("__id"), F.count("*")).first()
    if low is None:  # no ids at all
        number, lo, hi = F.lit(0.0), 0.0, 0.0
    else:
        number = _rising(F.col("__id"), rows.schema["__id"].dataType, low, high)
        lo, hi = rows.agg(F.min(number), F.max(number)).first()
    cells = min(MOST_CELLS, max(1, n // BUCKET_ROWS))
    width = max((hi - lo) / cells, 1e-300)
    cell = F.when(F.col("__id").isNull(), F.lit(-1)).otherwise(F.least(F.floor((number - F.lit(lo)) / F.lit(width)), F.lit(cells - 1))).cast("int")
    rows = rows.withColumns({"__number": number, "__cell": cell})
    held = rows.groupBy("__cell").agg(F.count("*").alias("n"), F.min("__number").alias("a"), F.max("__number").alias("b"), F.min("__id").eqNullSafe(F.max("__id")).alias("__one"))
    before = Window.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("__parts", F.ceil(F.col("n") / F.lit(max(BUCKET_ROWS, n // MOST_BUCKETS))))
    held = held.select("__cell", "__one", "__parts", F.col("a").alias("__a"), ((F.col("b") - F.col("a")) / F.col("__parts")).alias("__w"), F.coalesce(F.sum("__parts").over(before), F.lit(0)).alias("__before"))
    place = F.when(F.col("__one"), F.conv(F.substring("__digest", 1, 12), 16, 10).cast("double") / F.lit(2.0**48) * F.col("__parts"))
    place = place.when(F.col("__w") > 0, (F.col("__number") - F.col("__a")) / F.col("__w")).otherwise(F.lit(0.0))
    bucket = F.col("__before") + F.least(F.floor(place), F.col("__parts") - 1)
    return rows.join(F.broadcast(held), "__cell").withColumn("__bucket", bucket).drop("__cell", "__one", "__parts", "__a", "__w", "__before", "__number")


def with_next(docs: DataFrame, id_col: str, columns: list[str], derived: dict[str, Column]) -> DataFrame:
    """Adds derived columns, and next_<column>: its value in the next row by descending id (null ids last); after the last row comes the first.

    Ids of any type that sorts will do. They are dealt into buckets, and each bucket gets a copy of the
    first row of the one that follows, so every bucket is a window of its own, and the texts are shuffled
    once. The first rows' ids and digests are broadcast: MOST_BUCKETS + MOST_CELLS + 1 of them at most.
    Rows that share an id are ordered by the MD5 of the columns.
    """
    digest = F.md5(F.concat_ws("\x00", *columns).cast("binary"))
    rows = _bucketed(docs.select(F.col(id_col).alias("__id"), *columns).withColumn("__digest", digest))
    firsts = rows.groupBy("__bucket").agg(F.max(F.struct(F.col("__id").alias("id"), F.col("__digest").alias("digest"))).alias("__first"))
    down = Window.orderBy(F.col("__bucket").desc())
    overall = F.first("__first").over(down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    borders = firsts.select(F.col("__bucket").alias("__to"), F.coalesce(F.lead("__first").over(down), overall).alias("__border"))
    own = F.col("__id").eqNullSafe(F.col("__border.id")) & (F.col("__digest") == F.col("__border.digest"))
    copies = rows.join(F.broadcast(borders), own).select("__id", *columns, "__digest", F.col("__to").alias("__bucket"), F.lit(True).alias("__copy"))
    together = rows.withColumn("__copy", F.lit(False)).unionByName(copies).withColumns(derived)
    order = Window.partitionBy("__bucket").orderBy("__copy", F.col("__id").desc_nulls_last(), F.col("__digest").desc())
    for c in [*columns, *derived]:
        together = together.withColumn(f"next_{c}", F.lead(c).over(order))
    return together.filter(~F.col("__copy")).withColumnRenamed("__id", id_col).drop("__bucket", "__copy", "__digest")


def fingerprint_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints every text and its edited text: the last half of it replaced by the next document's beginning.

    One row for each row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. A null text counts as empty. Texts without words have the empty
    fingerprint, which is like itself (1) and like no other (0). A single document is its own next
    one. Ids of any type that sorts may be null (last) or repeated (ordered by the MD5 of the text);
    other columns play no part. An empty table gives an empty one.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = with_next(rows, "doc_id", ["text"], {"print": sketch(F.col("text"))})
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half))
    rows = rows.withColumn("edited", edited).withColumn("edited_print", sketch(F.col("edited")))
    return rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.col("print").alias("fingerprint"),
        F.col("edited_print").alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
