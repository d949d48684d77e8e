"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Within a source the documents stand in a row, each as long as its expected copies; one random offset
is added to the running sum and a document is taken once for every whole number that its stretch
crosses. The row is ordered by size class (a sixteenth of a power of two), so that sizes are taken
evenly and the words of a source come close to its target.

The running sum of a source is never made in one task: documents are counted by (source, class,
salt), those counts are summed into offsets, and only the rows of one salt are numbered together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.llm.common import WORD, discard, written

WEIGHTS = (3, 1, 2)
#: Documents of one class that are numbered in one group, on average, at most.
GROUP_ROWS = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _number(digest: Column) -> Column:
    """The first 32 bits of a hexadecimal digest."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def _running(rows: DataFrame, order: list[Column], sums: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """rows with __i, their number in the order (from 1), and for each name in sums the sum of its column over the rows before.

    Rows are dealt into ranges, whose counts and sums (a row for each range) are summed first, so no task
    orders them all. Also returns a table to discard. The order must be total.
    """
    dealt = written(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    parts = dealt.groupBy("__range").agg(F.count("*").alias("__i0"), *[F.sum(c).alias(f"{name}0") for name, c in sums.items()])
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("__range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("__i0", *(f"{name}0" for name in sums))])
    inside = Window.partitionBy("__range").orderBy(*order)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    columns = {"__i": F.row_number().over(inside) + F.col("__i0")} | {name: F.coalesce(F.sum(c).over(earlier), F.lit(0)) + F.col(f"{name}0") for name, c in sums.items()}
    return dealt.join(F.broadcast(parts), "__range").withColumns(columns).drop("__range", "__i0", *(f"{name}0" for name in sums)), dealt


def source_targets(sizes: DataFrame, share: float, cap: float, weights=WEIGHTS) -> tuple[DataFrame, list[DataFrame]]:
    """sizes: (source, source_size), one row each. Adds weight and target; also returns tables to discard.

    The targets share `share` times all sizes by weight; none is above `cap` times its source's size,
    and what is cut there goes to the others by weight. That is min(level * weight, cap * size) with
    the one level at which the sum comes out; the sources under the level are those with the least
    cap / weight, so sorted prefix sums give it.
    """
    numbered, first = _running(sizes, [F.col("source").asc_nulls_last()], {})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("__i") - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = numbered.select("source", "source_size", F.col("__i").alias("__place"), weight.alias("weight"), (F.col("source_size") * F.lit(float(cap))).alias("__cap"))
    rows, second = _running(rows, [F.col("__cap") / F.col("weight"), F.col("__place")], {"__capped": "__cap", "__gone": "weight"})
    total = rows.agg((F.sum("source_size") * F.lit(float(share))).alias("__total"), F.sum("weight").alias("__weights"))
    rows = rows.crossJoin(F.broadcast(total)).withColumn("__level", (F.col("__total") - F.col("__capped")) / (F.col("__weights") - F.col("__gone")))
    # the level rises while the cut sources go out and falls from there on
    rows = rows.crossJoin(F.broadcast(rows.agg(F.max("__level").alias("__top"))))
    return rows.select("source", "source_size", "weight", F.least(F.col("__top") * F.col("weight"), F.col("__cap")).alias("target")), [first, second]


def mix(docs: DataFrame, share: float = 1.5, cap: float = 2.0, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each row of docs: doc_id, source, size, source_size, target, copies, taken.

    size counts words (0 for a null text); copies is 0 to ceil(cap); taken is copies * size. A null
    source is a source of its own, the last. Copies of a document count as documents of their own.
    The same rows give the same copies, however they are partitioned: rows that agree in id and size
    are interchangeable. Within a source the row is ordered by size to a sixteenth of a power of two, so
    the words taken are off from the target by about its longest document's size at most, and a source of
    few documents can be off by that share of it. Null ids are allowed; other columns of docs play no
    part. An empty table gives an empty one, and a source without words is taken no times.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    digest = F.md5(F.to_json(F.struct(F.lit(seed).alias("seed"), "doc_id", "size")).cast("binary"))
    # the small addend keeps exact powers of two in their own class
    size_class = F.floor(16 * F.log2(F.col("size") + F.lit(1.0)) + F.lit(1e-9)).cast("int")
    rows = written(rows.withColumn("__h", digest).withColumn("__class", size_class))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets, tables = source_targets(sizes, share, cap)
    salts = max(64, rows.count() // (16 * GROUP_ROWS))
    salted = rows.withColumn("__salt", F.pmod(_number(F.col("__h")), F.lit(salts)).cast("int"))
    counts = salted.groupBy("source", "__class", "__salt").agg(F.count("*").alias("__n"))
    in_class = Window.partitionBy("source", "__class").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(in_class), F.lit(0)))
    classes = salted.groupBy("source", "__class").agg(F.count("*").alias("__n"))
    in_source = Window.partitionBy("source").orderBy("__class").rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.withColumn("__offset", F.coalesce(F.sum("__n").over(in_source), F.lit(0))).drop("__n")
    plan = targets.alias("t").join(classes.alias("c"), F.col("t.source").eqNullSafe(F.col("c.source"))).drop(F.col("c.source"))
    plan = plan.alias("p").join(counts.alias("n"), F.col("p.source").eqNullSafe(F.col("n.source")) & (F.col("p.__class") == F.col("n.__class")))
    plan = plan.select("p.source", "p.__class", "n.__salt", "source_size", "target", (F.col("__offset") + F.col("__before")).alias("__start"))
    group = Window.partitionBy("source", "__class", "__salt").orderBy("__h", "doc_id", "size")
    ranked = salted.withColumn("__rank", F.row_number().over(group))
    found = ranked.alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.__class") == F.col("p.__class")) & (F.col("r.__salt") == F.col("p.__salt")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # a multiple of 1/1024: the sums below stay exact at rates such as 1 or 2
    offset = F.pmod(_number(F.md5(F.concat_ws(":", F.lit(seed), F.lit("offset"), F.col("r.source")).cast("binary"))), F.lit(1024)) / F.lit(1024.0)
    end = F.floor((F.col("__start") + F.col("__rank")) * rate + offset)
    begin = F.floor((F.col("__start") + F.col("__rank") - 1) * rate + offset)
    copies = F.least(end - begin, F.lit(int(-(-cap // 1)))).cast("int")
    out = found.select("doc_id", F.col("r.source").alias("source"), "size", "source_size", "target", copies.alias("copies"))
    out = written(out.withColumn("taken", F.col("copies").cast("long") * F.col("size")))
    discard(rows, *tables)
    return out
