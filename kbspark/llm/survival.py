"""Filter interaction audit by truth-table survival words.

Five filters have 32 subsets. A document becomes a word of 32 bits: bit s says that it survives when
exactly the filters of subset s are applied. How many words have each bit, by part and label, is
counted by carry-save adders over whole arrays of words; what any order of the filters keeps, removes
or removes twice follows from these 32 counts alone.
"""

from __future__ import annotations

import json
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.llm.common import discard, in_arrow, salted_join, written

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
#: Parts whose counts a task holds before it hands them on.
HELD_PARTS = 2048
#: Labels that are counted: all documents, those of quality 1, toxic ones.
LABELS = ("all", "good", "toxic")


def text_failures(docs: DataFrame, text: str) -> DataFrame:
    """docs with `fails`: bits 0 to 3 for filters A to D, which look at the text alone. The column `text` holds no nulls."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    upper = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    counted = docs.withColumns({"__words": F.size(words).cast("long"), "__kinds": F.size(F.array_distinct(words)).cast("long"), "__upper": upper.cast("long")})
    a, b, c = F.col("__words") < 50, 100 * F.col("__kinds") < 65 * F.col("__words"), 100 * F.col("__upper") > 5 * F.length(text)
    bits = [F.when(x, 1 << i).otherwise(0) for i, x in enumerate((a, b, c, F.col(text).rlike(r"[#$%&*|]")))]
    return counted.withColumn("fails", bits[0] + bits[1] + bits[2] + bits[3]).drop("__words", "__kinds", "__upper")


def survival_word(fails: Column) -> Column:
    """The word of a document that fails the filters of the bits in `fails`: bit s is set if none of them is in s."""
    words = [sum(1 << s for s in range(SUBSETS) if not s & f) for f in range(SUBSETS)]
    return F.element_at(F.array(*[F.lit(w).cast("long") for w in words]), fails + 1)


def positional_popcount(words: np.ndarray) -> np.ndarray:
    """Of each of the 32 bits, how many words have it.

    A carry-save adder takes three words of one weight to a word of that weight and a carry of twice it,
    bit by bit; when at most two words of a weight are left, their bits are added up, and the carries follow.
    """
    counts, weight, level = np.zeros(SUBSETS, np.int64), 1, words.astype(np.uint32)
    while len(level):
        carries = [level[:0]]
        while len(level) > 2:
            n = len(level) // 3
            a, b, c = level[:n], level[n : 2 * n], level[2 * n : 3 * n]
            half = a ^ b
            carries.append(a & b | half & c)
            level = np.concatenate([half ^ c, level[3 * n :]])
        for word in level:
            counts += weight * ((int(word) >> np.arange(SUBSETS)) & 1)
        level, weight = np.concatenate(carries), 2 * weight
    return counts


def survivors(words: DataFrame) -> DataFrame:
    """words: (part, word, good, toxic). One row for each part, with counts: 32 survivor counts for each of LABELS."""

    def count(batches):
        held: dict[str, np.ndarray] = {}

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([x.ravel() for x in held.values()], pa.list_(pa.int64()))], names=["part", "counts"])
            held.clear()
            return out

        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            code, word, good, toxic = (x.to_numpy(zero_copy_only=False) for x in (coded.indices, *(batch.column(i) for i in (1, 2, 3))))
            order = np.argsort(code, kind="stable")
            edges = np.searchsorted(code[order], np.arange(len(coded.dictionary) + 1))
            for part, i, j in zip(coded.dictionary.to_pylist(), edges[:-1], edges[1:]):
                at = order[i:j]
                held[part] = held.get(part, 0) + np.stack([positional_popcount(word[at]), positional_popcount(word[at[good[at]]]), positional_popcount(word[at[toxic[at]]])])
            if len(held) > HELD_PARTS:
                yield rows()
        if held:
            yield rows()

    counted = in_arrow(words.select("part", "word", "good", "toxic"), count, "part string, counts array<bigint>")
    sums = counted.groupBy("part").agg(*[F.sum(F.col("counts")[i]).alias(f"c{i}") for i in range(SUBSETS * len(LABELS))])
    return sums.select("part", F.array(*[c for c in sums.columns if c != "part"]).alias("counts"))


def order_report(counts: DataFrame) -> DataFrame:
    """From survivors(): one row for each part, order of the filters and step."""
    steps = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, f in enumerate(order, 1):
            steps.append({"filter_order": "".join(FILTERS[i] for i in order), "step": step, "f": f, "before": before, "after": before | 1 << f})
            before |= 1 << f
    kinds = "array<struct<filter_order: string, step: int, f: int, before: int, after: int>>"

    def removed_in_all_orders(f: int) -> Column:
        n = len(FILTERS)
        apart = [s for s in range(SUBSETS) if not s >> f & 1]
        terms = [(F.col("counts")[s] - F.col("counts")[s | 1 << f]) * factorial(s.bit_count()) * factorial(n - 1 - s.bit_count()) for s in apart]
        return sum(terms[1:], terms[0])

    rows = counts.withColumn("shapleys", F.array(*[removed_in_all_orders(f) for f in range(len(FILTERS))]))
    rows = rows.select("part", "counts", "shapleys", F.inline(F.from_json(F.lit(json.dumps(steps)), kinds)))
    at = lambda label, subset: F.get("counts", F.lit(SUBSETS * LABELS.index(label)) + subset)
    lost = lambda label: at(label, F.col("before")) - at(label, F.col("after"))
    bit, every = F.call_function("shiftleft", F.lit(1), F.col("f")), SUBSETS - 1
    return rows.select(
        "part",
        "filter_order",
        "step",
        at("all", F.col("after")).alias("kept"),
        lost("all").alias("removed"),
        (at("all", F.lit(0)) - at("all", bit) - lost("all")).alias("redundant"),
        (at("all", every - bit) - at("all", F.lit(every))).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        F.get("shapleys", F.col("f")).alias("shapley"),
    )


def document_words(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each row of docs: (part, word, good, toxic). See audit_filters(); the caller discards the returned table."""
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[source_col].cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = text_failures(rows, "text").select("id", "part", "fails", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))
    rows = written(rows)
    # of each text that comes more than once the smallest id; one row for each such text
    first = written(rows.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1"))
    marked = rows.join(first.select(F.col("digest").alias("__d")), F.col("digest") == F.col("__d"), "left_anti").select("id", "part", "fails")
    again = salted_join(rows, first, "digest", F.xxhash64("id", "part"))
    again = again.select("id", "part", (F.col("fails") + F.when(F.col("id") > F.col("first"), 1 << 4).otherwise(0)).alias("fails"))
    marked = marked.union(again).withColumn("word", survival_word(F.col("fails")))
    known = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__l")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    told = marked.filter("id is not null").join(known, F.col("id") == F.col("__l"), "left")
    told = told.select("part", "word", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    out = written(told.union(marked.filter("id is null").select("part", "word", F.lit(False), F.lit(False))))
    discard(rows, first)
    return out


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """For each part (source), each order of the five filters and each step, what the step's filter does.

    The filters fail a text A: of fewer than 50 words; B: of fewer than 65 distinct words in 100; C: with
    more than 5 of 100 code points in A to Z; D: with any of #$%&*|; E: that a smaller id's text equals
    (by SHA-256), in the whole table. Returns part, filter_order, step, kept, removed, redundant (fails
    here too but was removed before), unique_fails (fails this filter only), good_lost, toxic_lost,
    shapley (what the filter removes, summed over all orders).

    A null text is empty: it fails A, and E if a smaller id's text is empty or null too. A null source is
    the part ''. A null id is smaller than none and equals no label; of rows that repeat an id none is
    smaller. A document is good (toxic) if any label row of its id says so. Other columns play no part.
    An empty table gives an empty one.
    """
    words = document_words(docs, labels, id_col, text_col, source_col)
    counts = written(survivors(words))
    discard(words)
    return order_report(counts)
