"""Removal of long repeats, by a logarithmic family of sparse suffix arrays.

A repeat is a string of `length` bytes that starts in more than one place. The arrays hold a sample of
the suffixes, chosen by content: of every such string the anchor, which is the least hash of the
32-byte grams in its first half. Wherever the string occurs, its anchor stands at the same place in it,
and the suffixes there agree in half its length and more. An array is a table of those suffixes, each
cut to DEPTH bytes, in buckets by hash and in each bucket in the order of the bytes; suffixes that agree
so far are one entry, with the least and the largest of their places.

A new batch of documents gets such an array, and arrays of equal rank merge, so that a suffix moves a
logarithmic number of times. The few arrays there are after the last batch are merge-scanned against
each other for suffixes that agree in DEPTH bytes (all lie in the same buckets and the same order, so
nothing is shuffled).

The matches are then settled exactly. The strings that an anchor stands for are grouped into cells of
32 neighbours; a cell whose bytes occur twice as a whole is settled, and only cells that share their
core but not their whole are compared string by string. All of it is grouping by digests of 64 bits
and more: no passage, however common, is ever gathered in one task or turned into pairs.

Shorter passages, told by their number of words, are found through the same arrays: an anchor depends on
half of `length` alone, so every shared string of that size stands at a matched one. Runs of words that are
shorter still are few in prose and are all looked up.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kbspark.llm.common import WORD, discard, free_shuffles, in_arrow, salted_join, shared_dir, slices, written
from kbspark.llm.hashing import SEPARATOR, Prefixes, mix

GRAM, CELL = 32, 32
#: Bytes by which suffixes are ordered and matched.
DEPTH = 32
#: Runs of words that begin at so many neighbouring words make a cell.
WORD_CELL = 8
#: Documents arrive in batches of about this many bytes of text, in four batches at least.
BATCH_BYTES, LEAST_BATCHES = 64 << 30, 4
#: Bytes of text whose anchors are looked for at once; a longer text is taken in stretches.
STRETCH_BYTES = 1 << 18
#: Bytes of texts whose matches are settled at once, unless one text is longer.
SETTLED_BYTES = 1 << 18


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, prefixes: Prefixes, stops: np.ndarray | None = None):
    """For the texts data[start:end]: anchors, and the first and last start of the strings that each stands for.

    stops: where the starts of strings end, if shorter strings (of half the length at least) count as well.
    """
    grams = len(data) - GRAM + 1
    span = length // 2 - GRAM + 1
    stops = ends - length + 1 if stops is None else stops
    long = stops > starts
    if not long.any():
        return (np.zeros(0, np.int64),) * 3
    least, size = prefixes.every(GRAM), 1
    least &= np.uint64(0xFFFFFFFF00000000)
    least |= np.arange(grams, dtype=np.uint64)
    while 2 * size <= span:  # least of 1, 2, 4 ... grams; two such runs that overlap make a window
        least, size = np.minimum(least[:-size], least[size:]), 2 * size
    windows = grams - span + 1
    least = np.minimum(least[:windows], least[span - size : span - size + windows])
    least &= np.uint64(0xFFFFFFFF)
    step = np.zeros(windows + 1, np.int32)
    np.add.at(step, starts[long], 1)
    np.add.at(step, stops[long], -1)
    inside = np.flatnonzero(np.cumsum(step[:-1]) > 0)
    owner = least[inside].astype(np.int64)
    change = np.flatnonzero(np.diff(owner)) + 1
    first = np.r_[0, change]
    return owner[first], inside[first], inside[np.r_[change, len(inside)] - 1]


def _word_runs(data: np.ndarray, starts: np.ndarray, words: int):
    """Where words begin in the texts that begin at starts (none is empty); the first word of each run of words in one text, and where the run ends."""
    inside = ~SEPARATOR[data]
    before, after = np.r_[False, inside[:-1]], np.r_[inside[1:], False]
    before[starts] = False
    after[starts[1:] - 1] = False
    begin, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    text = np.searchsorted(starts, begin, "right")
    n = max(0, len(begin) - words + 1)
    run = np.flatnonzero(text[:n] == text[words - 1 :]) if n else np.zeros(0, np.int64)
    return begin, end, run, end[run + words - 1]


def _run_hashes(prefixes: Prefixes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix(mix(prefixes.of(begin, end - begin), 60) + (end - begin).astype(np.uint64), 61).view(np.int64)


def _emit_suffixes(length: int, schema: T.StructType, words: int | None = None):
    """The suffixes at anchors; with words, also (no suffix) the hashes of runs of so many words that are shorter than half the length."""
    least = length // 2 if words else length

    def stretches(batches):
        """(batch, row of each stretch, its place in the text, its bytes, where starts of strings end): strings begin in one stretch each."""
        for batch in slices(batches, 2, STRETCH_BYTES):
            texts = batch.column(2).to_pylist()
            if len(texts) > 1 or len(texts[0]) <= STRETCH_BYTES:
                yield batch, np.arange(len(texts)), np.zeros(len(texts), np.int64), texts, np.array([len(t) - least + 1 for t in texts])
                continue
            for i in range(0, len(texts[0]), STRETCH_BYTES):
                yield batch, np.zeros(1, np.int64), np.array([i]), [texts[0][i : i + STRETCH_BYTES + length - 1]], np.array([min(STRETCH_BYTES, len(texts[0]) - i - least + 1)])

    def short_runs(batch, rows, places, texts, data, starts):
        begin, _, run, end = _word_runs(data, starts, words)
        first = begin[run]
        short = end - first < least
        if places[0]:
            short &= first > 0  # perhaps within a word; the stretch before has it
        if len(texts) == 1 and len(batch.column(2)[0].as_buffer()) > places[0] + len(data):
            short &= end < len(data)  # likewise, and the next stretch has it
        if short.any():
            first, end = first[short], end[short]
            row = pa.array(rows[np.searchsorted(starts, first, "right") - 1])
            yield pa.RecordBatch.from_arrays([pa.nulls(len(first), pa.binary()), batch.column(0).take(row), batch.column(1).take(row), pa.array(_run_hashes(Prefixes(data), first, end))], names=schema.names)

    def run(batches):
        for batch, rows, places, texts, stops in stretches(batches):
            data = np.frombuffer(b"".join(texts), np.uint8)
            ends = np.cumsum([len(t) for t in texts])
            starts = ends - [len(t) for t in texts]
            if words:
                yield from short_runs(batch, rows, places, texts, data, starts)
            at, first, last = anchors(data, starts, ends, length, Prefixes(data, rough=True), starts + stops)
            if not len(at):
                continue
            own = np.searchsorted(ends, first, "right")
            suffix = np.lib.stride_tricks.sliding_window_view(data, DEPTH)[at]
            bytes_ = pa.Array.from_buffers(pa.binary(DEPTH), len(at), [None, pa.py_buffer(np.ascontiguousarray(suffix))]).cast(pa.binary())
            base, row = starts[own] - places[own], pa.array(rows[own])
            yield pa.RecordBatch.from_arrays(
                [bytes_, batch.column(0).take(row), batch.column(1).take(row), pa.array(((at - base) * length + at - first) * length + at - last)],
                names=schema.names,
            )

    return run


def _bucketed(rows: DataFrame, key: str, buckets: int) -> DataFrame:
    """The rows as a table in buckets by the key and in its order, so that joins by the key don't shuffle them."""
    name, path = f"suffixes_{uuid.uuid4().hex}", shared_dir(rows.sparkSession)
    rows.write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    out = rows.sparkSession.table(name)
    out.kbspark_folder, out.kbspark_table = path, name
    return out


def _drop(*tables: DataFrame) -> None:
    """Deletes what _bucketed() wrote."""
    for df in tables:
        df.sparkSession.sql(f"DROP TABLE {df.kbspark_table}")
    discard(*tables)
    free_shuffles(tables[0].sparkSession)


class SuffixLevels:
    """The family of arrays: tables (suffix, lo, hi, n) of the least and largest place and the number of rows of each suffix; sizes double from rank to rank."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[tuple[int, DataFrame]] = []

    def add(self, suffixes: DataFrame, last: bool = False) -> None:
        """suffixes: (suffix, place) of one batch. Makes its array and merges equal ranks; not for the last batch, as no scan of a later one gains by it."""
        new = suffixes.groupBy("suffix").agg(F.min("place").alias("lo"), F.max("place").alias("hi"), F.count("*").alias("n"))
        rank, new = 0, self._array(new)
        while not last and self.levels and self.levels[-1][0] == rank:
            _, old = self.levels.pop()
            merged = self._array(self._merged(old, new))
            _drop(old, new)
            rank, new = rank + 1, merged
        self.levels.append((rank, new))

    @staticmethod
    def _scanned(a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.select("suffix", F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.col("n").alias("n2"))
        return a.join(b, "suffix").filter("least(lo, lo2) != greatest(hi, hi2)").select("suffix", (F.col("n") + F.col("n2")).alias("n"))

    @staticmethod
    def _merged(a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.select("suffix", F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.col("n").alias("n2"))
        n = F.coalesce("n", F.lit(0)) + F.coalesce("n2", F.lit(0))
        return a.join(b, "suffix", "full_outer").select("suffix", F.least("lo", "lo2").alias("lo"), F.greatest("hi", "hi2").alias("hi"), n.alias("n"))

    def _array(self, rows: DataFrame) -> DataFrame:
        return _bucketed(rows, "suffix", self.buckets)

    def matched(self) -> DataFrame:
        """(suffix, n): the suffixes found in two places, in any array or scan of two, and about how often."""
        arrays = [level for _, level in self.levels]
        out = None
        for found in [*(a.filter("lo != hi").select("suffix", "n") for a in arrays), *(self._scanned(a, b) for i, a in enumerate(arrays) for b in arrays[:i])]:
            out = found if out is None else out.union(found)
        return out.groupBy("suffix").agg(F.sum("n").alias("n"))

    def discard(self) -> None:
        """Deletes the arrays."""
        _drop(*(level for _, level in self.levels))


def _lists(batch: pa.RecordBatch):
    """Of a batch (t, text, list of numbers): all texts' bytes, where each text begins, each number's row and the numbers."""
    texts = batch.column(1).to_pylist()
    starts = np.cumsum([0, *map(len, texts)])
    rows = np.repeat(np.arange(len(texts)), np.asarray(pa.compute.list_value_length(batch.column(2))))
    return np.frombuffer(b"".join(texts), np.uint8), starts, rows, np.asarray(batch.column(2).flatten())


def _unpacked(anchor: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An anchor's place, and the first and last start of its strings."""
    at = anchor // (length * length)
    return at, at - anchor // length % length, at - anchor % length


def _each(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1 ... n of them, for each of the rows."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def _emit_cells(length: int):
    def run(batches):
        for batch in slices(batches, 1, SETTLED_BYTES):
            data, starts, rows, packed = _lists(batch)
            at, first, last = _unpacked(packed, length)
            final = np.diff(starts)[rows] - length
            held = first <= final  # the others only stand for shorter strings
            rows, at, first, last = rows[held], at[held], first[held], np.minimum(last, final)[held]
            low, high = (at - last) // CELL, (at - first) // CELL
            n = high - low + 1
            block, rows = _each(low, n), np.repeat(rows, n)
            anchor, a, b = (np.repeat(x, n) + starts[rows] for x in (at, first, last))
            begin, end = np.maximum(a, anchor - block * CELL - CELL + 1), np.minimum(b, anchor - block * CELL)
            prefixes = Prefixes(data)
            core = mix(prefixes.of(anchor - block * CELL, length - CELL + 1), 54) + mix(block.astype(np.uint64), 55)
            # the bytes of all strings of the cell, and which of the cell's strings there are
            whole = mix(prefixes.of(begin, end - begin + length), 56) + mix(((anchor - begin) * 65536 + anchor - end).astype(np.uint64), 57)
            cell = (begin - starts[rows]) * CELL + end - begin
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *[pa.array(mix(x, 58).view(np.int64)) for x in (core, whole)], pa.array(cell)], names=["t", "core", "whole", "cell"])

    return run


def _emit_strings(length: int):
    def run(batches):
        for batch in slices(batches, 1, SETTLED_BYTES):
            data, starts, rows, cell = _lists(batch)
            s = np.unique(_each(cell // CELL + starts[rows], cell % CELL + 1))
            found = mix(Prefixes(data).of(s, length), 59)
            rows = np.searchsorted(starts, s, "right") - 1
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(found.view(np.int64)), pa.array((s - starts[rows]) * CELL)], names=["t", "string", "cell"])

    return run


def _remove(length: int, kept_bytes: bool):
    def run(batches):
        for batch in slices(batches, 1, SETTLED_BYTES):
            data, starts, rows, cell = _lists(batch)
            begin = cell // CELL + starts[rows]
            edge = np.zeros(len(data) + 1, np.int32)
            np.add.at(edge, begin, 1)
            np.add.at(edge, begin + cell % CELL + length, -1)
            cover = np.cumsum(edge[:-1]) > 0
            opens = cover & ~np.r_[False, cover[:-1]]
            opens[starts[:-1]] = cover[starts[:-1]]  # a run ends with its text
            removed, spans = (np.add.reduceat(x, starts[:-1], dtype=np.int64) for x in (cover, opens))
            kept = [data[a:b][~cover[a:b]].tobytes() for a, b in zip(starts[:-1], starts[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(removed), pa.array(spans), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), *([pa.array(kept, pa.binary())] if kept_bytes else [])],
                names=["t", "removed", "spans", "cut_sha", *(["kept"] if kept_bytes else [])],
            )

    return run


def _emit_run_cells(length: int, words: int):
    """Runs of words that begin in the stretch of a matched anchor, WORD_CELL of them at a time: the bytes they have in common, and all of their bytes."""

    def run(batches):
        for batch in slices(batches, 1, SETTLED_BYTES):
            data, starts, rows, packed = _lists(batch)
            at, first, last = (x + starts[rows] for x in _unpacked(packed, length))
            order = np.argsort(first)
            at, first, last = at[order], first[order], last[order]
            begin, end, runs, stop = _word_runs(data, starts[:-1], words)
            own = np.searchsorted(first, begin[runs], "right") - 1
            held = (own >= 0) & (begin[runs] <= last[own]) & (stop - begin[runs] >= length // 2)
            runs, own = runs[held], own[held]
            if not len(runs):
                continue
            word = np.searchsorted(begin, at[own], "right") - 1  # the anchor's; a run's place before it is the same wherever it occurs
            block = (word - runs) // WORD_CELL
            edge = np.flatnonzero((np.diff(runs) != 1) | (np.diff(own) != 0) | (np.diff(block) != 0)) + 1
            a, b = np.r_[0, edge], np.r_[edge, len(runs)] - 1
            left, right, block, word = runs[a], runs[b], block[a], word[a]
            inner = word - block * WORD_CELL
            prefixes = Prefixes(data)
            core = mix(_run_hashes(prefixes, begin[inner], end[inner - WORD_CELL + words]).view(np.uint64) + block.astype(np.uint64), 62)
            whole = mix(_run_hashes(prefixes, begin[left], end[right + words - 1]).view(np.uint64) + ((word - left) * 65536 + word - right).astype(np.uint64), 63)
            row = np.searchsorted(starts, begin[left], "right") - 1
            cell = (begin[left] - starts[row]) * WORD_CELL + right - left
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *[pa.array(x.view(np.int64)) for x in (core, whole)], pa.array(cell)], names=["t", "core", "whole", "cell"])

    return run


def _emit_runs(words: int):
    def run(batches):
        for batch in slices(batches, 1, SETTLED_BYTES):
            data, starts, rows, cell = _lists(batch)
            begin, end, _, _ = _word_runs(data, starts[:-1], words)
            i = np.unique(_each(np.searchsorted(begin, cell // WORD_CELL + starts[rows]), cell % WORD_CELL + 1))
            row = np.searchsorted(starts, begin[i], "right") - 1
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(_run_hashes(Prefixes(data), begin[i], end[i + words - 1]))], names=["t", "run"])

    return run


def _sharing(held: DataFrame, short: DataFrame, length: int, words: int) -> DataFrame:
    """The texts (t) that have a run of words in common with another text. held: (t, text, around) of the matched; short: (t, run) of the runs that have no anchor.

    A cell that occurs as a whole in two texts tells of both. Cells of the other texts that share their core are compared run by run.
    """
    spark, digest = held.sparkSession, F.xxhash64("t")
    cells = written(in_arrow(held.select("t", "text", "around"), _emit_run_cells(length, words), "t binary, core bigint, whole bigint, cell bigint"))
    wholes = written(cells.groupBy("core", "whole").agg(F.count("*").alias("times"), F.min(digest).alias("lo"), F.max(digest).alias("hi")))
    cores = written(wholes.groupBy("core").agg(F.sum("times").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo != hi").select("core", "n"))
    free_shuffles(spark)
    known = written(salted_join(wholes, cores, "core", F.col("whole"), hashed=True).select(F.col("core").alias("__core"), "whole", F.col("times").alias("n"), F.expr("lo != hi").alias("both")))
    discard(wholes, cores)
    judged = written(salted_join(cells, known, "whole", F.xxhash64("t", "cell"), hashed=True).filter("core = __core").select("t", "core", "cell", "both"))
    discard(cells, known)
    free_shuffles(spark)
    told = written(judged.groupBy("t").agg(F.max("both").alias("both")))
    left = judged.join(told.filter("not both").select("t"), "t", "left_semi")
    # the cores of texts that are still to be told, with all the cells that have them
    asked = written(left.select("core").distinct().join(judged.groupBy("core").agg(F.count("*").alias("n")), "core"))
    opened = salted_join(judged.select("t", "core", "cell"), asked, "core", F.xxhash64("t", "cell"), hashed=True).groupBy("t").agg(F.collect_set("cell").alias("cells"))
    runs = in_arrow(held.join(opened, "t").select("t", "text", "cells"), _emit_runs(words), "t binary, run bigint")
    runs = written(runs.union(short).distinct())
    twice = written(runs.groupBy("run").agg(F.count("*").alias("n")).filter("n > 1"))
    single = salted_join(runs, twice, "run", digest, hashed=True).select("t")
    out = written(told.filter("both").select("t").union(single).distinct())
    discard(judged, told, asked, runs, twice)
    free_shuffles(spark)
    return out


def remove_repeats(docs: DataFrame, length: int = 400, batches: int | None = None, id_col: str = "doc_id", text_col: str = "text", kept_bytes: bool = False, passage_words: int | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, has_repeat (and `kept`, the bytes left).

    Removes each byte covered by a string of `length` bytes (100 at least) that also starts anywhere
    else, in the same text or another; all is judged on the input. Nothing crosses documents. A null
    text counts as empty. A text that is there twice or more is removed whole, if it is long enough.
    Ids may be null or repeated: rows are told apart by their texts, and equal texts have equal
    results. Other columns play no part. An empty table gives an empty one. batches: others than by
    BATCH_BYTES; the result is the same.

    passage_words: adds has_passage, whether the text holds so many words in a row (16 at least; what stands
    between them included) that another row's text also holds, however few bytes they are. Nothing is
    removed for it.
    """
    if length < 100:
        raise ValueError("length must be 100 bytes at least")
    if passage_words is not None and passage_words < 2 * WORD_CELL:
        raise ValueError(f"passage_words must be {2 * WORD_CELL} at least")
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    texts = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("sha", F.sha2("text", 256))
    texts = texts.withColumn("t", F.substring(F.unhex("sha"), 1, 16))
    many = [F.col("text").cast("string").rlike(rf"^[\x20\x09-\x0D]*+(?:{WORD}+[\x20\x09-\x0D]++){{{passage_words - 1}}}[^\x20\x09-\x0D]").alias("many")] if passage_words else []
    base = written(texts.select("doc_id", "t", "sha", F.octet_length("text").cast("long").alias("n_bytes"), *many))
    if batches is None:
        batches = max(LEAST_BATCHES, -(-(base.agg(F.sum("n_bytes")).first()[0] or 0) // BATCH_BYTES))
    doc_id = docs.select(F.col(id_col).alias("doc_id")).schema[0]
    schema = T.StructType([T.StructField("suffix", T.BinaryType()), T.StructField("t", T.BinaryType()), doc_id, T.StructField("anchor", T.LongType())])
    # an anchor's place, and how far before it its first and last strings begin, in one number
    least = min(length, 2 * passage_words - 1) if passage_words else length
    found = in_arrow(texts.filter(F.octet_length("text") >= least).select("t", "doc_id", "text"), _emit_suffixes(length, schema, passage_words), schema)
    # what one task reads arrives together; batch -1 has the runs of words that are short
    suffixes = written(found.withColumn("batch", F.when(F.col("suffix").isNull(), F.lit(-1)).otherwise(F.pmod(F.spark_partition_id(), F.lit(batches)))), "batch")

    family = SuffixLevels(spark)
    for b in range(batches):
        family.add(suffixes.filter(F.col("batch") == b).select("suffix", F.xxhash64("t", "anchor").alias("place")), last=b == batches - 1)
    # suffixes meet again by digest: two that share one only add something to compare
    matched = family.matched().groupBy(F.xxhash64("suffix").alias("key")).agg(F.sum("n").alias("n"))
    matched = written(matched)
    family.discard()
    hits = salted_join(suffixes.filter("batch >= 0").select(F.xxhash64("suffix").alias("key"), "t", "doc_id", "anchor"), matched, "key", F.xxhash64("t", "anchor"), hashed=True)
    around = written(hits.groupBy("t").agg(F.min("doc_id").alias("__first"), F.collect_set("anchor").alias("around")))
    short = suffixes.filter("batch = -1").select("t", F.col("anchor").alias("run"))
    if passage_words:
        short = written(short.distinct())
    discard(suffixes, matched)
    free_shuffles(spark)
    # one of the rows that hold the text, or those that share its id
    one = texts.select("t", F.col("doc_id"), "text").join(around.withColumnRenamed("t", "__t"), (F.col("t") == F.col("__t")) & F.col("doc_id").eqNullSafe(F.col("__first")))
    held = _bucketed(one.select("t", "text", "around").dropDuplicates(["t"]), "t", family.buckets)
    discard(around)
    free_shuffles(spark)
    if passage_words:
        sharing = _sharing(held, short, length, passage_words)
        discard(short)

    # a cell's first string, and how far from it the last begins, in one number
    cells = written(in_arrow(held.select("t", "text", "around"), _emit_cells(length), "t binary, core bigint, whole bigint, cell bigint"))
    wholes = written(cells.groupBy("core", "whole").agg(F.count("*").alias("n"), F.min(F.xxhash64("t")).alias("one")))
    free_shuffles(spark)
    cores = written(wholes.groupBy("core").agg(F.count("*").alias("kinds"), F.sum("n").alias("n")).filter("n > 1"))
    known = salted_join(wholes.withColumnRenamed("n", "times"), cores.select("core", F.col("kinds").alias("n")), "core", F.col("whole"), hashed=True)
    known = written(known.select(F.col("core").alias("__core"), "whole", "one", F.col("times").alias("n"), F.col("n").alias("kinds")))
    discard(wholes, cores)
    free_shuffles(spark)
    judged = salted_join(cells, known, "whole", F.xxhash64("t", "cell"), hashed=True).filter("core = __core")
    judged = written(judged.select("t", "cell", (F.col("n") > 1).alias("settled"), F.expr("kinds > 1 and (n = 1 or xxhash64(t) = one)").alias("open")))
    discard(cells, known)
    free_shuffles(spark)
    opened = judged.filter("open").groupBy("t").agg(F.collect_list("cell").alias("cells"))
    strings = written(in_arrow(held.join(opened, "t").select("t", "text", "cells"), _emit_strings(length), "t binary, string bigint, cell bigint"))
    twice = written(strings.groupBy("string").agg(F.count("*").alias("n")).filter("n > 1"))
    free_shuffles(spark)
    singles = salted_join(strings, twice, "string", F.xxhash64("t", "cell"), hashed=True).select("t", "cell")
    spans = judged.filter("settled").select("t", "cell").union(singles).groupBy("t").agg(F.collect_list("cell").alias("cuts"))
    cut = in_arrow(held.join(spans, "t").select("t", "text", "cuts"), _remove(length, kept_bytes), "t binary, removed bigint, spans bigint, cut_sha string" + ", kept binary" * kept_bytes)
    cut = written(cut)
    discard(judged, strings, twice)
    _drop(held)

    copies = base.groupBy("t").agg(F.count("*").alias("n")).filter("n > 1")
    found = base.join(copies, "t", "left").join(cut, "t", "left")
    if passage_words:
        found = found.join(sharing.withColumn("shares", F.lit(True)), "t", "left")
    whole = F.coalesce((F.col("n") > 1) & (F.col("n_bytes") >= length), F.lit(False))
    out = found.select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256().hexdigest())).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
        (whole | F.col("removed").isNotNull()).alias("has_repeat"),
        *([F.when(whole, F.lit(b"")).otherwise(F.col("kept")).alias("kept")] if kept_bytes else []),
        *([F.coalesce(F.col("shares"), (F.col("n") > 1) & F.col("many"), F.lit(False)).alias("has_passage")] if passage_words else []),
    )
    return out
