"""Source divergence audit by hash-consed segment trees.

The terms that a language keeps have ids in the order of their bytes. Over each stretch of ids a group
(language, source) has a segment tree of its counts; subtrees with the same counts, of whatever groups
and at whatever ids, are one node. Two groups' trees are walked together, level by level; a pair of
nodes that comes up again in the walk of the same two groups is priced once. Prices are sums of
f = floor((p - q)^2 / (p + q)) over the terms, with p and q the groups' smoothed shares in billionths.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbspark.llm.common import discard, in_arrow, slices, written

#: Documents of its language that hold a kept term, at least.
LEAST_DOCUMENTS = 10
#: Terms of a group that are reported.
TOP_TERMS = 10
#: Ids of a stretch, a power of two; groups of a block, on average, at most.
STRETCH, BLOCK = 1 << 14, 32
#: Bytes of a text that are cut into terms at once; entries that a task counts before it hands them on.
PIECE_BYTES, HELD = 1 << 20, 400_000

# [^\x00-\x40\x5B-\x60\x7B-\x7F]+ on UTF-8: every byte of a code point from 0x80 on is 0x80 or above
_TERM, _BREAK = re.compile(rb"[A-Za-z\x80-\xff]+"), re.compile(rb"[^A-Za-z\x80-\xff]")


def _terms_of(text: bytes):
    """The terms of a text, A-Z lower-cased, in lists of about PIECE_BYTES; a cut falls between two terms."""
    start = 0
    while start < len(text):
        cut = _BREAK.search(text, min(len(text), start + PIECE_BYTES))
        end = cut.end() if cut else len(text)
        yield _TERM.findall(text[start:end].lower())
        start = end


def count_terms(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, documents): occurrences, and documents that hold the term; and a row with a null term for each group."""

    def count(batches):
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def rows():
            keys = [(g, t) for g, (n, _) in held.items() for t in n]
            term = pa.array([t for _, t in keys] + [None] * len(held), pa.binary()).cast(pa.string())
            lang, source = (pa.array([g[i] for g, _ in keys] + [g[i] for g in held], pa.string()) for i in (0, 1))
            counts = [pa.array([held[g][i][t] for g, t in keys] + [0] * len(held), pa.int64()) for i in (0, 1)]
            held.clear()
            return pa.RecordBatch.from_arrays([lang, source, term, *counts], names=["lang", "source", "term", "n", "documents"])

        for batch in slices(batches, 2):
            for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                n, documents = held.setdefault((lang, source), (Counter(), Counter()))
                seen = set()
                for terms in _terms_of(text):
                    n.update(terms)
                    seen.update(terms)
                documents.update(seen)
            if sum(len(n) for n, _ in held.values()) > HELD:
                yield rows()
        if held:
            yield rows()

    told = [F.coalesce(docs[c].cast("string"), F.lit("")) for c in (lang_col, source_col)]
    rows = docs.select(told[0].alias("lang"), told[1].alias("source"), F.coalesce(docs[text_col], F.lit("")).cast("binary").alias("text"))
    return in_arrow(rows, count, "lang string, source string, term string, n bigint, documents bigint")


# -- trees


class Forest:
    """Segment trees over equally many counts, with equal subtrees shared.

    values: the distinct leaves (-1: no term); children: from the leaves up, the two lower nodes of each
    node; roots: of each tree.
    """

    def __init__(self, counts: np.ndarray):
        self.values, ids = np.unique(counts, return_inverse=True)
        ids, n = ids.reshape(counts.shape), len(self.values)
        self.children: list[tuple[np.ndarray, np.ndarray]] = []
        while ids.shape[1] > 1:
            nodes, inverse = np.unique(ids[:, ::2] * n + ids[:, 1::2], return_inverse=True)
            self.children.append((nodes // n, nodes % n))
            ids, n = inverse.reshape(len(ids), -1), len(nodes)
        self.roots = ids[:, 0]


def price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)), exactly: p and q are at most 1 + 10^9."""
    return (p - q) ** 2 // (p + q)


def billionths(count: np.ndarray, total: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / (total + 2 terms)), three digits at a time, so exactly up to totals of 9 * 10^15."""
    rest, whole = count + 2, total + 2 * terms
    out = np.zeros_like(rest)
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // whole, rest % whole
    return out + 1


def walk(forest: Forest, a: np.ndarray, b: np.ndarray, totals: np.ndarray, terms: int) -> np.ndarray:
    """The price of each pair of trees (a[i], b[i]); totals: of each tree."""
    pair, x, y = np.arange(len(a)), forest.roots[a], forest.roots[b]
    above = []
    for left, right in reversed(forest.children):
        n = len(left) and int(max(left.max(), right.max())) + 1
        key = (np.r_[pair, pair] * n + np.r_[left[x], right[x]]) * n + np.r_[left[y], right[y]]
        known, inverse = np.unique(key, return_inverse=True)
        above.append(inverse)
        y, x, pair = known % n, known // n % n, known // (n * n)
    u, v = forest.values[x], forest.values[y]
    cost = np.where(u < 0, 0, price(billionths(np.maximum(u, 0), totals[a[pair]], terms), billionths(np.maximum(v, 0), totals[b[pair]], terms)))
    for inverse in reversed(above):
        opened = cost[inverse]
        cost = opened[: len(opened) // 2] + opened[len(opened) // 2 :]
    return cost


_FOUND = "lang string, part string, source string, item string, id bigint, value bigint"


def _price_tile(rows: pd.DataFrame) -> pd.DataFrame:
    """A stretch of a language's ids, and the groups of two blocks (or of one): prices of all pairs, and each group's best terms."""
    lang, stretch, i, j = (rows[c].iat[0] for c in ("lang", "stretch", "i", "j"))
    whole = rows[rows["source"].isna()].iloc[0]  # the language itself
    groups = rows[rows["source"].notna()].sort_values(["block", "source"], ignore_index=True)
    ids, width = np.asarray(whole["slots"]), 1
    order = np.argsort(ids)
    ids = ids[order]
    while width < len(ids):
        width *= 2
    counts = np.zeros((len(groups) + 1, width), np.int64)
    counts[:, len(ids) :] = -1
    counts[-1, : len(ids)] = np.asarray(whole["counts"])[order]
    for g, (slots, n) in enumerate(zip(groups["slots"], groups["counts"])):
        if slots is not None and len(slots):
            counts[g, np.searchsorted(ids, np.asarray(slots))] = np.asarray(n)
    totals, terms = np.r_[groups["total"].to_numpy(np.int64), int(whole["total"])], int(whole["terms"])
    names, block = groups["source"].tolist(), groups["block"].to_numpy()
    forest, found = Forest(counts), []
    for a in range(len(groups)):
        if block[a] != i:
            continue
        others = np.arange(a + 1, len(groups)) if i == j else np.flatnonzero(block == j)
        if len(others):
            sums = walk(forest, np.full(len(others), a), others, totals, terms)
            found += [(lang, "pair", names[a], names[b], None, int(s)) for b, s in zip(others, sums)]
        if i == j:
            here = np.flatnonzero(counts[a] > 0)
            # each distinct pair of leaves of the group and its language is priced once
            pairs, inverse = np.unique(np.stack([counts[a, here], counts[-1, here]]), axis=1, return_inverse=True)
            p, q = billionths(pairs[0], totals[a], terms), billionths(pairs[1], totals[-1], terms)
            value = np.where(p > q, price(p, q), -1)[inverse.ravel()]
            best = np.argsort(-value, kind="stable")[:TOP_TERMS]
            found += [(lang, "term", names[a], None, int(stretch) * STRETCH + int(ids[here[t]]), int(value[t])) for t in best if value[t] >= 0]
    out = pd.DataFrame(found, columns=["lang", "part", "source", "item", "id", "value"])
    return out.astype({"id": "Int64"})


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """How the sources of a language differ in their words: lang, source, part, item, value, rank.

    Terms are runs of letters and of all code points from 0x80 on, A-Z lower-cased; a language keeps those
    in LEAST_DOCUMENTS or more of its documents. Part `pair`: every other source of the language by
    divergence; part `term`: the TOP_TERMS terms that a source has above its language's share. Ranks go by
    value, ties by the item's bytes. Numbers are exact, for up to 9 * 10^15 occurrences in a group.

    Null texts, languages and sources count as ''. A source without kept terms is compared like others; a
    language that keeps no term has pairs of value 0. Repeated rows count as often as they come; ids and
    other columns play no part. An empty table gives an empty one.
    """
    counts = written(count_terms(docs, text_col, lang_col, source_col).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents")))
    kept = counts.filter("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("documents").alias("documents")).filter(F.col("documents") >= LEAST_DOCUMENTS)
    # ids go up with the terms' bytes, with gaps between tasks
    kept = kept.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term").select("lang", "term", "total", F.monotonically_increasing_id().alias("id"))
    kept = written(kept)
    stretch, slot = F.floor(F.col("id") / STRETCH).alias("stretch"), F.pmod("id", F.lit(STRETCH)).cast("int").alias("slot")
    cells = written(counts.filter("term is not null").join(kept, ["lang", "term"]).select("lang", "source", stretch, slot, "n"))

    listed = lambda n: (F.collect_list("slot").alias("slots"), F.collect_list(n).alias("counts"))  # noqa: E731  of STRETCH at most, in one order
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("whole"))
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").withColumn("total", F.coalesce("total", F.lit(0)))
    sizes = groups.groupBy("lang").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    groups = groups.join(sizes, "lang").join(langs, "lang", "left").withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
    groups = written(groups)

    # every group has a row for every stretch of its language, as terms that it lacks are priced too
    stretches = kept.select("lang", stretch).distinct()
    rows = groups.join(stretches, "lang").join(cells.groupBy("lang", "source", "stretch").agg(*listed("n")), ["lang", "source", "stretch"], "left")
    tiles = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, "block").alias("i"), F.greatest(o, "block").alias("j")))
    columns = ["lang", "stretch", "source", "block", "total", "terms", "slots", "counts"]
    rows = rows.select(*columns, F.inline(tiles))
    whole = kept.select("lang", stretch, slot, "total").groupBy("lang", "stretch").agg(*listed("total")).join(langs, "lang").join(sizes, "lang")
    whole = whole.select("lang", "stretch", F.lit(None).cast("string").alias("source"), F.lit(-1).alias("block"), F.col("whole").alias("total"), "terms", "slots", "counts", "blocks")
    every = F.flatten(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.transform(F.sequence(i, F.col("blocks") - 1), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    rows = rows.unionByName(whole.select(*columns, F.inline(every)))
    found = written(rows.groupBy("lang", "stretch", "i", "j").applyInPandas(_price_tile, _FOUND))

    pairs = found.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    other = groups.filter("terms is null").select("lang", "source")
    other = other.join(other.withColumnRenamed("source", "item"), "lang").filter("source < item").withColumn("value", F.lit(0).cast("long"))
    pairs = pairs.unionByName(other)
    pairs = pairs.unionByName(pairs.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(best).alias("rank"))
    first = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "id")
    terms = found.filter("part = 'term'").select("lang", "source", "id", "value", F.row_number().over(first).alias("rank")).filter(F.col("rank") <= TOP_TERMS)
    terms = terms.join(kept.select("lang", "id", F.col("term").alias("item")), ["lang", "id"]).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    out = written(pairs.union(terms))
    discard(counts, kept, cells, groups, found)
    return out
