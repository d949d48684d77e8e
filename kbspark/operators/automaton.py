"""Which of many patterns do texts hold: Aho-Corasick automata, each over a share of the patterns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Patterns of an automaton, and texts that one task runs through it, on average, at most.
SHARD_PATTERNS, TEXT_ROWS = 100_000, 10_000


def contained(texts: DataFrame, patterns: DataFrame, key: str = "repo_id") -> DataFrame:
    """(key, query_id, part): the patterns that a text holds, each once.

    texts: (key, query_id, q); patterns: (key, part), distinct and not empty. The patterns of a key are dealt
    into shards by their number and its texts into blocks; each shard becomes an automaton in each task
    that pairs it with a block, and every text is read once for each shard. The automaton finds all
    patterns that end at a character at once, so neither substrings nor pairs of texts and patterns are made.
    """
    count = lambda rows, most, name: rows.groupBy(key).agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    dealt = count(texts, TEXT_ROWS, "nt").join(count(patterns, SHARD_PATTERNS, "ns"), key)
    left = texts.join(dealt, key).withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("nt")).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("ns") - 1)))
    right = patterns.join(dealt, key).withColumn("shard", F.pmod(F.xxhash64("part"), F.col("ns")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("nt") - 1)))

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        import ahocorasick

        found: list[tuple] = []
        if len(a) and len(b):
            machine = ahocorasick.Automaton()
            for part in b["part"]:
                machine.add_word(part, part)
            machine.make_automaton()
            for q, text in zip(a["query_id"], a["q"]):
                found += [(a[key].iat[0], q, part) for part in {p for _, p in machine.iter(text)}]
        return pd.DataFrame(found, columns=[key, "query_id", "part"])

    kind = lambda c: texts.schema[c].dataType.simpleString()
    # both sides may come from one table: their columns get identities of their own
    left, right = (rows.select(*[F.col(c).alias(c) for c in columns]) for rows, columns in ((left, [key, "query_id", "q", "block", "shard"]), (right, [key, "part", "block", "shard"])))
    by = [key, "shard", "block"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(search, f"{key} {kind(key)}, query_id {kind('query_id')}, part string")
