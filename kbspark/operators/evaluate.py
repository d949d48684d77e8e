"""Scores of retrieval and of answers against gold data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbspark.functions import text as X


def evaluate_retrieval(hits: DataFrame, gold: DataFrame, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """Per question recall, precision, reciprocal rank and hit; and their means.

    hits: (query_id, page, rank), pages may repeat; gold: (query_id, page).
    """
    first = hits.groupBy("query_id", "page").agg(F.min("rank").alias("rank"))
    pages = first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "page"))).filter(F.col("rank") <= k)
    wanted = gold.distinct().withColumn("gold", F.lit(1))
    joined = pages.join(wanted, ["query_id", "page"], "left").groupBy("query_id").agg(F.coalesce(F.sum("gold"), F.lit(0)).alias("found"), F.min(F.when(F.col("gold") == 1, F.col("rank"))).alias("first"), F.count("*").alias("shown"))
    rows = wanted.groupBy("query_id").agg(F.count("*").alias("expected")).join(joined, "query_id", "left")
    found = F.coalesce("found", F.lit(0))
    rows = rows.select("query_id", (found / F.col("expected")).alias("recall"), F.coalesce(found / F.col("shown"), F.lit(0.0)).alias("precision"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"), F.col("first").isNotNull().cast("int").alias("hit"))
    return rows, rows.agg(F.count("*").alias("n"), F.avg("recall").alias("recall"), F.avg("precision").alias("precision"), F.avg("rr").alias("mrr"), F.avg("hit").alias("hit_rate"))


def exclusive_hits(channels: dict[str, DataFrame], key: str = "id") -> DataFrame:
    """(query_id, channel, n): hits that one channel alone found."""
    rows = None
    for name, df in channels.items():
        one = df.select("query_id", key, F.lit(name).alias("channel"))
        rows = one if rows is None else rows.union(one)
    alone = rows.distinct().groupBy("query_id", key).agg(F.count("*").alias("c"), F.min("channel").alias("channel")).filter("c = 1")
    return alone.groupBy("query_id", "channel").agg(F.count("*").alias("n"))


def keyword_coverage(answer, keywords):
    """Share of the keywords that an answer holds; 1 without keywords."""
    asked = F.filter(keywords, lambda k: k != "")
    return F.when(F.size(asked) > 0, F.size(F.filter(asked, lambda k: F.contains(answer, k))) / F.size(asked)).otherwise(1.0)


def forbidden_hits(answer, forbidden):
    return F.filter(forbidden, lambda f: (F.trim(f) != "") & F.contains(F.lower(answer), F.lower(F.trim(f))))


def score_answers(rows: DataFrame) -> DataFrame:
    """Adds the five scores and their mean.

    rows: answer, level, hit_pages, expected_pages, expected_keywords, must_abstain, forbidden, and facts
    and expected_facts: arrays of (record_id, sheet, row_index, fields) and (record_id, sheet, row_index,
    field_substrings), null parts of what is expected matching anything.
    """
    pages = F.array_distinct(F.transform("expected_pages", X.norm_page))
    hits = F.transform("hit_pages", X.norm_page)
    recall = F.when(F.size(pages) > 0, F.size(F.array_intersect(pages, hits)) / F.size(pages)).otherwise(1.0)
    same = lambda want, have: want.isNull() | (want == have)
    holds = lambda f, subs: F.forall(F.coalesce(subs, F.array().cast("array<string>")), lambda s: F.contains(F.array_join(F.map_values(f["fields"]), " "), s))
    match = lambda e: F.exists("facts", lambda f: same(e["record_id"], f["record_id"]) & same(e["sheet"], f["sheet"]) & same(e["row_index"], f["row_index"]) & holds(f, e["field_substrings"]))
    facts = F.when(F.size("expected_facts") > 0, F.size(F.filter("expected_facts", match)) / F.size("expected_facts")).otherwise(1.0)
    abstain = F.when(F.col("must_abstain") & ~X.abstain_ok(F.col("answer"), F.col("level")), 0.0).otherwise(1.0)
    comparison = F.when(F.size(forbidden_hits(F.col("answer"), F.col("forbidden"))) > 0, 0.0).otherwise(1.0)
    out = rows.withColumns({"page_recall": recall, "fact_row": facts, "keywords": keyword_coverage(F.col("answer"), F.col("expected_keywords")), "abstain": abstain, "comparison": comparison})
    return out.withColumn("aggregate", (F.col("page_recall") + F.col("fact_row") + F.col("keywords") + F.col("abstain") + F.col("comparison")) / 5)


def mode_summary(scores: DataFrame) -> DataFrame:
    """Per mode the number, the mean score and the mean latency of runs that have one."""
    return scores.groupBy("mode").agg(F.count("*").alias("n"), F.round(F.avg("aggregate"), 4).alias("mean_score"), F.round(F.avg(F.when(F.col("latency_ms") >= 0, F.col("latency_ms"))), 4).alias("mean_latency"))


def answer_quality(rows: DataFrame) -> DataFrame:
    """Weighted quality of a judge's four scores. The weights."""
    return rows.withColumn("quality", F.col("accuracy") * 0.40 + F.col("completeness") * 0.25 + F.col("citation") * 0.20 + F.col("clarity") * 0.15)


def expected_ratio(expected: DataFrame, found: DataFrame, on: list[str]) -> DataFrame:
    """(expected, found, ratio): how much of what was expected is there: entities, references or contradictions."""
    rows = expected.distinct().join(found.select(*on).distinct().withColumn("__f", F.lit(1)), on, "left")
    return rows.agg(F.count("*").alias("expected"), F.count("__f").alias("found"), (F.count("__f") / F.count("*")).alias("ratio"))


def set_summary(rows: DataFrame) -> DataFrame:
    """Counts by confidence level and mean hits over a set of questions (level, wiki_hits, chunk_hits)."""
    one = lambda v: F.count(F.when(F.col("level") == v, 1)).alias(v)
    return rows.agg(F.count("*").alias("n"), one("high"), one("medium"), one("low"), F.avg("wiki_hits").alias("mean_wiki_hits"), F.avg("chunk_hits").alias("mean_chunk_hits"))
