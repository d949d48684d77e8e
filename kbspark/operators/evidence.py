"""What an answer rests on: confidence, citations, evidence rows, the context of a prompt."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.functions import text as X

Q = ["repo_id", "query_id"]


def _d(x: float) -> Column:
    return F.lit(x).cast("double")


def level(score: Column) -> Column:
    return F.when(score >= 0.75, "high").when(score >= 0.45, "medium").otherwise("low")


def confidence(df: DataFrame) -> DataFrame:
    """Adds score (2 decimals), level (of the score before rounding) and reasons.

    df: wiki_hit_count, chunk_hit_count, top_chunk_score, hit_overview, both_channels, answer_text,
    fact_hit_count, top_fact_score, fact_channel. Fixed values: the points and bounds, added as
    doubles in this order.
    """
    wiki, chunk, fact = F.col("wiki_hit_count"), F.col("chunk_hit_count"), F.col("fact_hit_count")
    unsure = X.uncertain(F.col("answer_text"))
    points = [
        (wiki >= 1, 0.30),
        (wiki >= 2, 0.15),
        (chunk >= 2, 0.25),
        (chunk >= 4, 0.10),
        (fact >= 1, 0.30),
        (fact >= 3, 0.10),
        (F.col("both_channels"), 0.15),
        (F.col("fact_channel"), 0.10),
    ]
    terms = [F.when(when, _d(p)).otherwise(_d(0.0)) for when, p in points]
    terms.append(F.when(F.col("top_chunk_score") >= 0.85, _d(0.10)).when(F.col("top_chunk_score") >= 0.75, _d(0.05)).otherwise(_d(0.0)))
    terms.append(F.when(F.col("top_fact_score") >= 0.90, _d(0.10)).when(F.col("top_fact_score") >= 0.80, _d(0.05)).otherwise(_d(0.0)))
    terms += [F.when(F.col("hit_overview"), _d(0.05)).otherwise(_d(0.0)), F.when(unsure, _d(-0.20)).otherwise(_d(0.0))]
    raw = F.greatest(_d(0.0), F.least(_d(1.0), reduce(Column.__add__, terms, _d(0.0))))
    named = [(wiki >= 1, "pages"), (chunk >= 2, "chunks"), (fact >= 1, "facts"), (F.col("both_channels"), "both channels"), (F.col("fact_channel"), "fact channel"), (F.col("hit_overview"), "overview"), (unsure, "uncertain answer")]
    reasons = F.array_compact(F.array(*[F.when(when, F.lit(name)) for when, name in named]))
    out = df.withColumn("__raw", raw)
    reasons = F.when((F.size(reasons) == 0) & (level(F.col("__raw")) == "low"), F.array(F.lit("no evidence"))).otherwise(reasons)
    return out.withColumns({"score": F.round("__raw", 2), "level": level(F.col("__raw")), "reasons": reasons}).drop("__raw")


def check_citations(answer: Column, allowed: Column) -> Column:
    """struct(cited, unknown, ok)."""
    cited = X.citations(answer)
    unknown = F.array_except(cited, allowed)
    return F.struct(cited.alias("cited"), unknown.alias("unknown"), (F.size(unknown) == 0).alias("ok"))


def penalize(df: DataFrame, penalty: float = 0.25) -> DataFrame:
    """Lowers score and level of rows (score, level, unknown) that cite what they weren't given."""
    bad = F.size("unknown") > 0
    lowered = F.greatest(_d(0.0), F.round(F.col("score") - penalty, 2))
    return df.withColumn("__new", lowered).withColumns({"level": F.when(bad, level(F.col("__new"))).otherwise(F.col("level")), "score": F.when(bad, F.col("__new")).otherwise(F.col("score"))}).drop("__new")


def evidence_rows(pages: DataFrame, chunks: DataFrame, facts: DataFrame) -> DataFrame:
    """One row for each piece of evidence: (repo_id, query_id, kind, rank, filename, snippet, reason, url).

    pages: (…, rank, filename, content); chunks: (…, rank, filename, position, chunk_text, neighbor_of);
    facts: (…, rank, source_markdown_filename, record_id, fact_text).
    """
    short = lambda c: F.substring(F.regexp_replace(c, r"\s+", " "), 1, 200)
    stem = lambda c: F.regexp_replace(c, r"\.md$", "")
    rows = [
        pages.select(*Q, F.lit("page").alias("kind"), "rank", "filename", X.excerpt(F.col("content"), 200).alias("snippet"), F.lit("selected page").alias("reason"), F.concat(F.lit("wiki/"), stem(F.col("filename"))).alias("url")),
        chunks.select(*Q, F.lit("chunk").alias("kind"), "rank", "filename", short(F.col("chunk_text")).alias("snippet"), F.when(F.col("neighbor_of").isNull(), "matching chunk").otherwise("next to a match").alias("reason"), F.concat(F.lit("wiki/"), stem(F.col("filename")), F.lit("#"), F.col("position")).alias("url")),
        facts.select(*Q, F.lit("fact").alias("kind"), "rank", F.col("source_markdown_filename").alias("filename"), short(F.col("fact_text")).alias("snippet"), F.lit("matching record").alias("reason"), F.concat(F.lit("facts/"), F.col("record_id")).alias("url")),
    ]
    return reduce(DataFrame.unionByName, rows)


def allowed_sources(evidence: DataFrame) -> DataFrame:
    """(repo_id, query_id, allowed): file names of the evidence in order, each once."""
    place = F.struct(F.when(F.col("kind") == "page", 0).when(F.col("kind") == "chunk", 1).otherwise(2).alias("k"), F.col("rank").cast("int").alias("r"))
    once = evidence.filter("filename is not null").groupBy(*Q, "filename").agg(F.min(place).alias("place"))
    return once.groupBy(*Q).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "filename"))), lambda x: x["filename"]).alias("allowed"))


def build_context(chunks: DataFrame, pages: DataFrame, chunk_chars: int = 700, page_chars: int = 2000) -> DataFrame:
    """(repo_id, query_id, context): chunks by file, files in the order of their best hit, chunks by position.

    chunks: (…, rank, filename, position, heading, chunk_text). Queries that only have pages (…, rank,
    filename, content) get the beginnings of these.
    """
    files = Window.partitionBy(*Q, "filename")
    block = F.concat(F.lit("["), F.col("filename"), F.lit("#"), F.col("position"), F.lit("] "), F.substring("chunk_text", 1, chunk_chars))
    order = F.struct(F.col("__f").alias("f"), F.col("position").alias("p"), block.alias("b"))
    by_chunk = chunks.withColumn("__f", F.min("rank").over(files)).groupBy(*Q).agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["b"]), "\n\n").alias("context"))
    page = F.concat(F.lit("["), F.col("filename"), F.lit("] "), F.substring(X.strip_frontmatter(F.col("content")), 1, page_chars))
    by_page = pages.join(by_chunk, Q, "left_anti").groupBy(*Q).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", page.alias("b")))), lambda x: x["b"]), "\n\n").alias("context"))
    return by_chunk.unionByName(by_page)


def fact_context(facts: DataFrame) -> DataFrame:
    """(repo_id, query_id, fact_context): the facts' texts, numbered in order."""
    line = F.struct("rank", F.concat(F.col("rank"), F.lit(". "), F.col("fact_text")).alias("b"))
    return facts.groupBy(*Q).agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["b"]), "\n").alias("fact_context"))


def build_prompt(question: Column, intent: Column, context: Column, history: Column) -> Column:
    """The prompt of a question; what guards against invention is said only if there is a context."""
    task = F.when(intent == "comparison", "Compare the things asked about, point by point.").otherwise("Answer the question.")
    guard = F.when(F.coalesce(context, F.lit("")) != "", "Use only the context below; say so if it isn't enough.")
    parts = [task, guard, F.concat(F.lit("Context:\n"), F.nullif(context, F.lit(""))), F.concat(F.lit("Conversation:\n"), F.nullif(history, F.lit(""))), F.concat(F.lit("Question: "), question)]
    return F.concat_ws("\n\n", *parts)
