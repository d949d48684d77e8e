"""Operators that call models. Models are callables given by the user; Spark deals the rows out."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kbspark.functions import text as X

Embedder = Callable[[list[str]], list[list[float]]]
TextModel = Callable[[str], str]


@lru_cache(maxsize=1 << 18)
def _digest(word: str) -> int:
    return int.from_bytes(hashlib.md5(word.encode()).digest()[:8], "big")


def hash_embedder(dim: int = 64) -> Embedder:
    """A deterministic embedder without a model: signed counts of hashed words, of unit length."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = _digest(w)
                out[i, h % dim] += 1 if h >> 63 else -1
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).tolist()

    return embed


def embed(df: DataFrame, text_col: str, embedder: Embedder, batch_size: int = 32, dim: int | None = None) -> DataFrame:
    """Adds embedding and error. A batch that fails is tried row by row; a row that fails has an error and no vector."""
    schema = T.StructType([*df.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("error", T.StringType())])

    def vectors(texts: list[str]):
        try:
            found = embedder(texts)
            if len(found) != len(texts) or dim and any(len(v) != dim for v in found):
                raise ValueError("the embedder gave another number or size of vectors")
            return [(v, None) for v in found]
        except Exception as e:  # noqa: BLE001 - a model may raise anything; the row says so
            return [(None, str(e)[:200])] if len(texts) == 1 else [x for t in texts for x in vectors([t])]

    def run(batches):
        for pdf in batches:
            texts = pdf[text_col].fillna("").tolist()
            found = [x for i in range(0, len(texts), batch_size) for x in vectors(texts[i : i + batch_size])]
            yield pdf.assign(embedding=[f[0] for f in found], error=[f[1] for f in found])

    return df.mapInPandas(run, schema)


def llm_map(df: DataFrame, prompt: Column, model: TextModel, schema: str | None = None, default=None, retries: int = 1) -> DataFrame:
    """Adds output (text, or with a schema the JSON of the answer) and error; default where all tries failed."""
    raw = T.StructType([*df.schema.fields, T.StructField("__answer", T.StringType()), T.StructField("error", T.StringType())])

    def ask(text: str):
        error = None
        for _ in range(retries + 1):
            try:
                answer = model(text)
                if schema is not None:
                    json.loads(_unfenced(answer))
                return answer, None
            except Exception as e:  # noqa: BLE001 - a model may raise anything; the row says so
                error = str(e)[:200]
        return None, error

    def run(batches):
        for pdf in batches:
            found = [ask(t or "") for t in pdf.pop("__prompt")]
            yield pdf.assign(__answer=[f[0] for f in found], error=[f[1] for f in found])

    out = df.withColumn("__prompt", prompt).mapInPandas(run, raw)
    value = X.unwrap_fence(F.col("__answer")) if schema is None else X.safe_json(F.col("__answer"), schema, F.lit(None))
    fallback = F.lit(default) if schema is None else (F.lit(None) if default is None else F.from_json(F.lit(json.dumps(default)), schema))
    return out.withColumn("output", F.coalesce(value, fallback)).drop("__answer")


def _unfenced(text: str) -> str:
    body = text.strip()
    return body.split("\n", 1)[-1].rsplit("```", 1)[0] if body.startswith("```") else body


ANALYSIS = "summary string, entities array<string>, concepts array<string>, findings array<string>"
PLAN = "create array<string>, update array<string>"


def analyse_sources(sources: DataFrame, model: TextModel, limit: int = 30_000) -> DataFrame:
    """Summary, entities, concepts and findings of the first `limit` characters of each source."""
    return llm_map(sources, F.concat(F.lit("Analyse this source as JSON.\n\n"), F.substring("content", 1, limit)), model, ANALYSIS)


def plan_pages(analyses: DataFrame, model: TextModel) -> DataFrame:
    """(…, action, page): pages to create and to update, one row each."""
    told = analyses.withColumnRenamed("output", "analysis").drop("error")
    planned = llm_map(told, F.concat(F.lit("Plan the pages as JSON.\n\n"), F.to_json("analysis")), model, PLAN, {"create": [], "update": []})
    keep = [c for c in planned.columns if c not in ("output", "error")]
    listed = F.array(F.struct(F.lit("create").alias("action"), F.col("output.create").alias("pages")), F.struct(F.lit("update").alias("action"), F.col("output.update").alias("pages")))
    rows = planned.select(*keep, F.inline(listed))
    return rows.select(*keep, "action", F.explode("pages").alias("page"))


def write_pages(plan: DataFrame, pages: DataFrame, model: TextModel) -> DataFrame:
    """The planned pages (repo_id, page, action) with their new content; a page that fails has an error."""
    old = pages.select("repo_id", F.col("filename").alias("page"), F.col("content").alias("old"))
    rows = plan.join(old, ["repo_id", "page"], "left")
    prompt = F.concat(F.initcap("action"), F.lit(" the page "), F.col("page"), F.coalesce(F.concat(F.lit("\n\n"), F.col("old")), F.lit("")))
    return llm_map(rows, prompt, model).withColumnRenamed("output", "content")


def hyde(queries: DataFrame, model: TextModel, least_chars: int = 10) -> DataFrame:
    """Adds dense_query: the question with a drafted answer behind it, if the draft is long enough."""
    rows = llm_map(queries, F.concat(F.lit("Draft an answer: "), F.col("question")), model)
    return rows.withColumn("dense_query", F.when(F.length(F.trim("output")) >= least_chars, F.concat("question", F.lit("\n"), "output")).otherwise(F.col("question"))).drop("output", "error")


def decompose(queries: DataFrame, model: TextModel, most: int = 4) -> DataFrame:
    """(…, pos, sub_question): 2 to 4 distinct sub-questions, or the question itself."""
    rows = llm_map(queries, F.concat(F.lit("Split into sub-questions, as JSON: "), F.col("question")), model, "items array<string>")
    parts = F.slice(F.array_distinct(F.filter(F.coalesce("output.items", F.array().cast("array<string>")), lambda q: F.trim(q) != "")), 1, most)
    chosen = F.when(F.size(parts) >= 2, parts).otherwise(F.array("question"))
    return rows.select(*queries.columns, F.posexplode(chosen).alias("pos", "sub_question"))


def retrieve_in_steps(queries: DataFrame, step: Callable[[DataFrame, int], DataFrame], follow_up: Callable[[DataFrame], DataFrame], most: int = 6) -> DataFrame:
    """Hits of up to `most` rounds: each asks all open queries at once, and follow_up(hits) gives the next ones.

    step(queries, round) gives hits; follow_up gives queries (empty: done). Rounds are added up.
    """
    hits = None
    for i in range(most):
        found = step(queries, i).withColumn("step", F.lit(i))
        hits = found if hits is None else hits.unionByName(found)
        queries = follow_up(found)
        if queries.isEmpty():
            break
    return hits


def critique(evidence: DataFrame, model: TextModel, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """evidence (query_id, summary): the sufficient ones, and follow-up questions (query_id, question) of the others."""
    rows = llm_map(evidence, F.concat(F.lit("Is this enough? JSON: "), F.col("summary")), model, "sufficient boolean, follow_ups array<string>")
    enough = F.coalesce("output.sufficient", F.lit(True))
    more = rows.filter(~enough).select("query_id", F.explode(F.slice(F.array_distinct("output.follow_ups"), 1, most)).alias("question"))
    return rows.filter(enough).select("query_id", "summary"), more


def evidence_summary(pages: DataFrame, chunks: DataFrame, most_pages: int = 12, most_chunks: int = 8, chars: int = 160) -> DataFrame:
    """(repo_id, query_id, summary): names of pages and beginnings of chunks."""
    q = ["repo_id", "query_id"]
    names = pages.filter(F.col("rank") <= most_pages).groupBy(*q).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "filename"))), lambda x: x["filename"]), ", ").alias("p"))
    texts = chunks.filter(F.col("rank") <= most_chunks).groupBy(*q).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.substring(F.regexp_replace("chunk_text", r"\s+", " "), 1, chars).alias("t")))), lambda x: x["t"]), "\n").alias("c"))
    return names.join(texts, q, "full").select(*q, F.concat_ws("\n", F.concat(F.lit("pages: "), F.col("p")), F.col("c")).alias("summary"))


ROUTES = {"orphan": "link", "broken_link": "link", "missing_page": "create", "bad_frontmatter": "rewrite", "wrong_type": "rewrite", "contradiction": "skip"}


def apply_fixes(issues: DataFrame, pages: DataFrame, model: TextModel) -> DataFrame:
    """issues (repo_id, type, page, description) with action and result: fixed text, skipped, or an error."""
    action = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ROUTES.items() for x in kv]), F.col("type")), F.lit("skip"))
    rows = issues.withColumn("action", action).join(pages.select("repo_id", F.col("filename").alias("page"), "content"), ["repo_id", "page"], "left")
    state = F.when(F.col("action") == "skip", "skipped").when(F.col("content").isNull() & (F.col("action") != "create"), "page is missing")
    rows = rows.withColumn("status", state)
    done = llm_map(rows.filter("status is null"), F.concat(F.lit("Fix: "), F.col("description"), F.lit("\n\n"), F.coalesce("content", F.lit(""))), model)
    done = done.withColumn("status", F.coalesce("error", F.lit("fixed"))).drop("error")
    return done.unionByName(rows.filter("status is not null").withColumn("output", F.lit(None).cast("string"))).drop("content")


def describe_repos(samples: DataFrame, model: TextModel) -> DataFrame:
    """(repo_id, description) of samples (repo_id, sample)."""
    rows = llm_map(samples, F.concat(F.lit("Describe this collection in one sentence.\n\n"), F.col("sample")), model)
    return rows.select("repo_id", X.clean_description(F.col("output")).alias("description"))
