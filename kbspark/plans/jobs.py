"""Jobs that make a repository's stored chunks, page vectors and facts anew; each replaces whole partitions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.operators import chunking, facts, fusion, lexical, models
from kbspark.plans.config import ChunkConfig, RetrievalConfig
from kbspark.sources import store


@dataclass(frozen=True)
class CorpusTables:
    """What retrieval reads: chunks, facts and pages, and the keyword indexes of the first two, if they were written."""

    chunks: DataFrame
    facts: DataFrame
    pages: DataFrame
    chunk_postings: lexical.Postings | None = None
    fact_postings: lexical.Postings | None = None

    def search_chunks(self, queries: DataFrame, dense: DataFrame, cfg: RetrievalConfig = RetrievalConfig()) -> DataFrame:
        return fusion.retrieve_chunks(queries, self.chunks, dense, cfg, postings=self.chunk_postings)

    def search_facts(self, queries: DataFrame, dense: DataFrame, cfg: RetrievalConfig = RetrievalConfig()) -> DataFrame:
        return fusion.retrieve_facts(queries, self.facts, dense, cfg, postings=self.fact_postings)


def _of(rows: DataFrame, repo_ids: list[int] | None) -> DataFrame:
    return rows if repo_ids is None else rows.filter(F.col("repo_id").isin(repo_ids))


def _embedded(rows: DataFrame, text: Column, embedder) -> DataFrame:
    return rows if embedder is None else models.embed(rows.withColumn("__text", text), "__text", embedder).drop("__text")


def rebuild_chunks(pages: DataFrame, path: str, repo_ids: list[int] | None = None, cfg: ChunkConfig = ChunkConfig(), embedder=None) -> None:
    """Chunks of the pages (repo_id, filename, content, title) of the given repositories, or of all, with vectors if there is an embedder."""
    rows = _of(pages, repo_ids)
    chunks = chunking.chunk_pages(rows, cfg)
    if embedder is not None:
        titles = rows.select("repo_id", "filename", "title")
        chunks = chunks.join(titles, ["repo_id", "filename"])
        chunks = _embedded(chunks, chunking.embed_text(F.col("title"), F.col("heading"), F.col("chunk_text")), embedder)
    store.replace(chunking.stored(chunks), path, repo_ids)


def rebuild_pages(pages: DataFrame, path: str, embedder, repo_ids: list[int] | None = None) -> None:
    """Vectors of whole pages: (repo_id, filename, title, type, embedding, error)."""
    rows = _of(pages, repo_ids).select("repo_id", "filename", "title", "type", "content")
    store.replace(_embedded(rows, F.concat_ws("\n\n", "title", "content"), embedder).drop("content"), path, repo_ids)


def rebuild_facts(sheets: DataFrame, path: str, repo_ids: list[int] | None = None, embedder=None) -> None:
    """Facts of the parsed sheets (repo_id, source_file, name, rows)."""
    rows = facts.indexable(facts.sheets_to_facts(_of(sheets, repo_ids), keep=("repo_id",)))
    text = facts.embed_text(F.col("source_file"), F.col("sheet"), F.col("row_index"), F.col("fact_text"))
    store.replace(_embedded(rows, text, embedder), path, repo_ids)
