"""Heading-aware chunks of pages."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.functions import text as X
from kbspark.plans.config import ChunkConfig

#: Where a long section is cut, and what its cut looks back for.
SENTENCE_ENDS, LOOK_BACK, PAYLOAD_CHARS = "。！？!?\n", 200, 1200
_HEADING = re.compile(r"^#{1,4}\s+(.+)", re.M)


def sections(text: str) -> Iterator[tuple[str, str]]:
    """(heading, body) of the stretches between headings of levels 1 to 4; empty bodies are left out."""
    marks = [("", 0, 0), *((m[1].strip(), m.start(), m.end()) for m in _HEADING.finditer(text))]
    for (heading, _, begin), following in zip(marks, [*marks[1:], ("", len(text), 0)]):
        if body := text[begin : following[1]].strip():
            yield heading, body


def joined(parts: Iterator[tuple[str, str]], cfg: ChunkConfig) -> Iterator[tuple[str, str]]:
    """Short bodies wait for what follows, as long as both fit into one chunk."""
    waiting: tuple[str, str] | None = None
    for heading, body in parts:
        if waiting and len(waiting[1]) + 2 + len(body) <= cfg.chunk_max:
            waiting = (waiting[0] or heading, f"{waiting[1]}\n\n{body}")
            continue
        if waiting:
            yield waiting
            waiting = None
        if len(body) < cfg.chunk_min:
            waiting = (heading, body)
        else:
            yield heading, body
    if waiting:
        yield waiting


def pieces(body: str, cfg: ChunkConfig) -> Iterator[str]:
    """A long body in pieces that end after a sentence if one ends near the limit, and overlap a little."""
    at = 0
    while len(body) - at > cfg.chunk_max:
        limit = at + cfg.chunk_max
        nearest = max(body.rfind(c, at + max(cfg.chunk_min, cfg.chunk_max - LOOK_BACK), limit) for c in SENTENCE_ENDS)
        end = limit if nearest < 0 else nearest + 1
        if piece := body[at:end].strip():
            yield piece
        at = max(end - cfg.overlap, at + 1)
    if piece := body[at:].strip():
        yield piece


def chunk_pages(pages: DataFrame, cfg: ChunkConfig = ChunkConfig()) -> DataFrame:
    """(repo_id, filename, chunk_id, heading, chunk_text, position) of pages (repo_id, filename, content). The texts are whole; stored() cuts them."""

    def run(batches):
        for pdf in batches:
            rows = []
            for repo, name, text in zip(pdf["repo_id"], pdf["filename"], pdf["text"]):
                cut = ((h, p) for h, body in joined(sections(text or ""), cfg) for p in pieces(body, cfg))
                rows += [(repo, name, h, p, i) for i, (h, p) in enumerate(cut)]
            yield pd.DataFrame(rows, columns=["repo_id", "filename", "heading", "chunk_text", "position"])

    texts = pages.select("repo_id", "filename", X.strip_frontmatter(F.col("content")).alias("text"))
    chunks = texts.mapInPandas(run, "repo_id long, filename string, heading string, chunk_text string, position int")
    return chunks.withColumn("chunk_id", F.concat("filename", F.lit("#"), "position"))


def stored(chunks: DataFrame, limit: int = PAYLOAD_CHARS) -> DataFrame:
    """Chunks as they are kept beside their vectors: the text is cut after it was embedded whole."""
    return chunks.withColumn("chunk_text", F.substring("chunk_text", 1, limit))


def embed_text(title: Column, heading: Column, text: Column) -> Column:
    """The chunk's text below its page's title and its heading, unless they are the same."""
    t, h = F.trim(F.coalesce(title, F.lit(""))), F.trim(F.coalesce(heading, F.lit("")))
    head = F.array_join(F.filter(F.array(t, F.when(h != t, h).otherwise("")), lambda x: x != ""), " / ")
    return F.when(head != "", F.concat(head, F.lit("\n\n"), F.trim(text))).otherwise(F.trim(text))
