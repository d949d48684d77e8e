"""Settings of retrieval and chunking."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class ChunkConfig:
    """Sizes in characters; out-of-range values are brought back into range."""

    chunk_min: int = 400
    chunk_max: int = 1200
    overlap: int = 80

    def __post_init__(self):
        low = max(100, self.chunk_min)
        object.__setattr__(self, "chunk_min", low)
        object.__setattr__(self, "chunk_max", max(low + 100, self.chunk_max))
        object.__setattr__(self, "overlap", max(0, min(self.overlap, low // 2)))


@dataclass(frozen=True)
class RetrievalConfig:
    chunk_top_k: int = 12
    fact_top_k: int = 12
    chunk_score_threshold: float = 0.35
    fact_score_threshold: float = 0.40
    max_chunks_per_file: int = 2
    rrf_k: int = 60
    enable_bm25: bool = True
    bm25_top_k: int = 20
    context_expand_neighbors: int = 0
    enable_fact_keyword: bool = True
    fact_keyword_top_k: int = 100
    #: Repositories with more facts than this have no keyword and no exact channel; None: all have them.
    fact_keyword_max_records: int | None = None
    fact_search_text_chars: int = 2000
    chunk_oversample: int = 3
    fact_oversample: int = 2
    citation_penalty: float = 0.25
    key_mode: str = "source"

    @classmethod
    def from_config(cls, settings) -> RetrievalConfig:
        """From a mapping or an object with names such as RAG_CHUNK_TOP_K; what is absent keeps its default."""
        found = {}
        for f in fields(cls):
            name = f"RAG_{f.name.upper()}"
            value = settings.get(name) if isinstance(settings, Mapping) else getattr(settings, name, None)
            if value is not None:
                kind = int if f.default is None else type(f.default)
                found[f.name] = str(value).strip().lower() in ("1", "true", "yes", "on") if kind is bool else kind(value)
        return cls(**found)

    @property
    def chunk_candidates(self) -> int:
        """Chunks that the dense channel fetches."""
        return max(2 * self.chunk_top_k, self.bm25_top_k)
