"""Engine settings; one immutable object is passed where a plan needs them."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    chunk_size: int = 512
    chunk_overlap: int = 1
    min_chunk_size: int = 100
    parent_sizes: tuple[int, ...] = (2000, 512, 128)
    top_k: int = 10
    rerank_factor: int = 3
    hybrid_factor: int = 2
    hybrid_most: int = 50
    sparse_weight: float = 0.3
    rrf_k: int = 60
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    similarity_threshold: float = 0.5
    cache_threshold: float = 0.95
    cache_ttl_seconds: float = 3600.0
    max_iterations: int = 3
    max_tokens: int = 4000

    def __post_init__(self) -> None:
        if not 0 <= self.sparse_weight <= 1 or self.top_k < 1 or self.chunk_size < 1:
            raise ValueError("weights lie in 0..1; sizes and top_k are positive")
