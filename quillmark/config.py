"""Parameters of retrieval and indexing, with the defaults in force."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class RetrievalConfig:
    k1: float = 1.2
    b: float = 0.75
    min_idf: float = 0.0
    bm25_top: int = 25
    dense_top: int = 25
    rrf_k: int = 60
    max_groups: int = 8
    count_weight: float = 0.5
    score_weight: float = 0.5
    signal_window: int = 10
    rerank_mode: str = "never"
    rerank_std: float = 0.015
    rerank_overlap: int = 1
    rerank_top: float = 0.55
    expand: int = 0
    least_dense: float = 0.20
    least_bm25: float = 0.20
    stop_words: tuple[str, ...] = ()
    compatibility: bool = False


@dataclass(frozen=True)
class ChunkConfig:
    least: int = 260
    most: int = 380
