"""Tunables of the engine, with the default values the reference ships."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Options:
    # corpus
    chunk_size: int = 512
    chunk_overlap: int = 64
    min_section_chars: int = 20
    similarity_threshold: float = 0.95
    # retrieval
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_epsilon: float = 0.25
    vector_k: int = 30
    bm25_k: int = 30
    fusion_k: int = 20
    final_k: int = 5
    rrf_k: int = 60
    vector_weight: float = 0.5
    bm25_weight: float = 0.5
    max_distance: float = 1.2
    max_context_chars: int = 4000
    # tables
    missing_threshold: float = 0.3
    cat_threshold: int = 10
    percent_share: float = 0.8
    numeric_share: float = 0.8
    max_categories: int = 20
    # memory
    recent_turns: int = 5
    keep_recent: int = 10
    summarize_after_turns: int = 10
    summarize_min_messages: int = 4
    max_messages: int = 20
    recall_k: int = 3
    # service metrics
    metrics_window: int = 1000


DEFAULTS = Options()
