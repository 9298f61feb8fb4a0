"""Numeric knobs and word lists of the pipeline in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """Fixed values of the pipeline; every operator takes what it needs as a parameter with these defaults."""

    chunk_rows: int = 50_000
    chunks_per_run: int = 60
    bag_size: int = 5
    corpus_size: float = 4e6
    post_min_freq: int = 5
    reply_dimensions: int = 8_000
    profiles_kept: int = 2_000
    trending_kept: int = 2_000
    trash_distance: float = 0.6
    trash_kept: int = 2_000
    topic_distance: float = 0.45
    topic_neighbours: int = 8
    bigram_noise: float = 0.001
    clusters_aligned: int = 30
    best_members: int = 3
    clusters_published: int = 15
    tweets_per_cluster: int = 10
    tweets_per_day: int = 10_000
    contexts_kept: int = 2_000
    trend_days: int = 3
    count_days: int = 1
    mates_days: int = 2
    medoid_rounds: int = 100
    medoid_grid: tuple[int, ...] = (800, 900, 1000, 1100)
    total_word: str = "__total__"
    total_key: int = 40693175
    all_words: str = "0"
    retention_days: int = 4


SETTINGS = Settings()
