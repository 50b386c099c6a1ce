"""Every constant of ranking, chunking, caching and evaluation in one place."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25
    retrieve_k: int = 50
    article_k: int = 20
    final_k: int = 12
    lexical_power: float = 1.2
    dense_power: float = 1.1
    spread_weight: float = 0.2
    min_hybrid: float = 0.2
    min_final: float = 0.3
    refuse_below: float = 0.45
    window_chars: int = 2400
    overlap_chars: int = 480
    min_tokens: int = 100
    pack_tokens: int = 600
    pack_overlap: int = 120
    context_chars: int = 15000
    chunk_chars: int = 600
    per_article: int = 3
    same_variant: float = 0.90
    cache_hit: float = 0.90
    cache_same: float = 0.98
    gap_seconds: int = 2


SETTINGS = Settings()
