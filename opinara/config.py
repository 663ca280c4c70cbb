"""Parameters of a run, with the defaults of the main profile.

FIXED VALUES: results depend on these defaults.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class EnhanceConfig:
    """Weights of the rating blend."""

    base_rating_weight: float = 0.70
    compound_weight: float = 0.60
    polarity_weight: float = 0.40


@dataclass(frozen=True)
class TfidfConfig:
    """Vocabulary limits; ``max_features`` also bounds the term table that tasks hold."""

    max_features: int = 8000
    min_df: int = 2
    max_df: float = 0.85


@dataclass(frozen=True)
class RunConfig:
    n_per_class: int = 2996
    seed: int = 42
    test_fraction: float = 0.30
    n_folds: int = 5
    enhance: EnhanceConfig = field(default_factory=EnhanceConfig)
    tfidf: TfidfConfig = field(default_factory=TfidfConfig)
    nb_alphas: tuple[float, ...] = (0.001, 0.01, 0.1, 0.5, 1.0)
    mlp_hidden: tuple[tuple[int, ...], ...] = ((32,), (64,), (64, 32))
    mlp_max_iter: tuple[int, ...] = (200,)
    parallelism: int = 4
