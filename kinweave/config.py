"""Settings of a linkage run."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class LinkConfig:
    """Defaults of the command line; see `kinweave.plans.cli`."""

    n_splits: int = 5
    seed: int = 42
    sample_s1: int | None = None
    max_df: int = 300
    min_len: int = 4
    prefix_len: int = 4
    max_pairs_per_prefix_key: int = 200_000
    neg_per_pos_cap: int = 15
    use_tfidf: bool = False
    tfidf_top_k: int = 15
    use_rare: bool = False
    rare_min_len: int = 6
    rare_max_df: int = 2000
    use_dense: bool = False
    dense_top_k: int = 50
    dense_min_score: float = 0.3
    max_cands_per_entity: int = 300
    consensus_mode: str = "and"
    cross_encoder_threshold: float = 0.92
    min_recall: float = 0.90
    #: Size and rate of the matcher; small values make quick tests.
    max_iter: int = 60
    step_size: float = 0.05
    max_depth: int = 5
