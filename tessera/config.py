"""Settings of retrieval and scoring; the defaults are those of the service whose results we match."""

from __future__ import annotations

from dataclasses import dataclass, field

WEIGHTS = {"retrieval": 0.35, "recency": 0.15, "importance": 0.15, "utility": 0.15, "goal": 0.10, "belief_impact": 0.05, "confidence": 0.05}


@dataclass(frozen=True)
class Scoring:
    """Weights of the salience score. A weight of 0 or less takes its default; None switches it off."""

    weights: dict[str, float | None] = field(default_factory=dict)
    half_life_days: float = 30.0
    redundancy: float = 0.82

    def normalized(self) -> dict[str, float]:
        own = {k: self.weights.get(k, d) for k, d in WEIGHTS.items()}
        own = {k: 0.0 if w is None else w if w > 0 else WEIGHTS[k] for k, w in own.items()}
        total = sum(own.values())
        return {k: w / total for k, w in own.items()}

    @property
    def half_life(self) -> float:
        return self.half_life_days if self.half_life_days > 0 else 30.0

    @property
    def threshold(self) -> float:
        return 0.82 if self.redundancy <= 0 else min(self.redundancy, 1.0)


@dataclass(frozen=True)
class Search:
    """Limits of one search."""

    limit: int = 10
    rrf_k: int = 60
    include_expired: bool = False

    def __post_init__(self):
        if not 0 <= self.limit <= 50:
            raise ValueError("limit must be between 1 and 50, or 0 for the default")

    @property
    def results(self) -> int:
        return self.limit or 10

    @property
    def candidates(self) -> int:
        return candidate_limit(self.limit)

    @property
    def prefetch(self) -> int:
        return prefetch_limit(self.candidates)


def candidate_limit(limit: int) -> int:
    return min(200, max(20, 4 * (limit if limit > 0 else 10)))


def prefetch_limit(candidates: int) -> int:
    return min(600, 3 * candidates)


def list_limit(limit: int, default: int = 50, most: int = 100) -> int:
    """The limit of a listing; 0 takes the default, more than ``most`` is an error."""
    if not 0 <= limit <= most:
        raise ValueError(f"limit must be between 1 and {most}")
    return limit or default
