"""Settings of the matching plan."""

from __future__ import annotations

import dataclasses
import json
import tomllib
from dataclasses import dataclass


@dataclass(frozen=True)
class MatchConfig:
    dense_top_k: int = 100
    sparse_top_k: int = 100
    fusion_alpha: float = 0.90
    colbert_top_k: int = 50
    pool_size: int = 20
    semantic_weight: float = 0.70
    lexical_weight: float = 0.05
    edit_weight: float = 0.05
    type_weight: float = 0.05
    domain_weight: float = 0.15
    auto_threshold: float = 0.87
    review_threshold: float = 0.50
    min_gap: float = 0.10
    absolute_floor: float | None = None
    results_per_field: int = 5
    expand_abbreviations: bool = False
    alias_count: int = 0

    def __post_init__(self):
        if abs(sum(self.weights) - 1) > 1e-6:
            raise ValueError(f"the weights add up to {sum(self.weights)}, not 1")
        for name in ("fusion_alpha", "auto_threshold", "review_threshold", "min_gap", *(["absolute_floor"] if self.absolute_floor is not None else [])):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} is outside [0, 1]")
        for name in ("dense_top_k", "sparse_top_k", "pool_size", "results_per_field"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} is less than 1")
        if self.review_threshold > self.auto_threshold:
            raise ValueError("review_threshold is above auto_threshold")

    @property
    def weights(self) -> tuple[float, ...]:
        return (self.semantic_weight, self.lexical_weight, self.edit_weight, self.type_weight, self.domain_weight)

    @property
    def structural_floor(self) -> float:
        """The least confidence that a field's best fused candidate can have."""
        return min(1.0, max(0.0, self.semantic_weight * self.fusion_alpha))

    @classmethod
    def load(cls, text: str, kind: str = "json") -> MatchConfig:
        """From JSON or TOML text; unknown keys are refused."""
        values = json.loads(text) if kind == "json" else tomllib.loads(text)
        known = {f.name for f in dataclasses.fields(cls)}
        if unknown := sorted(set(values) - known):
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        return cls(**values)


PROFILES = {
    "default": MatchConfig(),
    "strict": MatchConfig(auto_threshold=0.95, min_gap=0.15),
    "expanding": MatchConfig(expand_abbreviations=True),
}
