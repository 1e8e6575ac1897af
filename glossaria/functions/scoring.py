"""Confidence, decisions and domain inference."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossaria.functions.constants import NAME_DOMAINS, PATH_DOMAINS
from glossaria.plans.config import MatchConfig


def clamp(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def weighted_confidence(signals: list[Column], cfg: MatchConfig) -> Column:
    """Weighted sum of fused, lexical, edit, type and domain signals, held to [0, 1]."""
    return clamp(sum(w * s for w, s in zip(cfg.weights, signals)))


def decision(rank: Column, confidence: Column, margin: Column, cfg: MatchConfig) -> Column:
    """AUTO_APPROVE needs rank 1, the confidence, and the lead (none behind: any lead)."""
    sure = (rank == 1) & (confidence >= cfg.auto_threshold) & (margin.isNull() | (margin >= cfg.min_gap))
    return F.when(sure, "AUTO_APPROVE").when(confidence >= cfg.review_threshold, "REVIEW").otherwise("REJECT")


def field_decision(top: Column, cosine: Column, floor: float | None) -> Column:
    """One verdict per field; NO_MATCH without a match or below the absolute floor."""
    out = F.coalesce(top, F.lit("NO_MATCH"))
    if floor is not None:
        out = F.when(F.coalesce(cosine, F.lit(-1.0)) < floor, "NO_MATCH").otherwise(out)
    return out


def _first_contained(text: Column, table) -> Column:
    out = F.lit(None).cast("string")
    for part, domain in reversed(table):
        out = F.when(text.contains(part), domain).otherwise(out)
    return out


def inferred_domain(declared: Column, parent_path: Column, name: Column) -> Column:
    """The declared domain, else one implied by the path, else by the name."""
    return F.coalesce(F.nullif(declared, F.lit("")), _first_contained(F.lower(parent_path), PATH_DOMAINS), _first_contained(F.lower(name), NAME_DOMAINS))
