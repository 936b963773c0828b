"""Numbers of the routing plan. They become literals in it."""

from __future__ import annotations

from dataclasses import dataclass, field


# Thresholds, weights, bands and evidence weights.
@dataclass(frozen=True)
class Thresholds:
    notify_floor: float = 0.42
    mute_ceiling: float = 0.08
    urgency_gate: float = 0.20
    action_gate: float = 0.40
    scam_mute: float = 0.55
    spam_mute: float = 0.62
    injection_mute: float = 0.50
    notify_veto: float = 0.35
    gray_halfwidth: float = 0.08


@dataclass(frozen=True)
class Weights:
    urgency: float = 0.34
    trust: float = 0.18
    relationship: float = 0.20
    actionability: float = 0.16
    importance: float = 0.12
    fatigue: float = 0.10
    repetition: float = 0.28
    promo: float = 0.22
    quiet: float = 0.06
    forward: float = 0.14


@dataclass(frozen=True)
class Evidence:
    semantic: float = 0.45
    structural: float = 0.30
    behavioural: float = 0.25
    min_total: float = 0.18
    min_structural: float = 0.12
    min_semantic: float = 0.45
    similar_k: int = 40


@dataclass(frozen=True)
class Settings:
    thresholds: Thresholds = field(default_factory=Thresholds)
    weights: Weights = field(default_factory=Weights)
    evidence: Evidence = field(default_factory=Evidence)
    bands: tuple[tuple[str, float, float], ...] = (("notify", 0.85, 0.91), ("digest", 0.78, 0.84), ("mute", 0.81, 0.87))
    second_opinions: int = 140


DEFAULT = Settings()
ACTIONS = ("notify", "digest", "mute")
MESSAGE_TYPES = ("urgent", "payment", "event", "business_update", "personal", "unknown", "forward", "greeting", "promotion", "spam", "scam")
WORK_GROUPS = ("coworker", "college_faculty", "tech_community")
SCHOOL_GROUPS = ("school_group",)
OPERATIONAL_GROUPS = ("society", "safety", "caregiving", "family", "extended_family")
