"""Closed vocabularies, presets and thresholds of the decision pipeline (fixed values of its contract)."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

TIER_OF_STARS = {0: "waste", 1: "valuable", 2: "coverage", 3: "primary"}
STARS_OF_TIER = {v: k for k, v in TIER_OF_STARS.items()}
ORIGINS = ("ai", "coverage", "manual", "legacy")
SEVERE_ISSUES = ("closed_eyes", "soft_subject", "occluded", "abnormal_pose", "bad_exposure", "noisy")
BLOCKING_ISSUES = ("closed_eyes", "soft_subject", "bad_exposure")
# File suffixes that a scan takes.
OTHER_SUFFIXES = ("jpg", "jpeg", "png", "bmp", "tif", "tiff", "webp", "heic", "heif")
RAW_SUFFIXES = ("cr2", "cr3", "nef", "arw", "raf", "dng", "rw2", "orf", "srw", "pef")


@dataclass(frozen=True)
class Preset:
    """Windows and thresholds of grouping at one strictness."""

    threshold: float
    join_seconds: float
    sequence_limit: int
    merge_seconds: float
    merge_sequence: int
    span_seconds: float
    span_sequence: int
    pose_floor: float
    merge_time: float  # with shared people
    merge_time_alone: float
    scene_slack: float
    total_slack: float
    merge_semantic: float
    pose_near: tuple[float, float, float]  # pose, depth and time from which a near-equal pose carries a match
    hard_seconds: float = 45.0


PRESETS = {
    "cautious": Preset(0.81, 7, 7, 10, 10, 7, 7, 0.48, 0.68, 0.76, 0.02, 0.04, 0.91, (0.95, 0.78, 0.70)),
    "balanced": Preset(0.73, 16, 16, 28, 28, 16, 16, 0.34, 0.46, 0.56, 0.05, 0.07, 0.82, (0.92, 0.72, 0.48)),
    "aggressive": Preset(0.66, 30, 28, 48, 44, 30, 28, 0.24, 0.26, 0.34, 0.07, 0.09, 0.74, (0.89, 0.66, 0.28)),
}


def preset(name: str | None) -> Preset:
    """The preset of that name; unknown names mean balanced."""
    return PRESETS.get(name or "", PRESETS["balanced"])


@dataclass(frozen=True)
class Settings:
    """Engine settings; changed() drops unknown keys and keeps numbers in range."""

    preset: str = "balanced"
    recursive: bool = True
    keep_per_group: int = 1
    coverage_enabled: bool = True
    stage_minutes: float = 20.0
    min_score: float = 55.0
    primary_share: float = 0.65
    delivery_share: float = 0.75
    learned_share: float = 0.75
    group_demote: float = 0.55
    beat_demote: float = 0.10

    def changed(self, **values) -> Settings:
        known = {f.name for f in fields(self)}
        new = replace(self, **{k: v for k, v in values.items() if k in known})
        clamp = lambda x, lo, hi: max(lo, min(hi, x))
        return replace(
            new, preset=new.preset if new.preset in PRESETS else "balanced", keep_per_group=clamp(int(new.keep_per_group), 1, 10),
            stage_minutes=clamp(float(new.stage_minutes), 5.0, 60.0), min_score=clamp(float(new.min_score), 0.0, 100.0),
            primary_share=clamp(new.primary_share, 0.0, 1.0), delivery_share=clamp(new.delivery_share, 0.0, 1.0),
        )
