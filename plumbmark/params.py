"""Tunables and closed value sets of the data model."""

from __future__ import annotations

from dataclasses import dataclass

#: Marks from strongest to weakest, object types, review states, corpus enumerations.
GROUNDED, INFERRED, EXTRAPOLATED, UNKNOWN = "⊢", "⊨", "⊬", "⊥"
TAGS = (GROUNDED, INFERRED, EXTRAPOLATED, UNKNOWN)
OBJECT_TYPES = ("wall_structural", "door", "window", "space_polygon", "dimension_text")
REVIEW = ("auto_accepted", "needs_human", "rejected")
LICENSES = ("CC-BY", "CC-BY-SA", "CC-BY-NC", "academic", "public", "check-required")
DOMAINS = ("global", "kr", "dwg_demo")
USAGES = ("demo-only", "training", "evaluation")
EXIT_STATES = ("in_progress", "SUCCESS", "FAILURE")


@dataclass(frozen=True)
class Params:
    """Thresholds in pixels, degrees and ratios."""

    angle: float = 3.0
    wall_gap: tuple[float, float] = (3.0, 18.0)
    wall_overlap: float = 0.55
    window_gap: tuple[float, float] = (3.0, 14.0)
    door_slack: float = 8.0
    window_slack: float = 10.0
    least_evidence: int = 2
    space_area: float = 20000.0
    anchor_length: float = 50.0
    anchor_tolerance: float = 0.05
    least_bytes: int = 8192


DEFAULT = Params()
