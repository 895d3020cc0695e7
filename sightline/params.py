"""Job parameters: plain Python values that shape the plans, never data."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping
from dataclasses import dataclass, field

DEFAULT_ZONE = "America/New_York"
DEFAULT_GAP_MINUTES = 20.0
DEFAULT_BODY_BYTES = 2 * 1024 * 1024
MIN_BODY_BYTES = 64
MAX_BODY_BYTES = 25 * 1024 * 1024

HOUR_MS = 60 * 60 * 1000
DAY_MS = 24 * HOUR_MS


def minutes_map(raw: str | Mapping | None) -> dict[str, float]:
    """Gap overrides. Numeric text is accepted, useless entries and bad JSON are dropped."""
    if isinstance(raw, str):
        try:
            raw = json.loads(raw) if raw.strip() else {}
        except ValueError:
            raw = {}
    if not isinstance(raw, Mapping):
        return {}
    out = {}
    for key, value in raw.items():
        try:
            minutes = float(value)
        except (TypeError, ValueError):
            continue
        if math.isfinite(minutes) and minutes > 0:
            out[str(key)] = minutes
    return out


def lowered_list(raw: str | None) -> tuple[str, ...]:
    """Comma-separated list, trimmed and lower-cased, blanks removed."""
    return tuple(p.strip().lower() for p in (raw or "").split(",") if p.strip())


@dataclass(frozen=True)
class GapRules:
    """How long an entity may be out of sight before its session ends."""

    default_minutes: float = DEFAULT_GAP_MINUTES
    by_entity: Mapping[str, float] = field(default_factory=dict)
    by_camera: Mapping[str, float] = field(default_factory=dict)

    @property
    def default_ms(self) -> float:
        ok = math.isfinite(self.default_minutes) and self.default_minutes > 0
        return (self.default_minutes if ok else DEFAULT_GAP_MINUTES) * 60_000.0


@dataclass(frozen=True)
class JobParams:
    zone: str = DEFAULT_ZONE
    gaps: GapRules = field(default_factory=GapRules)
    target_names: tuple[str, ...] = ()
    target_ids: tuple[str, ...] = ()
    cameras: tuple[str, ...] = ()
    vehicles: bool = False
    max_body_bytes: int = DEFAULT_BODY_BYTES

    @classmethod
    def from_options(cls, options: Mapping[str, str]) -> "JobParams":
        """Build from text options, e.g. `spark.conf`-style settings of a scheduled job."""
        try:
            default_gap = float(options.get("gap_minutes", DEFAULT_GAP_MINUTES))
        except ValueError:
            default_gap = DEFAULT_GAP_MINUTES
        limit = DEFAULT_BODY_BYTES
        if str(options.get("max_body_bytes", "")).strip():
            limit = float(options["max_body_bytes"])
            if not math.isfinite(limit) or not MIN_BODY_BYTES <= limit <= MAX_BODY_BYTES:
                raise ValueError(
                    f"max_body_bytes must lie in {MIN_BODY_BYTES}..{MAX_BODY_BYTES}"
                )
        return cls(
            zone=(options.get("zone") or DEFAULT_ZONE).strip(),
            gaps=GapRules(
                default_gap,
                minutes_map(options.get("gap_by_person")),
                minutes_map(options.get("gap_by_camera")),
            ),
            target_names=lowered_list(options.get("target_names")),
            target_ids=lowered_list(options.get("target_ids")),
            cameras=lowered_list(options.get("cameras")),
            vehicles=str(options.get("vehicles", "")).strip().lower() == "true",
            max_body_bytes=math.floor(limit),
        )
