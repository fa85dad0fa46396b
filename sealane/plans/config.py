"""Settings: thresholds and what a run reads and writes."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Thresholds:
    corridor_m: float = 3_000.0
    survey_buffer_m: float = 15_000.0
    drag_min_sog: float = 0.3
    drag_max_sog: float = 5.0
    drag_min_duration_s: float = 1_800.0
    drag_min_distance_m: float = 3_000.0
    drag_min_cog_stability: float = 0.94
    drag_speed_ratio: float = 0.55
    drag_baseline_min_kn: float = 6.0
    drag_strict_cog_stability: float = 0.985
    drag_strict_distance_m: float = 5_000.0
    loiter_max_sog: float = 2.0
    loiter_min_duration_s: float = 7_200.0
    survey_min_duration_s: float = 10_800.0
    survey_min_sog: float = 2.5
    survey_min_extent_m: float = 5_000.0
    survey_min_lobe_share: float = 0.55
    survey_min_lobe_balance: float = 0.30
    survey_min_legs: int = 4
    gap_min_s: float = 3_600.0
    gap_max_s: float = 172_800.0
    gap_max_entry_dist_m: float = 25_000.0
    survey_reciprocal_tolerance_deg: float = 35.0
    impossible_kn: float = 60.0
    max_gap_for_continuity_s: float = 1_800.0

    def with_known(self, values: dict) -> Thresholds:
        """These with the known names of ``values`` replaced; unknown names are ignored."""
        kinds = {f.name: type(getattr(self, f.name)) for f in fields(self)}
        return replace(self, **{k: kinds[k](v) for k, v in values.items() if k in kinds})


@dataclass
class Settings:
    name: str = "world"
    bbox: tuple[float, float, float, float] = (-180.0, -90.0, 180.0, 90.0)
    sources: list[str] = field(default_factory=list)
    thresholds: Thresholds = field(default_factory=Thresholds)
    data_dir: str = "data"
    site_data_dir: str = "site"
    window_days: int = 7
    retain_days: int = 45
    max_detections_published: int = 500

    @classmethod
    def load(cls, path: str) -> Settings:
        import yaml

        raw = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
        known = {k: v for k, v in raw.items() if k in {f.name for f in fields(cls)} - {"thresholds"}}
        if "bbox" in known:
            known["bbox"] = tuple(float(x) for x in known["bbox"])
        return cls(**known, thresholds=Thresholds().with_known(raw.get("thresholds") or {}))

    def covers(self, other: tuple[float, float, float, float]) -> bool:
        """Whether another area overlaps this one."""
        a, b = self.bbox, other
        return a[0] <= b[2] and b[0] <= a[2] and a[1] <= b[3] and b[1] <= a[3]
