"""Thresholds and locations, read on the driver from YAML and used as literals in plans."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any


# The groups, keys and published thresholds of the cleaning rules, as a threshold file names them. Fields that
# are not published say so.


@dataclass(frozen=True)
class FixLevel:
    max_horizontal_speed_mps: dict[str, float] = field(default_factory=lambda: {"paragliders": 45.0, "hang gliders": 55.0})
    max_vertical_speed_mps: float = 13.0
    min_altitude_m: float = -100.0
    max_altitude_m: float = 6000.0
    hampel_window_s: float = 20.0
    hampel_k: float = 5.0
    hampel_eps_min_m: float = 15.0
    hampel_min_window_fixes: int = 5
    frozen_eps_m: float = 15.0
    frozen_tau_s: float = 60.0
    frozen_delta_z_m: float = 5.0
    integrity_max_fraction: float = 0.10
    # Our choice: the rules speak of a bounded block and give no number.
    block_max_s: float = 60.0


@dataclass(frozen=True)
class AltChannel:
    # Not a key of published files: the share of fixes from which a barometer counts as present.
    baro_present_frac: float = 0.5
    baro_min_range_m: float = 30.0


@dataclass(frozen=True)
class FlightLevel:
    min_duration_s: float = 2400.0
    max_duration_s: float = 57600.0
    min_path_km: float = 20.0
    min_alt_range_m: float = 75.0


@dataclass(frozen=True)
class Trimming:
    takeoff_speed_mps: float = 5.0
    sustained_s: float = 30.0
    interior_ground_s: float = 600.0
    ground_flatness_m: float = 5.0


@dataclass(frozen=True)
class Sampling:
    max_gap_factor: float = 10.0
    max_gap_seconds: float = 20.0
    # Not a key of published files: the intervals that the absolute bound always lets pass.
    gap_floor_ratio: float = 2.0
    max_missing_fraction: float = 0.10
    min_segment_duration_s: float = 90.0


@dataclass(frozen=True)
class SavGol:
    polyorder: int = 3
    tau_c_horizontal_s: float = 5.0
    tau_c_vertical_baro_s: float = 5.0
    tau_c_vertical_gnss_s: float = 5.0
    # Not a key of published files: the narrowest window, in points.
    window_min: int = 5


@dataclass(frozen=True)
class Thresholds:
    fix_level: FixLevel = field(default_factory=FixLevel)
    alt_channel: AltChannel = field(default_factory=AltChannel)
    flight_level: FlightLevel = field(default_factory=FlightLevel)
    trimming: Trimming = field(default_factory=Trimming)
    sampling: Sampling = field(default_factory=Sampling)
    savgol: SavGol = field(default_factory=SavGol)

    def table(self) -> list[tuple[str, float]]:
        """All thresholds as (name, value), for a report."""
        rows = []
        for group in fields(self):
            for f in fields(part := getattr(self, group.name)):
                value = getattr(part, f.name)
                rows += [(f"{group.name}.{f.name}.{k}", float(v)) for k, v in sorted(value.items())] if isinstance(value, dict) else [(f"{group.name}.{f.name}", float(value))]
        return rows


def load_thresholds(path: str | Path | None = None) -> Thresholds:
    """Thresholds of a YAML file over the defaults. A missing file is an error, and so is an unknown key."""
    if path is None:
        return Thresholds()
    import yaml

    raw = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    kinds = {f.name: f.default_factory for f in fields(Thresholds)}
    if unknown := set(raw) - set(kinds):
        raise TypeError(f"unknown groups: {sorted(unknown)}")
    return Thresholds(**{name: kinds[name](**(values or {})) for name, values in raw.items()})


@dataclass(frozen=True)
class Archive:
    """Where an archive of landed files lies: raw, catalog, derived and logs below one root."""

    root: str
    first_season: int
    last_season: int
    list_url: str = "https://host.invalid/list"
    extra: dict[str, Any] = field(default_factory=dict)

    @property
    def seasons(self) -> range:
        return range(self.first_season, self.last_season + 1)

    def path(self, kind: str, *parts: str) -> str:
        if kind not in ("raw/xml", "raw/tracks", "catalog", "derived", "logs"):
            raise KeyError(kind)
        return os.path.join(self.root, kind, *parts)


def load_archive(path: str | Path, root_env: str = "VANTRAIL_DATA_ROOT") -> Archive:
    """An archive's YAML: ``data_root`` (the variable ``root_env`` wins; ~ and variables are expanded), ``seasons`` with
    ``start`` and ``end``. A missing file or key is an error."""
    import yaml

    raw = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    root = os.environ.get(root_env) or raw.get("data_root")
    if not root:
        raise ValueError(f"no data_root in {path} and no {root_env} in the environment")
    return Archive(os.path.expanduser(os.path.expandvars(root)), int(raw["seasons"]["start"]), int(raw["seasons"]["end"]), raw.get("list_url", Archive.list_url), {k: v for k, v in raw.items() if k not in ("data_root", "seasons", "list_url")})
