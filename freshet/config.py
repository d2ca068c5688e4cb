"""Run configuration: frozen dataclasses, JSON in and out, and a content hash."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from dataclasses import dataclass, field
from enum import Enum
from pathlib import Path
from typing import Any

# Source variable → short band name.
BANDS = {
    "total_precipitation_hourly": "tp",
    "temperature_2m": "t2m",
    "u_component_of_wind_10m": "u10",
    "v_component_of_wind_10m": "v10",
    "surface_pressure": "sp",
}
TARGET_BAND = "tp"


class SampleMode(str, Enum):
    PIXEL = "pixel"
    REGION = "region"
    PATCH = "patch"


class TargetMode(str, Enum):
    PIECEWISE = "piecewise"
    SIGMOID = "sigmoid"
    TANH = "tanh"


class SplitStrategy(str, Enum):
    FIXED = "fixed"
    ROLLING = "rolling"
    EXPANDING = "expanding"


@dataclass(frozen=True)
class SeriesKeys:
    """Which columns identify a series and order it. ``tie`` breaks equal times."""

    entity: str = "pixel_id"
    time: str = "time"
    tie: tuple[str, ...] = ()

    @property
    def order(self) -> list[str]:
        return [self.time, *self.tie]


@dataclass(frozen=True)
class FuzzyConfig:
    mode: TargetMode = TargetMode.SIGMOID
    eps: float = 0.02
    thresholds_dir: str = "data/raster"


@dataclass(frozen=True)
class FeatureConfig:
    bands: tuple[str, ...] = tuple(BANDS.values())
    rolling_windows: tuple[int, ...] = (3, 6)
    rolling_stats: tuple[str, ...] = ("mean", "std")
    include_lags: bool = True
    include_rolling: bool = True
    include_spatial_coords: bool = True
    include_temporal: bool = True
    patch_size: int = 5
    region_stats: tuple[str, ...] = ("mean", "std", "min", "max", "median")


@dataclass(frozen=True)
class SplitConfig:
    """Cut dates are instants: a bare date means midnight, unless ``end_of_day``."""

    strategy: SplitStrategy = SplitStrategy.FIXED
    train_end: str = "2022-12-31"
    val_end: str = "2023-01-31"
    window_train_size: int | None = None
    window_val_size: int | None = None
    step_size: int | None = None
    spatial_block_col: str | None = None
    end_of_day: bool = False


@dataclass(frozen=True)
class TuningConfig:
    enabled: bool = False
    n_trials: int = 30
    timeout_per_model: int | None = None
    n_cv_folds: int = 3
    cv_gap: int = 0
    metric: str = "brier"
    direction: str = "minimize"
    calibration_method: str = "f1"


@dataclass(frozen=True)
class PipelineConfig:
    cube_dir: str = "data/raster/cube"
    cube_nc: str = "data/raster/climatology"
    thresholds_dir: str = "data/raster"
    roi_file: str | None = None
    output_dir: str = "experiments"
    p_values: tuple[int, ...] = (3, 6, 12, 24)
    q_values: tuple[int, ...] = (1, 3, 6)
    sample_mode: SampleMode = SampleMode.PIXEL
    feature_config: FeatureConfig = field(default_factory=FeatureConfig)
    fuzzy_config: FuzzyConfig = field(default_factory=FuzzyConfig)
    split_config: SplitConfig = field(default_factory=SplitConfig)
    tuning_config: TuningConfig = field(default_factory=TuningConfig)
    spatial_stride: int = 2
    max_files: int | None = None
    sample_frac: float = 1.0
    random_seed: int = 42

    def to_dict(self) -> dict[str, Any]:
        return json.loads(json.dumps(dataclasses.asdict(self)))

    def save(self, path: str | Path) -> None:
        path = Path(path)
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(json.dumps(self.to_dict(), indent=2))

    @classmethod
    def load(cls, path: str | Path) -> "PipelineConfig":
        return cls.from_dict(json.loads(Path(path).read_text()))

    @classmethod
    def from_dict(cls, raw: dict[str, Any]) -> "PipelineConfig":
        """Rebuild from JSON; keys of older files that no longer exist are ignored."""
        raw = dict(raw)
        if "p95_file" in raw:
            raw.setdefault("thresholds_dir", str(Path(raw["p95_file"]).parent))
        return _rebuild(cls, raw)

    def content_hash(self, *parts: str) -> str:
        """Hash of the named fields (all by default), to key caches by what made them."""
        body = self.to_dict()
        if parts:
            body = {k: body[k] for k in parts}
        return hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()


_NESTED = {
    "feature_config": FeatureConfig,
    "fuzzy_config": FuzzyConfig,
    "split_config": SplitConfig,
    "tuning_config": TuningConfig,
}
_ENUMS = {"sample_mode": SampleMode, "mode": TargetMode, "strategy": SplitStrategy}


def _rebuild(cls, raw: dict[str, Any]):
    known = {f.name for f in dataclasses.fields(cls)}
    values = {}
    for key, value in raw.items():
        if key not in known:
            continue
        if key in _NESTED:
            value = _rebuild(_NESTED[key], value)
        elif key in _ENUMS:
            value = _ENUMS[key](value)
        elif isinstance(value, list):
            value = tuple(value)
        values[key] = value
    return cls(**values)


def default_config() -> PipelineConfig:
    """The full grid: four lookbacks by three horizons over all bands."""
    return PipelineConfig(tuning_config=TuningConfig(cv_gap=1))


def quick_config() -> PipelineConfig:
    """A small grid on a tenth of the rows and one band."""
    return dataclasses.replace(
        default_config(),
        output_dir="experiments_quick",
        p_values=(3, 6),
        q_values=(1, 3),
        sample_frac=0.10,
        spatial_stride=4,
        feature_config=FeatureConfig(bands=("tp",), rolling_windows=(3,), rolling_stats=("mean",)),
    )
