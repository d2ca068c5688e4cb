import json

import pytest

from freshet.config import (
    FuzzyConfig, PipelineConfig, SampleMode, SplitConfig, TargetMode, TuningConfig, default_config, quick_config,
)


def test_round_trip(tmp_path):
    cfg = PipelineConfig(p_values=(3, 6), fuzzy_config=FuzzyConfig(TargetMode.TANH, 0.05))
    cfg.save(tmp_path / "c" / "run.json")
    assert PipelineConfig.load(tmp_path / "c" / "run.json") == cfg


def test_defaults():
    cfg = default_config()
    assert cfg.sample_mode is SampleMode.PIXEL and cfg.fuzzy_config.mode is TargetMode.SIGMOID
    assert cfg.p_values == (3, 6, 12, 24) and cfg.q_values == (1, 3, 6) and cfg.tuning_config.cv_gap == 1
    quick = quick_config()
    assert quick.feature_config.bands == ("tp",) and quick.sample_frac == 0.1 and quick.spatial_stride == 4


def test_old_files_load():
    raw = PipelineConfig().to_dict()
    raw.pop("tuning_config")
    raw["fuzzy_config"] |= {"slope": 2.0, "offset": 0.0, "p95_source": "x"}
    raw["p95_file"] = raw.pop("thresholds_dir") + "/p95.tif"
    cfg = PipelineConfig.from_dict(json.loads(json.dumps(raw)))
    assert cfg.tuning_config == TuningConfig() and cfg.thresholds_dir == "data/raster"


def test_content_hash():
    a, b = PipelineConfig(), PipelineConfig(split_config=SplitConfig(train_end="2020-01-01"))
    assert len(a.content_hash()) == 64 and a.content_hash() != b.content_hash()
    assert a.content_hash("p_values", "q_values") == b.content_hash("p_values", "q_values")


def test_unknown_mode():
    with pytest.raises(ValueError):
        PipelineConfig.from_dict({"sample_mode": "cloud"})
