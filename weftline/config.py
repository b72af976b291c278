"""Run configurations: JSON with features, model and data folders."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from .models import MODELS


@dataclass(frozen=True)
class Config:
    features: tuple[str, ...]
    stacking_features: tuple[str, ...] = ()
    model: str = "LightGBM"
    kfold: dict = field(default_factory=dict)
    params: dict = field(default_factory=dict)
    dataset: dict = field(default_factory=dict)
    options: dict = field(default_factory=dict)
    normalize_feature: bool = False
    feature_sample_rate: float = 1.0
    threshold: float = 0.0
    note: str = ""

    @property
    def folds(self) -> int:
        return int(self.kfold.get("n_splits", 5))

    @property
    def seed(self) -> int:
        return int(self.kfold.get("random_state", 47))


def parse(text: str) -> Config:
    """A configuration from JSON; single quotes and Python's True, False and None are read as JSON's own."""
    try:
        raw = json.loads(text)
    except json.JSONDecodeError:
        raw = json.loads(text.replace("'", '"').replace("True", "true").replace("False", "false").replace("None", "null"))
    model = raw.get("model", {})
    name = model.get("name", "LightGBM")
    if name not in MODELS:
        raise ValueError(f"no model {name}; there are {sorted(MODELS)}")
    if not raw.get("features") and not raw.get("stacking_features"):
        raise ValueError("a configuration names features or stacking_features")
    return Config(
        tuple(raw.get("features", ())),
        tuple(raw.get("stacking_features", ())),
        name,
        model.get("kfold_params", {}),
        {**model.get("clf_params", {}), **model.get("train_params", {})},
        raw.get("dataset", {}),
        raw.get("options", {}),
        bool(raw.get("normalize_feature", False)),
        float(raw.get("feature_sample_rate", 1.0)),
        float(raw.get("threshold", 0.0)),
        str(raw.get("note", "")),
    )


def read(path: str | Path) -> Config:
    return parse(Path(path).read_text())
