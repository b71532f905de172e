"""Settings of a run: typed, frozen, from YAML or defaults."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field

from palimpsest.functions import fixed


@dataclass(frozen=True)
class CascadeConfig:
    """What inspect() is told."""

    decide_at: float = fixed.RULES_DECIDE
    lo: float = fixed.TAU_LO
    hi: float = fixed.TAU_HI
    policy: str = "sanitize"
    marker: str = fixed.MARKER
    least: float = fixed.MIN_KEPT_SHARE
    use_query: bool = True

    def settings(self) -> dict:
        return dataclasses.asdict(self)


@dataclass(frozen=True)
class DataConfig:
    """What the dataset build is told."""

    calibration_min: int = fixed.CALIBRATION_MIN
    seed: int = 42


@dataclass(frozen=True)
class EvaluationConfig:
    fpr_low: float = min(fixed.TARGET_FPRS)
    fpr_high: float = max(fixed.TARGET_FPRS)
    bootstrap_n: int = fixed.BOOTSTRAP_N


@dataclass(frozen=True)
class Config:
    cascade: CascadeConfig = field(default_factory=CascadeConfig)
    data: DataConfig = field(default_factory=DataConfig)
    evaluation: EvaluationConfig = field(default_factory=EvaluationConfig)


def from_dict(given: dict) -> Config:
    """A Config; unknown sections or keys raise, numbers are cast to their field's type."""
    parts = {}
    sections = {f.name: f.default_factory for f in dataclasses.fields(Config)}
    for name, values in (given or {}).items():
        if name not in sections:
            raise KeyError(f"no section {name!r}")
        base = sections[name]()
        known = {f.name: type(getattr(base, f.name)) for f in dataclasses.fields(base)}
        if unknown := set(values or {}) - set(known):
            raise KeyError(f"no setting {sorted(unknown)} in {name!r}")
        parts[name] = dataclasses.replace(base, **{k: known[k](v) for k, v in (values or {}).items()})
    return Config(**parts)


def load(path: str) -> Config:
    import yaml

    with open(path, encoding="utf-8") as f:
        return from_dict(yaml.safe_load(f))
