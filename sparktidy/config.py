"""Defaults shared by the operators."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields, replace
from pathlib import Path


#: What a setting has to fulfil, for those that cannot take any value of their type.
RULES = {"random_state": lambda v: v >= 0, "chunk_size": lambda v: v >= 1, "sample_size": lambda v: v >= 1,
         "missing_value_threshold": lambda v: 0 < v <= 1, "correlation_threshold": lambda v: 0 < v <= 1}


@dataclass(frozen=True)
class Config:
    # Defaults every operator falls back to.
    random_state: int = 42
    chunk_size: int = 10000
    sample_size: int = 1000
    max_unique_values_display: int = 20
    default_encoding: str = "utf-8"
    csv_delimiter: str = ","
    missing_value_threshold: float = 0.9
    correlation_threshold: float = 0.90
    outlier_method: str = "iqr"
    outlier_factor: float = 1.5
    max_categories_plot: int = 20
    max_features_for_onehot: int = 30
    max_features_for_label: int = 300
    default_export_format: str = "csv"
    export_compression: str | None = None

    def __post_init__(self):
        wrong = [name for name, fits in RULES.items() if not fits(getattr(self, name))]
        if wrong:
            raise ValueError(f"settings out of range: {', '.join(sorted(wrong))}")

    def update(self, **changes) -> "Config":
        unknown = set(changes) - {f.name for f in fields(self)}
        if unknown:
            raise TypeError(f"unknown settings: {sorted(unknown)}")
        return replace(self, **changes)

    def to_file(self, path: str | Path) -> None:
        Path(path).write_text(json.dumps(asdict(self), indent=2), encoding="utf-8")

    @classmethod
    def from_file(cls, path: str | Path) -> "Config":
        return cls().update(**json.loads(Path(path).read_text(encoding="utf-8")))


_current = Config()


def get_config() -> Config:
    return _current


def update_config(**changes) -> Config:
    global _current
    _current = _current.update(**changes)
    return _current


def reset_config() -> Config:
    global _current
    _current = Config()
    return _current
