"""Settings of a job, as frozen dataclasses, readable from YAML."""

from __future__ import annotations

import dataclasses
import typing
from dataclasses import dataclass, field
from typing import Any

#: Entities that are too common to match as a part of another (fixed values).
STOPWORDS = (
    "a", "an", "the", "it", "its", "is", "of", "to", "in", "on", "at", "and", "or",
    "this", "that", "these", "those", "he", "she", "they", "we", "you",
)


@dataclass(frozen=True)
class ExtractionSettings:
    model: str = "offline"
    temperature: float = 0.0
    cluster: bool = True
    chunk_chars: int = 6000
    max_retries: int = 5
    backoff_base_s: float = 2.0
    #: Calls in flight in each worker, and finished calls that are made durable at once.
    concurrency: int = 4
    portion_calls: int = 1
    #: Tasks that the calls are dealt to; as many as there are cores if not set.
    partitions: int | None = None


@dataclass(frozen=True)
class MatchSettings:
    # Fixed values as well.
    entity_threshold: float = 0.90
    relation_threshold: float = 0.75
    allow_substring: bool = True
    direction_sensitive: bool = True
    inverse_edges: bool = False
    min_substring_chars: int = 2
    stopwords: tuple[str, ...] = STOPWORDS

    @property
    def accepts_inverse(self) -> bool:
        return self.inverse_edges or not self.direction_sensitive


@dataclass(frozen=True)
class MetricSettings:
    alpha: float | None = None
    empty_policy: str = "report_both"
    impute_h: float = 0.5


@dataclass(frozen=True)
class EvalSettings:
    # Seed, resamples, grids, sweeps, folds and edges are fixed values: they have to be the same for the same results.
    seed: int = 42
    n_bootstrap: int = 1000
    alpha_grid: tuple[float, ...] = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
    alpha_folds: int = 5
    tau_e_sweep: tuple[float, ...] = (0.85, 0.90, 0.95)
    tau_r_sweep: tuple[float, ...] = (0.65, 0.75, 0.85)
    sweep_limit: int = 300
    length_edges: tuple[int, ...] = (0, 1000, 2000, 4000, 8000, 16000, 1000000)
    histogram_bins: int = 20


@dataclass(frozen=True)
class Settings:
    extraction: ExtractionSettings = field(default_factory=ExtractionSettings)
    matching: MatchSettings = field(default_factory=MatchSettings)
    metrics: MetricSettings = field(default_factory=MetricSettings)
    eval: EvalSettings = field(default_factory=EvalSettings)
    exclude_implicit_true: bool = False


def _build(kind: type, values: Any, at: str) -> Any:
    if not isinstance(values, dict):
        raise ValueError(f"{at}: a mapping is wanted, not {type(values).__name__}")
    known = typing.get_type_hints(kind)
    unknown = sorted(set(values) - set(known))
    if unknown:
        raise ValueError(f"{at}: unknown settings {', '.join(map(str, unknown))}")
    out = {}
    for name, value in values.items():
        if dataclasses.is_dataclass(known[name]):
            value = _build(known[name], value, f"{at}.{name}")
        out[name] = tuple(value) if isinstance(value, list) else value
    return kind(**out)


def from_mapping(values: dict[str, Any]) -> Settings:
    """Settings from nested mappings; unknown names are errors."""
    return _build(Settings, values, "settings")


def load(path: str) -> Settings:
    import yaml

    with open(path, encoding="utf-8") as f:
        return from_mapping(yaml.safe_load(f))
