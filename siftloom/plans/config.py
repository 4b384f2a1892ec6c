"""Typed settings with overrides by file, environment and dotted names."""

from __future__ import annotations

import dataclasses
import os
from pathlib import Path
from typing import Any

from siftloom.functions import constants as k


def _list(*values: Any) -> Any:
    return dataclasses.field(default_factory=lambda: list(values))


#: Names and defaults of all settings below.
@dataclasses.dataclass
class DataConfig:
    """Where the inputs are, and the names of their fields."""

    test_set: str = ""
    model_outputs: dict[str, str] = dataclasses.field(default_factory=dict)
    answer_key: str = ""
    human_annotations: str = ""
    prompt_id_field: str = "prompt_id"
    response_field: str = "response"
    category_field: str = "category"


@dataclasses.dataclass
class JudgeConfig:
    """The model that judges: no model and no address by default."""

    primary: str = ""
    api_base: str = ""
    api_key: str = ""
    temperature: float = 0.0
    prompt_template: str = ""
    concurrency: int = 5
    max_tokens: int = 4096
    max_response_chars: int = 6000


@dataclasses.dataclass
class ConsistencyConfig:
    """Rounds of judging."""

    num_rounds: int = 3
    temperatures: list[float] = _list(0.0, 0.05, 0.1)
    variance_threshold: float = 1.5
    aggregation: str = "median"


@dataclasses.dataclass
class StatsConfig:
    trimmed_ratio: float = 0.1
    bootstrap_n: int = 1000
    confidence_level: float = 0.95
    hypothesis_tests: list[str] = _list("wilcoxon", "sign_test")


@dataclasses.dataclass
class AnomalyConfig:
    common_anomaly_threshold: float = 2.0
    low_percent: float = 5
    high_percent: float = 95
    ngram_repeat_threshold: float = 0.3
    judge_disagreement_threshold: int = 2


@dataclasses.dataclass
class LongAnswerConfig:
    ngram_sizes: list[int] = _list(3, 4, 5)
    template_endings: list[str] = _list(*k.EVALUATOR_ENDINGS)
    half_split_ratio: float = 0.5


@dataclasses.dataclass
class ReportConfig:
    formats: list[str] = _list("markdown", "csv")
    charts: bool = True
    language: str = "zh"


@dataclasses.dataclass
class EvalConfig:
    name: str = "long-answer-evaluation"
    output_dir: str = "./outputs"
    modes: list[str] = _list("pairwise", "single")
    baseline: str = "base"
    candidates: list[str] = _list()
    dimensions: list[str] = _list(*k.DIMENSIONS)
    data: DataConfig = dataclasses.field(default_factory=DataConfig)
    judge: JudgeConfig = dataclasses.field(default_factory=JudgeConfig)
    consistency: ConsistencyConfig = dataclasses.field(default_factory=ConsistencyConfig)
    stats: StatsConfig = dataclasses.field(default_factory=StatsConfig)
    anomaly: AnomalyConfig = dataclasses.field(default_factory=AnomalyConfig)
    long_answer: LongAnswerConfig = dataclasses.field(default_factory=LongAnswerConfig)
    report: ReportConfig = dataclasses.field(default_factory=ReportConfig)


#: Sections of a settings file whose entries are settings of the whole, and the one setting that is a pair there.
TOP_SECTIONS = ("project", "eval")
PERCENTILES = ("anomaly", "length_percentile")


def from_sections(values: dict[str, Any]) -> dict[str, Any]:
    """The settings of a file by sections: project and eval are settings of the whole, a pair of percentiles is two settings."""
    out = {n: dict(v) if isinstance(v, dict) else v for n, v in values.items() if n not in TOP_SECTIONS}
    for section in TOP_SECTIONS:
        out |= values.get(section) or {}
    section, name = PERCENTILES
    if isinstance(out.get(section), dict) and name in out[section]:
        out[section]["low_percent"], out[section]["high_percent"] = out[section].pop(name)
    return out


def apply(config: Any, values: dict[str, Any]) -> Any:
    """Nested or dotted values set on a dataclass; unknown names are errors, strings become the field's type."""
    for name, value in values.items():
        head, _, rest = name.partition(".")
        if head not in {f.name for f in dataclasses.fields(config)}:
            raise KeyError(f"unknown setting {name}")
        now = getattr(config, head)
        if rest:
            apply(now, {rest: value})
        elif dataclasses.is_dataclass(now):
            apply(now, value)
        elif isinstance(value, str) and not isinstance(now, str):
            kind = type(now)
            setattr(config, head, [x for x in value.split(",") if x] if kind is list else value.lower() in ("1", "true", "yes") if kind is bool else kind(value))
        else:
            setattr(config, head, value)
    return config


def load(path: str | None = None, overrides: dict[str, Any] | None = None, prefix: str = "SIFTLOOM_") -> EvalConfig:
    """Defaults, then the YAML file (an error if it is missing), then the environment (two underscores for a point), then overrides."""
    config = EvalConfig()
    if path:
        import yaml

        apply(config, from_sections(yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}))
    apply(config, {n[len(prefix) :].lower().replace("__", "."): v for n, v in os.environ.items() if n.startswith(prefix)})
    return apply(config, overrides or {})
