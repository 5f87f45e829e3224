"""Knobs with their defaults; bounds are checked when a section is made."""

from __future__ import annotations

import json
from dataclasses import dataclass, field


@dataclass(frozen=True)
class TierWeights:
    institution: float = 1.0
    trade_press: float = 0.6
    community: float = 0.3

    def __post_init__(self):
        if not self.institution >= self.trade_press >= self.community >= 0:
            raise ValueError("tier weights must not rise from institution to community")


@dataclass(frozen=True)
class Collect:
    tier_weights: TierWeights = field(default_factory=TierWeights)
    repetition_weight: float = 1.0
    watchlist_bonus: float = 0.5
    front_page_bonus: float = 0.4
    max_per_source: int = 2


@dataclass(frozen=True)
class Extract:
    min_source_words: int = 250
    truncate_tokens: int = 2500
    body_cap_bytes: int = 2_000_000
    max_retries: int = 3
    backoff_initial_seconds: float = 1.0
    backoff_multiplier: float = 2.0


@dataclass(frozen=True)
class Evaluation:
    band_high_min: float = 0.80
    band_medium_min: float = 0.50
    truncation_gap_max: float = 0.10
    summary_words_min: int = 40
    summary_words_max: int = 250
    lead_coverage_floor: float = 0.3
    validation_articles: int = 20
    validation_drop_max: float = 0.10
    validation_switch_margin: float = 0.05

    def __post_init__(self):
        if not self.band_high_min > self.band_medium_min:
            raise ValueError("the high band must start above the medium one")
        if self.summary_words_min > self.summary_words_max:
            raise ValueError("the shortest summary must not be longer than the longest")


@dataclass(frozen=True)
class Drift:
    word_count_drop: float = 0.40
    extractiveness_rise: float = 0.15
    failure_rate_max: float = 0.20


@dataclass(frozen=True)
class Retention:
    visual_retention_months: int = -1
    max_deletes: int = 200
    budget_mb: int = 800
    cap_mb: int = 1024


@dataclass(frozen=True)
class Visuals:
    enabled: tuple[str, ...] = ("bar_chart", "diagram")
    max_facts: int = 16
    min_points: int = 3
    max_points: int = 8
    min_steps: int = 3
    max_steps: int = 6


@dataclass(frozen=True)
class Search:
    min_score: float = 0.2
    limit: int = 10


@dataclass(frozen=True)
class Settings:
    collect: Collect = field(default_factory=Collect)
    extract: Extract = field(default_factory=Extract)
    evaluation: Evaluation = field(default_factory=Evaluation)
    drift: Drift = field(default_factory=Drift)
    retention: Retention = field(default_factory=Retention)
    visuals: Visuals = field(default_factory=Visuals)
    search: Search = field(default_factory=Search)


def load(text: str) -> Settings:
    """Settings from JSON: sections by name, what is left out has its default, what is unknown is an error."""
    kinds = {"collect": Collect, "extract": Extract, "evaluation": Evaluation, "drift": Drift, "retention": Retention, "visuals": Visuals, "search": Search}
    raw = json.loads(text)
    if unknown := set(raw) - set(kinds):
        raise ValueError(f"unknown sections: {sorted(unknown)}")
    if "tier_weights" in raw.get("collect", {}):
        raw["collect"]["tier_weights"] = TierWeights(**raw["collect"]["tier_weights"])
    return Settings(**{name: kinds[name](**{k: tuple(v) if isinstance(v, list) else v for k, v in own.items()}) for name, own in raw.items()})


def load_folder(spark, folder: str, names: tuple[str, ...] = ("app.json", "sources.json", "taxonomy.json", "watchlist.json")) -> tuple[Settings, dict[str, dict], tuple[tuple[str, str], ...]]:
    """Settings of the first file, all files as they are, and (name, sha256) of each in order of names; a missing file is an error."""
    from pyspark.sql import functions as F

    rows = spark.read.format("binaryFile").load([f"{folder.rstrip('/')}/{n}" for n in names]).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.decode("content", "UTF-8").alias("text"), F.sha2("content", 256).alias("sha256"))
    read = {r.name: r for r in rows.collect()}  # one row for each name
    return load(read[names[0]].text), {n: json.loads(read[n].text) for n in names}, tuple((n, read[n].sha256) for n in sorted(names))
