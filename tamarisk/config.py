"""Settings of the compression operators, and how layers of them merge.

Defaults are overridden by a YAML file, that by environment variables
(`TAMARISK_<FIELD>`), and that by keyword overrides. A profile is a preset.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields, replace
from pathlib import Path
from typing import Any

ENV_PREFIX = "TAMARISK_"


@dataclass(frozen=True)
class EnergyWeights:
    w_statistical: float = 0.5
    w_structural: float = 0.3
    w_positional: float = 0.2


@dataclass(frozen=True)
class QuenchConfig:
    """The cooling schedule T(step) = T0 / (1 + cooling_rate * step) and what stops it."""

    temperature_initial: float = 1.0
    cooling_rate: float = 0.25
    similarity_threshold: float = 0.85
    frozen_patterns: tuple[str, ...] = (r"\[REDACTED_[a-f0-9]{8}\]",)
    energy_weights: EnergyWeights = field(default_factory=EnergyWeights)
    output_cooling: bool = True
    dedup_enabled: bool = True
    memory_enabled: bool = False
    min_tokens: int = 30
    survival_mode: str = "deterministic"  # or "boltzmann"
    boltzmann_k: float = 1.0
    multi_turn_enabled: bool = True
    protected_recent_turns: int = 2
    turn_decay: float = 0.7
    block_min_chars: int = 80
    cross_turn_freeze_chars: int = 400


@dataclass(frozen=True)
class ServerConfig:
    """Kept so that configuration files stay whole; nothing here serves requests."""

    port: int = 8080
    upstream_url: str = "http://localhost:11434/v1/chat/completions"
    log_level: str = "info"


def _flag(value: str) -> bool:
    return value.lower() in ("1", "true", "yes")


_QUENCH_ENV = {"temperature_initial": float, "cooling_rate": float, "similarity_threshold": float, "output_cooling": _flag, "dedup_enabled": _flag}
_WEIGHT_ENV = {"w_statistical": float, "w_structural": float, "w_positional": float}
_SERVER_ENV = {"port": int, "upstream_url": str, "log_level": str}
_QUENCH_YAML = {"temperature_initial": float, "cooling_rate": float, "similarity_threshold": float, "output_cooling": bool, "dedup_enabled": bool, "frozen_patterns": tuple}


def read_yaml(path: str | Path | None) -> dict[str, Any]:
    """A missing or empty file has no settings."""
    if not path or not Path(path).exists():
        return {}
    import yaml

    return yaml.safe_load(Path(path).read_text()) or {}


def _cast(kinds: dict, given: dict) -> dict:
    """Values that can't be read are passed over."""
    out = {}
    for name, kind in kinds.items():
        if name in given:
            try:
                out[name] = kind(given[name])
            except (ValueError, TypeError):
                continue
    return out


def _env(kinds: dict, env) -> dict:
    return _cast(kinds, {name: env[key] for name in kinds if (key := ENV_PREFIX + name.upper()) in env})


def _path(path, env) -> str | None:
    return path or env.get(ENV_PREFIX + "CONFIG") or None


def load_config(path: str | Path | None = None, overrides: dict | None = None, env=os.environ) -> QuenchConfig:
    """Weights in a file count only beside a section `quenching` (or `cooling`)."""
    data = read_yaml(_path(path, env))
    section = data.get("quenching", data.get("cooling", {}))
    config = QuenchConfig()
    if section:
        config = replace(config, **_cast(_QUENCH_YAML, section))
        config = replace(config, energy_weights=replace(config.energy_weights, **_cast(_WEIGHT_ENV, data.get("energy_weights") or {})))
    config = replace(config, **_env(_QUENCH_ENV, env))
    config = replace(config, energy_weights=replace(config.energy_weights, **_env(_WEIGHT_ENV, env)))
    known = {f.name for f in fields(config)}
    return replace(config, **{k: v for k, v in (overrides or {}).items() if v is not None and k in known})


def load_server_config(path: str | Path | None = None, overrides: dict | None = None, env=os.environ) -> ServerConfig:
    data = read_yaml(_path(path, env))
    config = replace(ServerConfig(), **_cast(_SERVER_ENV, data.get("server") or {}))
    config = replace(config, **_env(_SERVER_ENV, env))
    known = {f.name for f in fields(config)}
    return replace(config, **{k: v for k, v in (overrides or {}).items() if v is not None and k in known})


def with_profile(config: QuenchConfig, name: str, given: dict | None = None) -> QuenchConfig:
    """The profile's schedule, weights and switches where `given` names none. Its
    frozen patterns and least length are not taken over."""
    given = {k: v for k, v in (given or {}).items() if v is not None}
    profile = get_profile(name)
    names = ("temperature_initial", "cooling_rate", "similarity_threshold", "output_cooling", "dedup_enabled", "memory_enabled")
    weights = {w: given.get(w, getattr(profile.energy_weights, w)) for w in _WEIGHT_ENV}
    return replace(config, energy_weights=EnergyWeights(**weights), **{n: given.get(n, getattr(profile, n)) for n in names})


# The presets.
PROFILES = {
    "maximum": QuenchConfig(cooling_rate=0.5, similarity_threshold=0.72, energy_weights=EnergyWeights(0.6, 0.25, 0.15)),
    "best": QuenchConfig(cooling_rate=0.25, similarity_threshold=0.85, energy_weights=EnergyWeights(0.5, 0.3, 0.2), min_tokens=50),
    "mild": QuenchConfig(cooling_rate=0.15, similarity_threshold=0.90, energy_weights=EnergyWeights(0.4, 0.35, 0.25), min_tokens=100),
    "code": QuenchConfig(cooling_rate=0.2, similarity_threshold=0.85, energy_weights=EnergyWeights(0.4, 0.45, 0.15)),
    "system": QuenchConfig(cooling_rate=0.6, similarity_threshold=0.72, energy_weights=EnergyWeights(0.7, 0.15, 0.15)),
    "output": QuenchConfig(cooling_rate=0.8, similarity_threshold=0.68, energy_weights=EnergyWeights(0.7, 0.15, 0.15), dedup_enabled=False),
    "mcp": QuenchConfig(
        cooling_rate=0.15, similarity_threshold=0.88, energy_weights=EnergyWeights(0.35, 0.45, 0.20), min_tokens=80,
        frozen_patterns=(r"\[REDACTED_[a-f0-9]{8}\]", r"^\bTool:\b", r"^\bDescription:\b", r"^\bParameters:\b"),
    ),
}


def get_profile(name: str) -> QuenchConfig:
    if name not in PROFILES:
        raise KeyError(f"no profile {name!r}; there are {', '.join(PROFILES)}")
    return PROFILES[name]


def output_config(config: QuenchConfig | None = None) -> QuenchConfig:
    """How a response is cooled: faster, and below 0.6 with the other settings at
    their defaults."""
    if config is None:
        return QuenchConfig(cooling_rate=0.8)
    if config.output_cooling and config.cooling_rate < 0.6:
        return QuenchConfig(
            temperature_initial=config.temperature_initial, cooling_rate=0.6, similarity_threshold=config.similarity_threshold,
            frozen_patterns=config.frozen_patterns, energy_weights=config.energy_weights,
        )
    return config
