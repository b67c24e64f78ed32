"""Configuration: a TOML file with defaults for everything absent."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path
from typing import Any


@dataclass
class Index:
    languages: list[str] = field(default_factory=list)
    extra_ignore_dirs: list[str] = field(default_factory=list)
    ignore_globs: list[str] = field(default_factory=list)


@dataclass
class Intelligence:
    enabled: bool = True
    call_graph: bool = True
    focus_radius: int = 2
    change_impact_high_ref_threshold: int = 10


@dataclass
class Risk:
    enabled: bool = True
    w_dependents: float = 0.15
    w_fan_in: float = 0.2
    w_churn: float = 0.1
    w_bugfix: float = 0.25
    w_complexity: float = 0.05
    w_test_gap: float = 0.2
    bias: float = -2.0


@dataclass
class Security:
    enabled: bool = False
    mode: str = "balanced"
    block_on_unknown: bool = False
    cwes: list[str] = field(default_factory=lambda: ["190", "131", "191", "369", "680"])
    prove: bool = False


@dataclass
class Locks:
    ttl_secs: int = 600
    await_timeout_secs: int = 30
    allowed: list[str] = field(default_factory=list)


@dataclass
class Loop:
    reindex: str = "if_stale"
    reindex_every_n: int = 3
    stale_warn_threshold: int = 5
    max_iterations: int = 50


@dataclass
class Architecture:
    layers: dict[str, list[str]] = field(default_factory=dict)
    deny: list[list[str]] = field(default_factory=list)
    allow: list[list[str]] = field(default_factory=list)


@dataclass
class Config:
    index: Index = field(default_factory=Index)
    intelligence: Intelligence = field(default_factory=Intelligence)
    risk: Risk = field(default_factory=Risk)
    security: Security = field(default_factory=Security)
    locks: Locks = field(default_factory=Locks)
    loop: Loop = field(default_factory=Loop)
    architecture: Architecture = field(default_factory=Architecture)


def _filled(kind: type, values: dict[str, Any]) -> Any:
    made = kind()
    for f in fields(kind):
        if f.name in values:
            now = getattr(made, f.name)
            setattr(made, f.name, _filled(type(now), values[f.name]) if is_dataclass(now) else values[f.name])
    return made


def load(path: str) -> Config:
    """The file's configuration; unknown keys are ignored, and a missing file gives the defaults."""
    at = Path(path)
    return _filled(Config, tomllib.loads(at.read_text())) if at.exists() else Config()


def seconds(text: str) -> int:
    """`90`, `30s`, `5m` or `2h` in seconds."""
    m = re.fullmatch(r"\s*(\d+)\s*([smh]?)\s*", text)
    if not m:
        raise ValueError(f"no interval: {text!r}")
    return int(m[1]) * {"": 1, "s": 1, "m": 60, "h": 3600}[m[2]]
