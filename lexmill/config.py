"""Settings of the corpus stages: presets, files, merge and checks. All of them take effect."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path
from typing import Any


class ConfigError(ValueError):
    """A setting is unknown or out of range; ``key`` names it."""

    def __init__(self, key: str, message: str):
        super().__init__(f"{key}: {message}")
        self.key = key


@dataclass(frozen=True)
class Cleaning:
    urls: bool = True
    emails: bool = True
    phones: bool = True
    min_line: int = 10
    max_line: int = 1000
    dedup: bool = True


@dataclass(frozen=True)
class Dedup:
    similarity: float = 0.85
    chunk_words: int = 512
    algorithm: str = "sha256"


@dataclass(frozen=True)
class Samples:
    block: int = 1024
    stride: int | None = None
    ratios: tuple[float, float, float] = (0.8, 0.1, 0.1)
    seed: int = 42


@dataclass(frozen=True)
class Config:
    cleaning: Cleaning = field(default_factory=Cleaning)
    dedup: Dedup = field(default_factory=Dedup)
    samples: Samples = field(default_factory=Samples)


PRESETS: dict[str, dict[str, Any]] = {
    "default": {},
    "small": {"samples": {"block": 256, "stride": 128}},
    "strict": {"cleaning": {"min_line": 20}, "dedup": {"similarity": 0.8}},
}


def merge(base: dict, over: dict) -> dict:
    """Deep merge; the right side wins."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def build(values: dict[str, Any] | None = None, preset: str = "default") -> Config:
    """A checked configuration from a preset and overrides."""
    if preset not in PRESETS:
        raise ConfigError("preset", f"unknown: {preset}")
    tree = merge(merge(asdict(Config()), PRESETS[preset]), values or {})
    parts = {"cleaning": Cleaning, "dedup": Dedup, "samples": Samples}
    for name, part in tree.items():
        if name not in parts:
            raise ConfigError(name, "unknown section")
        for key in part:
            if key not in {f.name for f in fields(parts[name])}:
                raise ConfigError(f"{name}.{key}", "unknown setting")
    tree["samples"]["ratios"] = tuple(tree["samples"]["ratios"])
    out = Config(**{n: kind(**tree[n]) for n, kind in parts.items()})
    check(out)
    return out


def check(c: Config) -> None:
    """Raise for the first setting out of range."""
    rules = (
        ("cleaning.min_line", c.cleaning.min_line >= 0, "must not be negative"),
        ("cleaning.max_line", c.cleaning.max_line > c.cleaning.min_line, "must exceed min_line"),
        ("dedup.similarity", 0 <= c.dedup.similarity <= 1, "must be from 0 to 1"),
        ("dedup.chunk_words", c.dedup.chunk_words > 0, "must be positive"),
        ("dedup.algorithm", c.dedup.algorithm in ("sha256", "md5"), "must be sha256 or md5"),
        ("samples.block", c.samples.block > 0, "must be positive"),
        ("samples.ratios", len(c.samples.ratios) == 3 and min(c.samples.ratios) >= 0 and abs(sum(c.samples.ratios) - 1) <= 1e-6, "must be three shares that sum to 1"),
    )
    for key, ok, message in rules:
        if not ok:
            raise ConfigError(key, message)


def summary(c: Config) -> dict[str, Any]:
    """What a configuration amounts to, in a few lines: masks that are on, limits, and samples."""
    masks = [name for name in ("urls", "emails", "phones") if getattr(c.cleaning, name)]
    step = c.samples.stride or c.samples.block
    return {
        "masks": masks,
        "line_lengths": [c.cleaning.min_line, c.cleaning.max_line],
        "line_dedup": c.cleaning.dedup,
        "chunk_dedup": f"{c.dedup.chunk_words} words at {c.dedup.similarity:g}",
        "samples": f"{c.samples.block} tokens every {step}",
        "overlap": max(0, 1 - step / c.samples.block),
        "split": dict(zip(("train", "val", "test"), c.samples.ratios, strict=True)),
    }


def _yaml():
    try:
        import yaml
    except ImportError as missing:
        raise ConfigError("file", "YAML files need the yaml package") from missing
    return yaml


def load(path: str, preset: str = "default") -> Config:
    """From a JSON or YAML file on the driver, by its suffix."""
    text = Path(path).read_text(encoding="utf-8")
    values = _yaml().safe_load(text) if path.lower().endswith((".yaml", ".yml")) else json.loads(text)
    if not isinstance(values or {}, dict):
        raise ConfigError("file", "must hold sections")
    return build(values, preset)


def save(config: Config, path: str) -> None:
    """To a JSON or YAML file, by its suffix."""
    tree = json.loads(json.dumps(asdict(config)))
    text = _yaml().safe_dump(tree, sort_keys=False) if path.lower().endswith((".yaml", ".yml")) else json.dumps(tree, indent=2) + "\n"
    Path(path).write_text(text, encoding="utf-8")
