"""Settings: defaults, a file of key=value lines over them, environment variables over both."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    """merge_strategy: size_tiered or leveled. zero_level_bytes * level_ratio ** level bounds a level's bytes.
    held_rows: log rows that a session holds before it appends them to its path."""

    merge_strategy: str = "size_tiered"
    merge_threshold: int = 5
    zero_level_bytes: int = 10 * 1024 * 1024
    level_ratio: int = 10
    read_only: bool = False
    remembered_requests: int = 10_000
    held_rows: int = 1_000

    def __post_init__(self) -> None:
        if self.merge_strategy not in ("size_tiered", "leveled"):
            raise ValueError(f"unknown merge strategy: {self.merge_strategy}")
        for name in ("merge_threshold", "zero_level_bytes", "level_ratio", "remembered_requests", "held_rows"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")

    def level_bytes(self, level: int) -> int:
        return self.zero_level_bytes * self.level_ratio**level


def _value(kind: str, text: str) -> object:
    if kind == "bool":
        if text.lower() not in ("true", "false", "1", "0"):
            raise ValueError(f"neither true nor false: {text}")
        return text.lower() in ("true", "1")
    return int(text) if kind == "int" else text


def load(path: str | None = None, env: Mapping[str, str] | None = None, prefix: str = "KEYFOLD_") -> Settings:
    """The settings of a file (# starts a comment, unknown names are errors) and of variables like KEYFOLD_READ_ONLY."""
    kinds = {f.name: str(f.type) for f in fields(Settings)}
    found: dict[str, str] = {}
    if path is not None:
        with open(path, encoding="utf-8") as lines:
            for line in lines:
                name, is_, text = (x.strip() for x in line.split("#")[0].partition("="))
                if not name:
                    continue
                if not is_ or name not in kinds:
                    raise ValueError(f"no setting: {line.strip()}")
                found[name] = text
    env = os.environ if env is None else env
    found |= {n: env[prefix + n.upper()] for n in kinds if prefix + n.upper() in env}
    return Settings(**{n: _value(kinds[n], text) for n, text in found.items()})
