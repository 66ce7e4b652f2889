"""Engine settings, from JSON or keyword arguments. What Spark decides by itself has no setting here."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields

from .errors import ConfigError


@dataclass(frozen=True)
class StorageSettings:
    data_dir: str = "./data"
    in_memory: bool = False


@dataclass(frozen=True)
class QuerySettings:
    #: "total": NULL is the greatest value and equals itself; "ansi": SQL's three-valued logic.
    semantics: str = "total"
    default_limit: int = 1000
    max_limit: int = 100_000


@dataclass(frozen=True)
class ShellSettings:
    prompt: str = "lithograin> "
    history_file: str = ".lithograin_history"
    max_history_size: int = 1000


@dataclass(frozen=True)
class Settings:
    storage: StorageSettings = field(default_factory=StorageSettings)
    query: QuerySettings = field(default_factory=QuerySettings)
    repl: ShellSettings = field(default_factory=ShellSettings)

    def __post_init__(self):
        if not self.storage.data_dir:
            raise ConfigError("data_dir is empty")
        if self.query.semantics not in ("total", "ansi"):
            raise ConfigError(f"semantics must be total or ansi, not {self.query.semantics}")
        if not 0 < self.query.default_limit <= self.query.max_limit:
            raise ConfigError("default_limit must be positive and at most max_limit")

    @classmethod
    def from_dict(cls, raw: dict) -> Settings:
        parts = {"storage": StorageSettings, "query": QuerySettings, "repl": ShellSettings}
        made = {}
        for name, kind in parts.items():
            known = {f.name for f in fields(kind)}
            made[name] = kind(**{k: v for k, v in raw.get(name, {}).items() if k in known})
        return cls(**made)

    @classmethod
    def load(cls, path: str) -> Settings:
        try:
            with open(path) as f:
                return cls.from_dict(json.load(f))
        except (OSError, ValueError) as e:
            raise ConfigError(f"{path}: {e}") from e

    def save(self, path: str) -> None:
        with open(path, "w") as f:
            json.dump(asdict(self), f, indent=2)
