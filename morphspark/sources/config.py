"""Configuration: which dictionary, which plug-ins with which settings, and where files are looked for."""

from __future__ import annotations

import json
import os
import sys
from dataclasses import asdict, dataclass, field, replace
from typing import Any

PROJECTIONS = ("surface", "normalized", "reading", "dictionary", "dictionary_and_surface", "normalized_and_surface", "normalized_nouns")
EDITIONS = ("small", "core", "full")
_ALIASES = {"systemDict": "system", "userDict": "user", "characterDefinitionFile": "characters", "connectionCostPlugin": "connection", "inputTextPlugin": "normalizers", "oovProviderPlugin": "unknown", "pathRewritePlugin": "rewriters"}


class ConfigError(ValueError):
    """A setting that makes no sense, or a file that isn't there."""


@dataclass(frozen=True)
class Config:
    """Settings. Lists of plug-ins hold {"class": name, ...}, run in that order."""

    path: str | None = None
    system: str | None = None
    user: tuple[str, ...] = ()
    characters: str | None = None
    connection: tuple[dict[str, Any], ...] = ()
    normalizers: tuple[dict[str, Any], ...] = ()
    unknown: tuple[dict[str, Any], ...] = ()
    rewriters: tuple[dict[str, Any], ...] = ()
    projection: str = "surface"
    root: str | None = field(default=None, compare=False)
    resources: str | None = field(default=None, compare=False)

    @classmethod
    def of(cls, source: Config | dict | str | None) -> Config:
        """From a Config, a dict, JSON text or the path of a JSON file."""
        if source is None:
            return cls()
        if isinstance(source, Config):
            return source
        root = None
        if isinstance(source, str):
            if not source.lstrip().startswith("{"):
                if not os.path.exists(source):
                    raise ConfigError(f"no such configuration: {source}")
                root = os.path.dirname(os.path.abspath(source))
                with open(source, encoding="utf-8") as f:
                    source = f.read()
            try:
                source = json.loads(source)
            except ValueError as e:
                raise ConfigError(f"not JSON: {e}") from e
        got = {}
        for k, v in source.items():
            k = _ALIASES.get(k, k)
            if k not in cls.__dataclass_fields__:
                raise ConfigError(f"no such setting: {k}")
            got[k] = ((v,) if isinstance(v, (str, dict)) else tuple(v)) if k in ("user", "connection", "normalizers", "unknown", "rewriters") else v
        if got.get("projection", "surface") not in PROJECTIONS:
            raise ConfigError(f"no such projection: {got['projection']}")
        return cls(**({"root": root} | got))

    def over(self, base: Config) -> Config:
        """These settings, and those of the base where these are empty."""
        return replace(base, **{k: v for k in self.__dataclass_fields__ if (v := getattr(self, k)) and not (k == "projection" and v == "surface")})

    def update(self, **changes: Any) -> Config:
        return replace(self, **changes)

    def as_json(self) -> str:
        return json.dumps({k: v for k, v in asdict(self).items() if v and k not in ("root", "resources")}, ensure_ascii=False)

    def find(self, name: str, resources: str | None = None) -> str:
        """The file of that name: as it is if absolute, else under path, the resource folder, the configuration's folder or the working folder. $cfg stands for the configuration's folder, $exe for that of the program."""
        if name.startswith("$cfg/"):
            return os.path.join(self.root or ".", name[5:])
        if name.startswith("$exe/"):
            return os.path.join(os.path.dirname(os.path.abspath(sys.argv[0] or ".")), name[5:])
        if os.path.isabs(name) or "://" in name:
            return name
        for folder in (self.path, resources, self.root, "."):
            if folder and os.path.exists(p := os.path.join(folder, name)):
                return p
        raise ConfigError(f"can't find {name}")


_EDITIONS: dict[str, str] = {}


def _register() -> str:
    """The file that keeps the editions of this user: one line of JSON."""
    return os.path.join(os.environ.get("XDG_CONFIG_HOME") or os.path.expanduser("~/.config"), "morphspark", "editions.json")


def _kept() -> dict[str, str]:
    try:
        with open(_register(), encoding="utf-8") as f:
            return json.load(f)
    except (FileNotFoundError, ValueError):
        return {}


def register_edition(name: str, folder: str, keep: bool = False) -> None:
    """Names the folder of a dictionary, as small, core or full; keep: for later processes too."""
    _EDITIONS[name] = folder
    if keep:
        every = _kept() | {name: folder}
        os.makedirs(os.path.dirname(_register()), exist_ok=True)
        with open(_register(), "w", encoding="utf-8") as f:
            json.dump(every, f)


def edition(name: str = "core") -> str:
    """The folder of a named dictionary."""
    every = _kept() | _EDITIONS
    if name not in every:
        raise ConfigError(f"no dictionary is registered as {name}; known: {', '.join(sorted(every)) or 'none'}")
    return every[name]
