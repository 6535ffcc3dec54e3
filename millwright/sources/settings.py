"""Settings from a file of NAME=value lines and the environment, which wins. Two underscores lead into a group: ``INPUT__CSV_FILENAME``."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path


@dataclass(frozen=True)
class Input:
    csv_filename: str = ""
    id_col: str = "id"
    type_col: str = "type"
    text_col: str = "text"
    floc_col: str = "floc"
    start_date_col: str | None = None
    cost_col: str | None = None
    time_col: str | None = None
    unplanned_codes: tuple[str, ...] = ()
    planned_codes: tuple[str, ...] = ()
    date_format: str = "%d/%m/%Y"


@dataclass(frozen=True)
class Processing:
    remove_subsumption: bool = False
    remove_rare_outliers: bool = True
    site_codes: tuple[str, ...] = ()
    limit: int | None = None
    systems: tuple[str, ...] = ()
    unplanned_only: bool = False
    add_dummy_cols: bool = False


@dataclass(frozen=True)
class Folders:
    root: str = "."
    cache: str = "cache"
    input: str = "input"
    output: str = "output"

    def path(self, name: str) -> str:
        """A folder of the four, below the root unless it is absolute or has a scheme."""
        own = getattr(self, name)
        return own if name == "root" or own.startswith("/") or "://" in own else f"{self.root.rstrip('/')}/{own}"


@dataclass(frozen=True)
class Settings:
    input: Input = field(default_factory=Input)
    processing: Processing = field(default_factory=Processing)
    folders: Folders = field(default_factory=Folders)


def parsed(lines: str) -> dict[str, str]:
    """NAME=value lines; empty ones and comments are left out, quotes around values are taken off."""
    pairs = (x.split("=", 1) for x in map(str.strip, lines.splitlines()) if x and not x.startswith("#") and "=" in x)
    return {k.strip().removeprefix("export ").strip(): v.strip().strip("'\"") for k, v in pairs}


def _value(kind: str, raw: str, name: str):
    if kind.startswith("bool"):
        if raw.lower() not in ("true", "1", "yes", "on", "false", "0", "no", "off", ""):
            raise ValueError(f"{name}: {raw!r} is neither true nor false")
        return raw.lower() in ("true", "1", "yes", "on")
    if kind.startswith("int"):
        return int(raw) if raw else None
    if kind.startswith("tuple"):
        return tuple(x.strip() for x in raw.strip("[]").replace('"', "").split(",") if x.strip())
    return raw or (None if "None" in kind else "")


def _made(cls, values: Mapping[str, str], prefix: str):
    own = {}
    for f in fields(cls):
        name = f"{prefix}{f.name}".lower()
        if f.default_factory is not None and is_dataclass(f.default_factory):
            own[f.name] = _made(f.default_factory, values, f"{name}__")
        elif name in values:
            own[f.name] = _value(str(f.type), values[name], name)
    return cls(**own)


def load(file: str | None = None, environment: Mapping[str, str] | None = None) -> Settings:
    """The settings; what neither the file nor the environment names has its default."""
    lines = Path(file).read_text() if file and Path(file).exists() else ""
    values = parsed(lines) | dict(os.environ if environment is None else environment)
    return _made(Settings, {k.lower(): v for k, v in values.items()}, "")
