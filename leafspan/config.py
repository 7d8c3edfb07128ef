"""Settings as one value: read from a JSON file, overridden by path, described row by row. Nothing is global: a configuration is passed on."""

from __future__ import annotations

import json
import pathlib
from dataclasses import dataclass, field, fields, is_dataclass, replace

from leafspan.operators.harmonize import Config as Harmonize
from leafspan.operators.layout import Config as Layout
from leafspan.operators.sanitize import Config as Sanitize


@dataclass(frozen=True)
class Settings:
    harmonize: Harmonize = field(default_factory=Harmonize)
    sanitize: Sanitize = field(default_factory=Sanitize)
    layout: Layout = field(default_factory=Layout)


def override(settings, values: dict):
    """``settings`` with ``values`` put in, nested as they are; names that there are not raise a ValueError, null leaves what there is."""
    known = {f.name for f in fields(settings)}
    if unknown := set(values) - known:
        raise ValueError(f"no such setting: {', '.join(sorted(unknown))}")
    changed = {}
    for name, v in values.items():
        own = getattr(settings, name)
        if v is None:
            continue
        if is_dataclass(own):
            changed[name] = override(own, v)
        elif isinstance(own, dict) and all(map(is_dataclass, own.values())):
            if unknown := set(v) - set(own):
                raise ValueError(f"no such setting: {', '.join(sorted(unknown))}")
            changed[name] = own | {k: override(own[k], x) for k, x in v.items()}
        else:
            changed[name] = tuple(v) if isinstance(own, tuple) else type(own)(v) if own is not None else v
    return replace(settings, **changed)


def load(path: str | None = None, overrides: dict | None = None) -> Settings:
    """The defaults with what a JSON file says, if there is one, and with ``overrides`` put in last."""
    settings = Settings()
    if path is not None and pathlib.Path(path).is_file():
        settings = override(settings, json.loads(pathlib.Path(path).read_text(encoding="utf-8")))
    return override(settings, overrides or {})


def describe(settings: Settings | None = None, prefix: str = "") -> list[tuple[str, str, str, str]]:
    """(path, kind, default, value) of every setting, for a form; settings without an argument are the defaults, which resets them."""
    return _rows(settings or Settings(), Settings(), "")


def _rows(own, default, prefix: str) -> list[tuple[str, str, str, str]]:
    if is_dataclass(own):
        return [r for f in fields(own) for r in _rows(getattr(own, f.name), getattr(default, f.name), f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(own, dict):
        return [r for k in own for r in _rows(own[k], default[k], f"{prefix}.{k}")]
    return [(prefix, type(own).__name__, str(default), str(own))]
