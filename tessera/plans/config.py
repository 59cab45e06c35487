"""Run settings: YAML, presets, dotted overrides, and their precedence."""

from __future__ import annotations

from typing import Any

import yaml


def parsed(value: str) -> Any:
    return yaml.safe_load(value)


def with_overrides(config: dict, overrides: list[str]) -> dict:
    """config with ``a.b=value`` put in; values are read as YAML."""
    out = yaml.safe_load(yaml.safe_dump(config))
    for said in overrides:
        name, sep, value = said.partition("=")
        if not sep:
            raise ValueError(f"{said!r} is no key=value")
        at = out
        *path, last = name.split(".")
        for part in path:
            at = at.setdefault(part, {})
        at[last] = parsed(value)
    return out


def expanded(config: dict, presets: dict[str, dict]) -> dict:
    """config over the preset that it names; what config says itself wins."""
    name = config.get("preset")
    if name is None:
        return config
    if name not in presets:
        raise ValueError(f"no preset {name!r}")
    return {**presets[name], **{k: v for k, v in config.items() if k != "preset"}}


def resolved(defaults: dict, from_file: dict, from_line: dict) -> dict:
    """Defaults, then the file, then the command line; unknown keys of either are errors, strings take the type of the default."""
    if unknown := sorted({*from_file, *from_line} - set(defaults)):
        raise ValueError(f"unknown keys: {unknown}")
    given = {**from_file, **from_line}
    return {k: _like(v, given[k]) if k in given else v for k, v in defaults.items()}


def _like(default: Any, value: Any) -> Any:
    """value as the type of the default, where it is said as text or as a whole number."""
    if isinstance(default, bool):
        return parsed(value) if isinstance(value, str) else value
    if isinstance(value, str) and isinstance(default, (int, float)) or isinstance(default, float) and isinstance(value, int) and not isinstance(value, bool):
        return type(default)(value)
    return value


def snapshot(config: dict) -> str:
    return yaml.safe_dump({k: v for k, v in config.items() if k != "config"}, sort_keys=True)
