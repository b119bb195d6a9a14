"""Parameter files: lines ``key: value``, with ``#`` comments; keys and types come from defaults."""

from __future__ import annotations

from typing import Any


def parse(text: str) -> dict[str, str]:
    """Raw pairs; later lines win, keys are compared without regard to case and outer space."""
    out = {}
    for line in text.splitlines():
        line = line.partition("#")[0]
        key, colon, value = line.partition(":")
        if colon and key.strip():
            out[key.strip().lower()] = value.strip()
    return out


def typed(raw: dict[str, str], defaults: dict[str, Any]) -> dict[str, Any]:
    """Defaults with the file's values in the defaults' types; keys without a default are left out, as are empty values."""
    out = dict(defaults)
    for key, default in defaults.items():
        text = raw.get(key.lower())
        if text is None or text == "":
            continue
        if isinstance(default, bool):
            out[key] = text.lower() in ("true", "1", "yes", "t", "y")
        elif isinstance(default, int):
            out[key] = int(float(text))
        elif isinstance(default, float):
            out[key] = float(text)
        elif isinstance(default, (list, tuple)):
            kind = type(default[0]) if default else str
            out[key] = [kind(x.strip()) for x in text.split(",") if x.strip()]
        else:
            out[key] = text
    return out


def help_table(defaults: dict[str, Any]) -> list[tuple[str, str, str]]:
    """Key, type and default of each parameter."""
    return [(k, type(v).__name__, str(v)) for k, v in defaults.items()]
