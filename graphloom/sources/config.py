"""Settings from a .env text."""

from __future__ import annotations

from collections.abc import Mapping, MutableMapping


def env_values(text: str) -> dict[str, str]:
    """KEY=VALUE lines; comments, blanks and lines without an equals sign are passed over, quotes around values dropped."""
    out = {}
    for line in map(str.strip, text.splitlines()):
        key, sep, value = line.partition("=")
        if sep and key.strip() and not line.startswith("#"):
            out[key.strip()] = value.strip().strip('"').strip("'")
    return out


def settle(values: Mapping[str, str], into: MutableMapping[str, str]) -> None:
    """Set what is not yet set."""
    for key, value in values.items():
        into.setdefault(key, value)
