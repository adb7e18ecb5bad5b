"""How plugins are named: tables of plugins are plain dicts, and a name is spelled in one way."""

from __future__ import annotations

from typing import Any


def plugin_name(name: str) -> str:
    return name.strip().lower().replace("-", "_")


def register(table: dict[str, Any], name: str, plugin: Any) -> None:
    """Adds a plugin under a name that none has yet."""
    key = plugin_name(name)
    if key in table or not key:
        raise ValueError(f"{name!r} is empty or taken")
    table[key] = plugin


def find(table: dict[str, Any], kind: str, name: str) -> Any:
    found = plugin_name(name)
    if found not in table:
        raise ValueError(f"unknown {kind}: {name} (there are {', '.join(sorted(table))})")
    return table[found]
