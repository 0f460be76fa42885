"""Configuration: three TOML tables with known keys, types and ranges."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass

from tidemark.sources.feeds import REGISTRY


class ConfigurationError(ValueError):
    pass


@dataclass(frozen=True)
class SourceSettings:
    enabled: bool
    interval_seconds: int
    api_key: str | None = None
    configured: bool = True


@dataclass(frozen=True)
class Settings:
    path: str
    news_days: int
    change_days: int
    snapshot_days: int
    retention_seconds: int
    calendar_seconds: int
    sources: dict[str, SourceSettings]


def _table(parent: Mapping, key: str, where: str, allowed: set[str]) -> Mapping:
    value = parent.get(key)
    if not isinstance(value, Mapping):
        raise ConfigurationError(f"{where} must be a TOML table")
    if unknown := sorted(set(value) - allowed):
        raise ConfigurationError(f"{where} has no setting named {unknown[0]}")
    return value


def _whole(table: Mapping, key: str, where: str, low: int, high: int) -> int:
    value = table.get(key)
    if isinstance(value, bool) or not isinstance(value, int) or not low <= value <= high:
        raise ConfigurationError(f"{where}.{key} takes a whole number, {low} at least and {high} at most")
    return value


def load_settings(path: str, environ: Mapping[str, str] | None = None) -> Settings:
    """The settings in a file; keys of sources come from the environment. The sources must be the known ones."""
    environ = os.environ if environ is None else environ
    try:
        with open(path, "rb") as f:
            root = tomllib.load(f)
    except tomllib.TOMLDecodeError as e:
        raise ConfigurationError(f"not TOML: {e}") from e
    if unknown := sorted(set(root) - {"storage", "calendar", "sources"}):
        raise ConfigurationError(f"there is no section named {unknown[0]}")
    storage = _table(root, "storage", "storage", {"database_path", "news_retention_days", "change_retention_days", "calendar_snapshot_retention_days", "retention_interval_seconds"})
    calendar = _table(root, "calendar", "calendar", {"interval_seconds"})
    sources = _table(root, "sources", "sources", set(REGISTRY))
    if missing := sorted(set(REGISTRY) - set(sources)):
        raise ConfigurationError(f"missing source: {missing[0]}")
    place = storage.get("database_path")
    if not isinstance(place, str) or not place.strip():
        raise ConfigurationError("storage.database_path must be non-empty text")
    found = {}
    for name in REGISTRY:
        where = f"sources.{name}"
        own = _table(sources, name, where, {"enabled", "interval_seconds", "api_key_env"})
        if not isinstance(own.get("enabled"), bool):
            raise ConfigurationError(f"{where}.enabled must be true or false")
        key = environ.get(own["api_key_env"], "").strip() or None if isinstance(own.get("api_key_env"), str) else None
        found[name] = SourceSettings(own["enabled"], _whole(own, "interval_seconds", where, 60, 604_800), key, key is not None or not REGISTRY[name].needs_key)
    days = lambda key, low: _whole(storage, key, "storage", low, 36_500)
    return Settings(place.strip(), days("news_retention_days", 0), days("change_retention_days", 1), days("calendar_snapshot_retention_days", 1), _whole(storage, "retention_interval_seconds", "storage", 60, 604_800), _whole(calendar, "interval_seconds", "calendar", 60, 604_800), found)
