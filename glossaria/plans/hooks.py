"""Hooks of the matching plan: functions on a stage's DataFrame, by priority."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame

STAGES = ("load", "admit", "map", "entries", "index", "fields", "enrich", "dense", "sparse", "fuse", "pool", "score", "decide", "session", "export")
Hook = Callable[[DataFrame], DataFrame | None]
log = logging.getLogger(__name__)


class Stop(Exception):
    """Ends a stage's hooks; what they made so far stands."""


class Hooks:
    """Hooks by stage. A hook gives a DataFrame or None (no change); its errors are logged and it is passed over."""

    def __init__(self):
        self._by: dict[str, list[tuple[int, int, str, Hook]]] = {s: [] for s in STAGES}

    def register(self, stage: str, hook: Hook, priority: int = 100, name: str = "") -> None:
        if stage not in self._by:
            raise ValueError(f"{stage} is no stage")
        self._by[stage].append((priority, len(self._by[stage]), name or getattr(hook, "__name__", "hook"), hook))
        self._by[stage].sort(key=lambda h: h[:2])

    def run(self, stage: str, df: DataFrame) -> DataFrame:
        for _, _, name, hook in self._by[stage]:
            try:
                out = hook(df)
            except Stop:
                break
            except Exception:
                log.exception("hook %s of %s failed", name, stage)
                continue
            df = df if out is None else out
        return df


class Registry:
    """Named plug-ins of one kind (encoders, parsers, rerankers)."""

    def __init__(self, kind: str, known: dict | None = None):
        self.kind, self._known = kind, dict(known or {})

    def add(self, name: str, item) -> None:
        if name in self._known:
            raise ValueError(f"there is a {self.kind} {name} already")
        self._known[name] = item

    def get(self, name: str):
        if name not in self._known:
            raise ValueError(f"no {self.kind} {name}; there are {', '.join(sorted(self._known))}")
        return self._known[name]

    def load_entry_points(self, group: str) -> list[str]:
        """Add what installed packages offer under ``group``."""
        from importlib.metadata import entry_points

        found = [e for e in entry_points(group=group) if e.name not in self._known]
        for e in found:
            self.add(e.name, e.load())
        return [e.name for e in found]
