"""Pluggable backends and their configuration.

A backend is a Python callable over pandas Series.  Each component (generation,
embedding, rerank, parser) has named providers; offline defaults are registered
by ``larkspur.functions.backends``.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any


class Registry:
    def __init__(self) -> None:
        self._known: dict[tuple[str, str], Callable[..., Any]] = {}

    def register(self, component: str, provider: str, backend: Callable[..., Any]) -> None:
        self._known[component, provider] = backend

    def get(self, component: str, provider: str) -> Callable[..., Any]:
        if (component, provider) not in self._known:
            known = sorted(p for c, p in self._known if c == component)
            raise ValueError(f"no {component} backend named {provider!r}; known: {known}")
        return self._known[component, provider]


backends = Registry()


@dataclass(frozen=True)
class Choice:
    provider: str
    model: str = ""


@dataclass(frozen=True)
class Config:
    """Chosen backends; ``LARKSPUR_<COMPONENT>_PROVIDER`` and ``_MODEL`` override one part each."""

    generation: Choice = field(default_factory=lambda: Choice("extractive"))
    embedding: Choice = field(default_factory=lambda: Choice("hashing"))
    rerank: Choice = field(default_factory=lambda: Choice("overlap"))

    @classmethod
    def load(cls, path: str | None = None, env: dict[str, str] | None = None) -> "Config":
        env = dict(os.environ) if env is None else env
        path = path or env.get("LARKSPUR_CONFIG")
        given: dict[str, dict[str, str]] = {}
        if path:
            import yaml

            with open(path, encoding="utf-8") as f:
                given = yaml.safe_load(f) or {}
        config = cls()
        for name in ("generation", "embedding", "rerank"):
            choice = replace(getattr(config, name), **given.get(name, {}))
            for part in ("provider", "model"):
                if value := env.get(f"LARKSPUR_{name}_{part}".upper()):
                    choice = replace(choice, **{part: value})
            config = replace(config, **{name: choice})
        return config
