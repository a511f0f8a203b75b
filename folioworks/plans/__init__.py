"""Registered queries."""

from __future__ import annotations

from importlib import import_module
from types import ModuleType

_MODULES = ("records", "documents", "sequences", "entities", "identity", "alignment", "memos")


def load_all() -> ModuleType:
    for m in _MODULES:
        import_module(f"folioworks.plans.{m}")
    return import_module("folioworks.plans.registry")
