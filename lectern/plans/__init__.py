"""Registered queries, by subject."""

from __future__ import annotations

import importlib

from lectern.plans.registry import REGISTRY, Query

SUBJECTS = ("coverage", "listings", "assess", "finder", "writes", "catalog", "sets", "logs")


def load_all() -> dict[str, Query]:
    for subject in SUBJECTS:
        importlib.import_module(f"lectern.plans.{subject}")
    return REGISTRY
