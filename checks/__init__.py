"""Queries over the driver's tables, each with equivalent plain SQL."""

from __future__ import annotations

from importlib import import_module

GROUPS = ("retrieval", "parsing", "upkeep", "rag", "pipeline")


def registered() -> dict:
    found = {}
    for group in GROUPS:
        found.update(import_module(f"checks.{group}").CHECKS)
    return found
