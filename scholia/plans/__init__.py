"""Registered queries with their checking SQL."""

from importlib import import_module

MODULES = ["catalogue", "learners", "corpus", "study", "notes", "streams"]


def load() -> None:
    for name in MODULES:
        import_module(f"scholia.plans.{name}")
