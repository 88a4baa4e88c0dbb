"""The queries this repository offers, by area, with their SQL equivalents."""

from importlib import import_module

AREAS = ("profiling", "privacy", "transforms", "quality", "provenance")


def load():
    """Import every area; returns the registry."""
    for area in AREAS:
        import_module(f"catalog.{area}")
    return import_module("catalog.registry")
