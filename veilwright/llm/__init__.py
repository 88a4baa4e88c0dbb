"""Operators for preparing training text, and their registered queries.

``catalog()`` imports every module that registers a query. Nothing else in the
library imports this subpackage.
"""

from importlib import import_module

MODULES = (
    "secrets",
    "decontaminate",
    "language",
    "neighbours",
    "suffix_levels",
    "repeated_passages",
    "near_copies",
    "mixture",
    "piece_counts",
    "token_files",
    "exact_copies",
    "alignment",
    "phrases",
)


def catalog():
    for module in MODULES:
        import_module(f"{__name__}.{module}")
    return import_module(f"{__name__}.common")
