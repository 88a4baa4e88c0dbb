"""The parameters of an anonymization run."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import asdict, dataclass, field
from typing import Any


@dataclass(frozen=True)
class Policy:
    """``secret`` keys all noise; keep it, and the noise can be reproduced.

    Noise is drawn once per column and row, each with the full ``epsilon``: the
    budget spent on a row adds up over its noised columns.
    """

    secret: str
    k: int = 5
    l: int = 2
    t: float = 0.2
    epsilon: float = 1.0
    delta: float = 0.01
    pca_threshold: float = 0.85
    population: int = 10000
    use_pca: bool = True
    strict: bool = False  # redact numeric identifiers too
    guarantee: bool = False  # drop the classes that still miss k
    custom_rules: Mapping[str, str] = field(default_factory=dict)  # column to a rule of CUSTOM_RULES, instead of its tier's technique

    def watermark_params(self) -> dict[str, Any]:
        """What a watermark records; never the secret."""
        values = asdict(self)
        return {
            "k_anonymity": values["k"],
            "epsilon": values["epsilon"],
            "pca_threshold": values["pca_threshold"],
            "use_pca": values["use_pca"],
        }
