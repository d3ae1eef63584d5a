"""Parameters of the tests and of the verification."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Thresholds:
    """Defaults of all operators."""

    significance: float = 0.05
    highly_significant: float = 0.01
    weak: float = 0.2
    moderate: float = 0.5
    strong: float = 0.8
    fuzzy: float = 85.0
    relative_error: float = 0.1
    sample_size_error: float = 5.0


DEFAULTS = Thresholds()
