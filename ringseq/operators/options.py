"""Options of the operators, checked before any plan is made."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Literal

from ringseq.functions.kernels import Monomerizer


@dataclass(frozen=True)
class MonomerizeOptions:
    seed_length: int = 10
    max_mismatch: int | None = None
    min_identity: float | None = None
    min_overlap: int | None = None
    min_overlap_percent: float | None = None
    min_length: int = 0
    max_length: int | None = None
    keep_all: bool = False
    sensitive: bool = False

    def kernel(self) -> Monomerizer:
        return Monomerizer(self.seed_length, self.max_mismatch, self.min_identity)

    def __post_init__(self) -> None:
        self.kernel()
        for name in ("min_overlap", "min_length", "max_length"):
            if (getattr(self, name) or 0) < 0:
                raise ValueError(f"{name} must not be negative")


@dataclass(frozen=True)
class OrfOptions:
    min_length: int = 75
    start_codons: tuple[str, ...] = ("ATG",)
    stop_codons: tuple[str, ...] = ("TAA", "TAG", "TGA")
    include_stop: bool = False
    no_stop_required: bool = False
    min_wraps: int = 0
    max_wraps: int = 3
    strand: Literal["forward", "reverse", "both"] = "both"
    min_ratio: float = 0.0
    reference_compat: bool = False

    def __post_init__(self) -> None:
        for name in ("start_codons", "stop_codons"):
            value = getattr(self, name)
            object.__setattr__(self, name, tuple(value.split(",") if isinstance(value, str) else value))
        if self.strand not in ("forward", "reverse", "both"):
            raise ValueError("strand must be forward, reverse or both")
        if self.min_length < 0 or self.min_wraps < 0 or self.max_wraps < 0:
            raise ValueError("min_length, min_wraps and max_wraps must not be negative")


def rotation(bases: int | None, percent: float | None) -> None:
    if (bases is None) == (percent is None):
        raise ValueError("give either bases or percent")
    if not (bases if bases is not None else percent):
        raise ValueError("a rotation by 0 does nothing")
