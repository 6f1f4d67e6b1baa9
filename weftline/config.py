"""Request configuration with its limits."""

from __future__ import annotations

from dataclasses import dataclass

from .errors import ConfigurationError

FULL, SIGNATURES, COMPRESSED, SMART = "full", "signatures", "compressed", "smart"


@dataclass(frozen=True)
class ContextConfig:
    token_budget: int = 80_000
    max_depth: int = 4
    min_score: float = 0.1
    output_mode: str = SMART
    smart_threshold: float = 0.5
    include_tests: bool = True
    include_dynamic: bool = True
    compress_low_score: bool = True
    compression_ratio: float = 0.35
    exclude_patterns: tuple[str, ...] = ("venv", ".venv", "node_modules", "dist", "build", "__pycache__", ".git", "*.egg-info")
    decay: float = 0.7
    graph_weight: float = 0.7
    bm25_weight: float = 0.3

    def __post_init__(self) -> None:
        for ok, what in (
            (self.token_budget >= 100, "token_budget is at least 100"),
            (1 <= self.max_depth <= 10, "max_depth is from 1 to 10"),
            (0 <= self.min_score <= 1, "min_score is from 0 to 1"),
            (0 <= self.smart_threshold <= 1, "smart_threshold is from 0 to 1"),
            (0.1 <= self.compression_ratio <= 1, "compression_ratio is from 0.1 to 1"),
            (self.output_mode in (FULL, SIGNATURES, COMPRESSED, SMART), "output_mode is full, signatures, compressed or smart"),
        ):
            if not ok:
                raise ConfigurationError(what)
