"""Run parameters, gathered in one value that is passed to functions."""

from __future__ import annotations

from dataclasses import asdict, dataclass

# Field prefixes that make up the event text by default.
DEFAULT_KEEP_PREFIXES = ("processName", "eventName", "syscall", "args", "executable", "returnValue")


@dataclass(frozen=True)
class RunConfig:
    clustering_method: str = "dbscan"
    clustering_alpha: float = 1.0
    clustering_seed: int = 42
    keep_prefixes: tuple[str, ...] | None = DEFAULT_KEEP_PREFIXES
    shuffle: bool = False
    top_n_clusters: int = 10
    ngram_size: int = 2
    bloom_error_rate: float = 0.001
    class_threshold: float = 0.5
    embedding_dim: int = 64
    zero_eps: str = "raise"
    bandwidth_rows: int | None = None

    @staticmethod
    def parse_prefixes(text: str) -> tuple[str, ...]:
        """Comma list to prefixes; empty parts are kept and match every key."""
        return tuple(part.strip() for part in text.split(","))

    def as_dict(self) -> dict:
        return asdict(self)
