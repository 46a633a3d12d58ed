"""Parameters, with the defaults that environment loading gives."""

from __future__ import annotations

import hashlib
import os
from dataclasses import dataclass, fields
from typing import TypeVar

T = TypeVar("T")


def flag(name: str, default: bool) -> bool:
    """Only 1, true, yes and on are true; any other value that is set is false."""
    raw = os.environ.get(name)
    return default if raw is None else raw.strip().lower() in {"1", "true", "yes", "on"}


@dataclass(frozen=True)
class IndexConfig:
    chunk_size: int = 512
    chunk_overlap: int = 100
    annotation_version: str = "annotation_v4"
    dependency_version: str = "dependency_graph_v4"
    embedding_model: str = "hash-64"
    dependency_vectors: bool = False
    workers: int = 10


@dataclass(frozen=True)
class QueryConfig:
    content_top_k: int = 8
    summary_top_k: int = 6
    bm25_top_k: int = 8
    rewrite_content_top_k: int = 4
    rewrite_summary_top_k: int = 3
    rewrite_bm25_top_k: int = 4
    rewrite_limit: int = 3
    neighbour_radius: int = 1
    neighbour_centres: int = 5
    seed_score_ratio: float = 0.6
    max_seeds: int = 10
    capability_weight: float = 0.3
    min_confidence: float = 0.7
    edges_per_seed: int = 5
    dependency_total: int = 16
    max_forced: int = 15
    llm_top_n: int = 10
    final_top_n: int = 8
    context_chars: int = 1200


def from_env(kind: type[T], prefix: str = "TESSELLUM_") -> T:
    """A config whose fields may be set by upper-case variables with ``prefix``."""
    values = {}
    for f in fields(kind):  # type: ignore[arg-type]
        name = prefix + f.name.upper()
        if name in os.environ:
            default = f.default
            values[f.name] = flag(name, bool(default)) if isinstance(default, bool) else type(default)(os.environ[name].strip())
    return kind(**values)


def prompt(path: str | None, default: str) -> tuple[str, str]:
    """A prompt's text, from a file on the driver where there is one, and its hash, which belongs into the manifest and the keys of caches."""
    text = default
    if path and os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            text = f.read()
    return text, hashlib.sha256(text.encode()).hexdigest()
