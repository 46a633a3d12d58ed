"""Models at the boundary: protocols, deterministic defaults, retries.

A provider maps a list of inputs to as many outputs and is called with whole batches
inside ``mapInArrow``; results are cached by key in tables (``annotate``, ``embed``), so a
retried task asks again for its own batch only.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normalise import annotation


class Embedder(Protocol):
    model: str

    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class TextModel(Protocol):
    version: str

    def __call__(self, prompts: list[str]) -> list[str]: ...


class HashEmbedder:
    """Signed feature hashing of words, normed: alike for alike texts, and the same everywhere."""

    def __init__(self, size: int = 64):
        self.size, self.model = size, f"hash-{size}"

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.size))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, h % self.size] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm > 0, norm, 1)).tolist()


class RuleAnnotator:
    """First sentence as a summary, frequent long words as keywords."""

    version = "rules-1"

    def __call__(self, prompts: list[str]) -> list[str]:
        out = []
        for t in prompts:
            words = [w.strip(".,;:!?#|`").lower() for w in t.split()]
            top = sorted({w for w in words if len(w) > 3}, key=lambda w: (-words.count(w), w))[:6]
            kind = "code" if "```" in t else "table" if "|" in t else "text"
            out.append(json.dumps({"summary": t.strip("# \n").split("\n")[0][:50], "keywords": top, "tags": top[:2], "type": kind, "has_code": "```" in t, "coherence": "medium", "dependency_topics": []}, ensure_ascii=False))
        return out


class EmptyGraph:
    """No dependencies, but every chunk covered. A prompt is JSON with a list of ``nodes``, each with its ``node_id``."""

    version = "none-1"

    def __call__(self, prompts: list[str]) -> list[str]:
        return [json.dumps({"node_dependencies": {n["node_id"]: [] for n in json.loads(p)["nodes"]}}) for p in prompts]


#: Makers of embedders by the prefix of a model's name; ``register`` adds to them.
EMBEDDERS: dict[str, Callable[[str], Embedder]] = {"hash": lambda name: HashEmbedder(int(name.partition("-")[2] or 64))}
#: Makers of text models by kind (annotator, grapher, rewriter, reranker, router, answerer), given a key.
TEXT_MODELS: dict[str, Callable[[str], TextModel]] = {}


def register(kind: str, make: Callable[[str], object]) -> None:
    """A kind of ``TEXT_MODELS``, or the prefix of an embedder's names as ``embedder:<prefix>``."""
    if kind.startswith("embedder:"):
        EMBEDDERS[kind.partition(":")[2]] = make  # type: ignore[assignment]
    else:
        TEXT_MODELS[kind] = make  # type: ignore[assignment]


def embedder(name: str) -> Embedder:
    """The embedder of a model's name, which the index's manifest keeps; raises for a name that nothing makes."""
    make = EMBEDDERS.get(name.partition("-")[0])
    if make is None:
        raise ValueError(f"no provider makes embeddings by {name}")
    return make(name)


def text_model(kind: str, key: str | None, needed: bool = False) -> TextModel | None:
    """A text model of a kind. Without a key or a maker there is none: an optional step is then left out, a needed one raises."""
    if key and kind in TEXT_MODELS:
        return TEXT_MODELS[kind](key)
    if needed:
        raise ValueError(f"{kind} needs a provider and its key")
    return None


def retrying(model: Callable[[list], list], tries: int = 3, pause: Callable[[float], None] = time.sleep) -> Callable[[list], list]:
    """Calls again after 1, 2, 4 ... seconds; the last failure is raised."""

    def call(batch: list) -> list:
        for n in range(tries):
            try:
                out = model(batch)
                if len(out) != len(batch):
                    raise ValueError(f"{len(out)} results for {len(batch)} inputs")
                return out
            except Exception:
                if n == tries - 1:
                    raise
                pause(2.0**n)
        return []

    return call


def embed(rows: DataFrame, embedder: Embedder, route: str, batch: int = 20) -> DataFrame:
    """``route, node_id, embedding, embedding_model`` of ``rows(node_id, text)``; an empty text has an empty vector."""
    if batch < 1:
        raise ValueError("a batch holds one text at least")
    model = embedder.model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = retrying(embedder)
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            vectors: list[list[float]] = [[] for _ in texts]
            some = [i for i, t in enumerate(texts) if t]
            for a in range(0, len(some), batch):
                part = some[a : a + batch]
                for i, v in zip(part, call([texts[i] for i in part]), strict=True):
                    vectors[i] = v
            yield pa.RecordBatch.from_arrays([pa.array([route] * len(texts)), b.column("node_id"), pa.array(vectors, pa.list_(pa.float32())), pa.array([model] * len(texts))], names=["route", "node_id", "embedding", "embedding_model"])

    return rows.select(F.col("node_id").cast("string").alias("node_id"), "text").mapInArrow(run, "route string, node_id string, embedding array<float>, embedding_model string")


def ask(rows: DataFrame, model: TextModel, key: str, prompt: str, batch: int = 10) -> DataFrame:
    """``key, raw`` of a text model; a batch that keeps failing yields null, for the caller to count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = retrying(model)
        for b in batches:
            prompts, raw = b.column("p").to_pylist(), []
            for a in range(0, len(prompts), batch):
                part = [p or "" for p in prompts[a : a + batch]]
                try:
                    raw += call(part)
                except Exception:  # noqa: BLE001  (any failure of a provider is data here)
                    raw += [None] * len(part)
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(raw, pa.string())], names=["k", "raw"])

    return rows.select(F.col(key).cast("string").alias("k"), F.col(prompt).alias("p")).mapInArrow(run, "k string, raw string").withColumnRenamed("k", key)


def annotate(chunks: DataFrame, model: TextModel, cache: DataFrame | None = None, keep: Callable[[str, DataFrame], DataFrame] = lambda name, df: df) -> tuple[DataFrame, DataFrame]:
    """Chunks with annotation columns, and the new cache rows (``text_hash, version, raw``). Cached texts aren't asked again.

    Both results need the model's answers: ``keep`` may write them, so that they are asked for once.
    """
    keyed = chunks.withColumn("text_hash", F.sha2("text", 256))
    pending = keyed.select("text_hash", "text").dropDuplicates(["text_hash"])
    known = cache.where(F.col("version") == model.version).where("raw is not null").select("text_hash", "raw") if cache is not None else None
    if known is not None:
        pending = pending.join(known, "text_hash", "left_anti")
    fresh = keep("answers", ask(pending, model, "text_hash", "text"))
    both = fresh.unionByName(known) if known is not None else fresh
    noted = keyed.join(both, "text_hash", "left").withColumn("a", annotation(F.col("raw")))
    return noted.select(*chunks.columns, "a.*"), fresh.withColumn("version", F.lit(model.version))
