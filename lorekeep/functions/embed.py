"""Embedding backends: a deterministic one for tests and offline use, and the interface for others."""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


class Embedder(Protocol):
    """Anything picklable with a number of dimensions and a batch method."""

    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashEmbedder:
    """Unit vectors from a byte hash with one start value for each dimension."""

    # fixed values: offset basis and prime of the 64-bit FNV hash
    BASIS, PRIME = 0xCBF29CE484222325, 0x100000001B3

    def __init__(self, dim: int = 16) -> None:
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        h = np.tile(np.uint64(self.BASIS) + np.arange(self.dim, dtype=np.uint64), (len(texts), 1))
        raw = [t.encode() for t in texts]
        order = sorted(range(len(raw)), key=lambda i: -len(raw[i]))
        n = len(raw)
        for at in range(max(map(len, raw), default=0)):
            while n and len(raw[order[n - 1]]) <= at:
                n -= 1
            rows = order[:n]
            step = (h[rows] ^ np.array([raw[i][at] for i in rows], np.uint64)[:, None]) * np.uint64(self.PRIME)
            h[rows] = step ^ (step >> np.uint64(32))
        v = h.view(np.int64).astype(np.float64) / float(2**63 - 1)
        norm = np.sqrt((v * v).sum(1, keepdims=True))
        return v / np.where(norm > 1e-10, norm, 1)


def embedded(rows: DataFrame, embedder: Embedder, text: str = "content", into: str = "vector") -> DataFrame:
    """Add vectors of a text column; null texts get null."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{into}` array<double>"

    def run(batches):
        for pdf in batches:
            known = pdf[text].notna().to_numpy()
            vectors = iter(embedder.embed(pdf[text][known].tolist()))
            yield pdf.assign(**{into: pd.Series([next(vectors).tolist() if k else None for k in known], index=pdf.index, dtype=object)})

    return rows.mapInPandas(run, schema)


def backfill(rows: DataFrame, embedder: Embedder, text: str = "content", vector: str = "vector") -> DataFrame:
    """Fill null vectors; the others stay as they are and aren't sent to Python."""
    missing = embedded(rows.filter(f"{vector} is null").drop(vector), embedder, text, vector)
    return rows.filter(f"{vector} is not null").unionByName(missing.select(*rows.columns))
