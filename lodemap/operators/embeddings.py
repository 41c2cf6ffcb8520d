"""Vectors of texts from a pluggable provider, in batches, with a checked dimension."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

Provider = Callable[[Sequence[str]], Sequence[Sequence[float]]]
#: Texts of a call and the dimension of the default provider.
BATCH, DIMENSION = 64, 256
KNOWN = 400_000  # words whose places a task remembers

_PROVIDERS: dict[str, Callable[[int], Provider]] = {}


class DimensionMismatch(ValueError):
    """A provider gave another number of vectors or of components than was asked for."""


def register(name: str, factory: Callable[[int], Provider]) -> None:
    """Adds a provider; ``factory`` takes the dimension. Names are compared without case and blanks."""
    _PROVIDERS[name.strip().lower()] = factory


def provider(name: str, dimension: int = DIMENSION) -> Provider:
    key = name.strip().lower()
    if key not in _PROVIDERS:
        raise KeyError(f"no embedding provider is called {name!r}; there are {sorted(_PROVIDERS)}")
    return _PROVIDERS[key](dimension)


class _Places(dict):
    """Where a word counts: twice its component, one more if it counts down."""

    def __init__(self, dimension: int):
        self.dimension = dimension

    def __missing__(self, word: str) -> int:
        if len(self) >= KNOWN:
            self.clear()
        digest = hashlib.md5(word.encode()).hexdigest()
        found = self[word] = 2 * (int(digest[:8], 16) % self.dimension) + (int(digest[8], 16) & 1)
        return found


def feature_hash(dimension: int) -> Provider:
    """Signed counts of a text's words by hash: whole numbers, the same on every machine, needing no model."""
    known = _Places(dimension)

    def vectors(texts: Sequence[str]) -> list[list[float]]:
        out = []
        for text in texts:
            places = [known[w] for w in re.findall(r"[^\W_]+", text.lower())]
            counts = np.bincount(np.array(places, np.int64), minlength=2 * dimension)
            out.append((counts[0::2] - counts[1::2]).astype(float).tolist())
        return out

    return vectors


register("feature-hash", feature_hash)


def checked(vectors: Sequence[Sequence[float]], texts: int, dimension: int) -> Sequence[Sequence[float]]:
    if len(vectors) != texts:
        raise DimensionMismatch(f"{len(vectors)} vectors for {texts} texts")
    for v in vectors:
        if len(v) != dimension:
            raise DimensionMismatch(f"expected {dimension} components, got {len(v)}")
    return vectors


def embedded(chunks: DataFrame, name: str = "feature-hash", dimension: int = DIMENSION, batch: int = BATCH, text_col: str = "text", out_col: str = "embedding") -> DataFrame:
    """``chunks`` with a vector of each text: a task calls the provider for ``batch`` texts at a time. Null texts are empty ones."""
    made, place = provider(name, dimension), chunks.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for start in range(0, rows.num_rows, batch):
                part = rows.slice(start, batch)
                texts = [t or "" for t in part.column(place).to_pylist()]
                flat = pa.array([float(x) for v in checked(made(texts), len(texts), dimension) for x in v], pa.float32())
                found = pa.ListArray.from_arrays(pa.array(range(0, len(flat) + 1, dimension), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([*part.columns, found], [*part.schema.names, out_col])

    return chunks.mapInArrow(run, StructType([*chunks.schema, StructField(out_col, ArrayType(FloatType()))]))


def embedded_query(question: str, name: str = "feature-hash", dimension: int = DIMENSION) -> list[float]:
    return [float(x) for x in checked(provider(name, dimension)([question]), 1, dimension)[0]]
