"""Replaceable models: what an engine without a network uses in their place, deterministic."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T


class Embedder(Protocol):
    def embed_many(self, texts: list[str]) -> list[list[float]]: ...


class Answerer(Protocol):
    def answer(self, question: str, context: str) -> str: ...


class Rewriter(Protocol):
    def rewrite(self, question: str, mode: str) -> str: ...


class HashedWords:
    """Bags of hashed words, of length 1."""

    def __init__(self, size: int = 64):
        self.size = size

    def embed_many(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.size))
        for row, text in zip(out, texts, strict=True):
            for w in re.findall(r"[a-z0-9]+", (text or "").lower()):
                h = xxhash.xxh64_intdigest(w)
                row[h % self.size] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0).tolist()


class Extractive:
    """Answers with the sentence of the context that shares most words with the question."""

    NOTHING = "The retrieved filings do not contain the answer."

    def answer(self, question: str, context: str) -> str:
        asked = set(re.findall(r"[a-z0-9]+", question.lower()))
        sentences = [s for s in re.split(r"(?<=[.!?])\s+", context) if s.strip()]
        if not sentences:
            return self.NOTHING
        return max(sentences, key=lambda s: len(asked & set(re.findall(r"[a-z0-9]+", s.lower()))))


class SplitsAtComparisons:
    """Rewrites a comparison as one question for each side."""

    def rewrite(self, question: str, mode: str) -> str:
        return "\n".join(p.strip() for p in re.split(r"(?i)\bvs\.?\s|\bversus\b|\brelative to\b", question)) if mode == "decompose" else question


def embed(df: DataFrame, key: str, text: str, embedder: Embedder | None = None, batch: int = 100) -> DataFrame:
    """(key, embedding): texts in batches, in order, each with its key."""
    model = embedder or HashedWords()
    schema = T.StructType([df.schema[key], T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):
                some = b.slice(at, batch)
                vectors = model.embed_many([t or "" for t in some.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(vectors, pa.list_(pa.float32()))], names=[f.name for f in schema])

    return df.select(key, text).mapInArrow(run, schema)
