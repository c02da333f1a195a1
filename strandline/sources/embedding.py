"""Embedding texts in Arrow batches, by a service or by a stand-in for tests."""

from __future__ import annotations

import hashlib
import json
import math
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

from pyspark.sql import DataFrame



class Embedder(Protocol):
    model: str

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HttpEmbedder:
    """POST {url}/api/embed with {"model", "input"}; raises on another status, another
    number of vectors or other dimensions."""

    def __init__(self, url: str, model: str, dims: int = 768, timeout: float = 60.0):
        self.url, self.model, self.dims, self.timeout = url.rstrip("/"), model, dims, timeout

    def embed(self, texts: list[str]) -> list[list[float]]:
        body = json.dumps({"model": self.model, "input": texts}).encode()
        request = urllib.request.Request(f"{self.url}/api/embed", body, {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            if answer.status != 200:
                raise RuntimeError(f"the service answered {answer.status}")
            vectors = json.load(answer).get("embeddings")
        if not isinstance(vectors, list) or len(vectors) != len(texts):
            raise RuntimeError("the service gave another number of vectors")
        if any(len(v) != self.dims for v in vectors):
            raise RuntimeError(f"the service's vectors don't have {self.dims} dimensions")
        return vectors


class HashEmbedder:
    """Unit vectors from hashes of words: the same for the same text, anywhere."""

    def __init__(self, dims: int = 64, model: str = "hash"):
        self.dims, self.model = dims, model

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.dims
            for w in t.lower().split() or [""]:
                h = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "replace"), digest_size=8).digest(), "little")
                v[h % self.dims] += 1.0 if h >> 32 & 1 else -1.0
            n = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / n for x in v])
        return out


def embed(df: DataFrame, make: Callable[[], Embedder], text: str = "chunk_text", batch: int = 64) -> DataFrame:
    """``df`` with ``embedding`` and ``embedding_model``; one client for each task, one
    request for ``batch`` texts. Null texts have no vector."""
    import pyarrow as pa

    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = make()
        for b in batches:
            texts = b.column(at).to_pylist()
            vectors: list = [None] * len(texts)
            full = [i for i, t in enumerate(texts) if t is not None]
            for k in range(0, len(full), batch):
                part = full[k : k + batch]
                for i, v in zip(part, client.embed([texts[i] for i in part])):
                    vectors[i] = v
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(vectors, pa.list_(pa.float32())), pa.array([client.model if v is not None else None for v in vectors], pa.string())], [*b.schema.names, "embedding", "embedding_model"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{fields}, embedding array<float>, embedding_model string")
