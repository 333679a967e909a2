"""Encoders and language models as sources of columns (A41-A45, J23). None is part of the engine: callables are given."""

from __future__ import annotations

import json
import time
import urllib.request
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

Encoder = Callable[[list[str]], list[list[float]]]
Model = Callable[[list[str]], list[str]]

# What precedes a text for each task of an encoder.
TASKS = {
    "query": "Represent the query for retrieving relevant documents: ",
    "document": "Represent the document for retrieval: ",
    "search_query": "Represent the search query for retrieving documents: ",
    "passage": "Represent the passage for retrieval: ",
}
#: Characters of a prompt that a model is given.
PROMPT = 180_000


def hashed_encoder(size: int = 64) -> Encoder:
    """Words hashed into ``size`` signed buckets: an encoder that needs no model."""

    def encode(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), size))
        for row, text in enumerate(texts):
            for word in text.lower().split():
                h = zlib.crc32(word.encode())
                out[row, h % size] += 1.0 if h & 0x80000000 else -1.0
        return out.tolist()

    return encode


def http_encoder(url: str, model: str, key: str = "", seconds: float = 30.0) -> Encoder:
    """An embeddings endpoint that takes ``{model, input}`` and answers with ``data[].embedding``."""

    def encode(texts: list[str]) -> list[list[float]]:
        body = json.dumps({"model": model, "input": texts}).encode()
        request = urllib.request.Request(url, body, {"Content-Type": "application/json", "Authorization": f"Bearer {key}"})
        with urllib.request.urlopen(request, timeout=seconds) as answer:
            return [x["embedding"] for x in json.load(answer)["data"]]

    return encode


def unit(vector) -> list[float]:
    """A vector of length 1; nested ones are unwrapped, and zero or non-finite ones give an empty list."""
    x = np.asarray(vector, float).ravel()
    n = float(np.linalg.norm(x)) if x.size else 0.0
    return (x / n).tolist() if n > 0 and np.isfinite(n) else []


def embed(df: DataFrame, key: str, text: str, encoder: Encoder, task: str | None = None) -> DataFrame:
    """Rows (key, embedding) with unit vectors, a batch of texts at a time.

    Null and blank texts, and zero vectors, give an empty list. An encoder that fails fails the
    task, which Spark tries again.
    """
    before = TASKS[task] if task else ""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            given = [k for k, t in enumerate(texts) if t and t.strip()]
            out: list[list[float]] = [[] for _ in texts]
            for k, vector in zip(given, encoder([before + texts[k] for k in given]) if given else []):
                out[k] = unit(vector)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], ["key", "embedding"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).cast("string")).mapInArrow(run, f"key {kind}, embedding array<double>").withColumnRenamed("key", key)


def complete(df: DataFrame, key: str, prompt: str, model: Model, at_once: int | None = None, pause: float = 0.0) -> DataFrame:
    """Rows (key, answer) for every prompt, cut at ``PROMPT`` characters (A45); null prompts give null.

    An endpoint's limits are parameters: ``at_once`` tasks ask it at a time, each with ``pause`` seconds between batches (J23).
    """

    def run(batches):
        for batch in batches:
            prompts = batch.column(1).to_pylist()
            if pause:
                time.sleep(pause)
            given = [k for k, p in enumerate(prompts) if p is not None]
            out: list[str | None] = [None] * len(prompts)
            for k, answer in zip(given, model([prompts[k][:PROMPT] for k in given]) if given else []):
                out[k] = answer
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["key", "answer"])

    kind = df.schema[key].dataType.simpleString()
    few = df.select(F.col(key).alias("key"), F.col(prompt).cast("string"))
    few = few.repartition(at_once) if at_once else few
    return few.mapInArrow(run, f"key {kind}, answer string").withColumnRenamed("key", key)
