"""Batched model calls: embedders and text models over Arrow batches."""

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class BatchBackend(Protocol):
    """A model: takes a batch of texts and returns one result per text."""

    def run(self, texts: Sequence[str]) -> Sequence: ...


BackendFactory = Callable[[], BatchBackend]
_registry: dict[str, BackendFactory] = {}


def register_backend(name: str, factory: BackendFactory) -> None:
    """Make a backend known by name. The factory is shipped to the workers, so it must pickle."""
    _registry[name] = factory


def get_backend(name: str) -> BackendFactory:
    if name not in _registry:
        raise KeyError(f"unknown backend {name!r}; known: {', '.join(list_backends())}")
    return _registry[name]


def list_backends() -> list[str]:
    return sorted(_registry)


class HashingEmbedder:
    """Vectors by signed feature hashing of lower-case words, scaled to length 1.

    Needs no model file and gives the same vector everywhere.
    """

    WORD = re.compile(r"[^ \t\n\r\f\v]+")

    def __init__(self, dim: int = 64):
        self.dim = dim
        self.slot = lru_cache(maxsize=1 << 16)(self._slot)

    def _slot(self, word: str) -> tuple[int, int]:
        code = int(hashlib.md5(word.encode()).hexdigest()[:8], 16)
        return (code >> 1) % self.dim, 1 if code & 1 else -1

    def run(self, texts: Sequence[str]) -> list[np.ndarray]:
        out = np.zeros((len(texts), self.dim), dtype=np.float64)
        for row, text in zip(out, texts):
            for word in self.WORD.findall(text.lower()):
                at, sign = self.slot(word)
                row[at] += sign
        norms = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return list((out / np.where(norms == 0, 1.0, norms)).astype(np.float32))


register_backend("hashing", HashingEmbedder)


#: Models that one Python worker keeps; the one used longest ago is closed for a new one.
KEPT_BACKENDS = 2


def worker_backend(name: str, factory: BackendFactory, keep: int = KEPT_BACKENDS) -> BatchBackend:
    """The worker process's own backend of that name, made by its first task and kept for the later ones.

    Code travels to a worker anew with each task, and its variables with it, so what is kept is tied to the process. A backend
    with a `close` method is closed when it makes room or the process ends.
    """
    import atexit
    import sys
    from types import SimpleNamespace

    held = sys.modules.get("_feedloom_backends")
    if held is None:
        held = sys.modules["_feedloom_backends"] = SimpleNamespace(backends={})
        atexit.register(lambda: [_close(backend) for backend in held.backends.values()])
    backends = held.backends
    backend = backends.pop(name, None)
    while len(backends) >= max(1, keep):
        _close(backends.pop(next(iter(backends))))
    backends[name] = factory() if backend is None else backend
    return backends[name]


def _close(backend) -> None:
    close = getattr(backend, "close", None)
    if close is not None:
        close()


def _batches(frames: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for start in range(0, len(frame), size):
            yield frame.iloc[start : start + size]


def run_batched(
    df: DataFrame,
    factory: BackendFactory,
    text: str,
    result: T.StructField,
    batch_size: int,
    isolate_errors: bool = False,
    rebalance: bool = True,
) -> DataFrame:
    """Add the backend's result for `text`; the backend is made once per worker process, not per task or batch.

    With `isolate_errors` a failing batch is retried row by row and each failing row keeps its
    message in `error` instead of failing the job.

    Rows are spread evenly first: a model call costs far more than moving its text, and scan tasks
    are as uneven as the files' row groups. Spark sizes the parts (all cores for little data, the
    advisory size for much). Turn `rebalance` off for input that is already even.
    """
    if batch_size < 1:
        raise ValueError("batch_size must be at least 1")
    fields = [*df.schema.fields, result]
    if isolate_errors:
        fields.append(T.StructField("error", T.StringType()))

    # Equal factories share a backend; one that cannot be told from others has its own.
    name = hashlib.sha256(cloudpickle.dumps(factory)).hexdigest()

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _batches(frames, batch_size):
            backend = worker_backend(name, factory)
            texts = batch[text].fillna("").tolist()
            if not isolate_errors:
                yield batch.assign(**{result.name: list(backend.run(texts))})
                continue
            outputs, errors = _run_isolated(backend, texts)
            yield batch.assign(**{result.name: outputs, "error": errors})

    rows = df.hint("rebalance") if rebalance else df
    return rows.mapInPandas(call, T.StructType(fields))


def _run_isolated(backend: BatchBackend, texts: list[str]) -> tuple[list, list]:
    try:
        return list(backend.run(texts)), [None] * len(texts)
    except Exception:
        outputs, errors = [], []
        for one in texts:
            try:
                outputs.append(backend.run([one])[0])
                errors.append(None)
            except Exception as problem:  # a bad row must not end the run
                outputs.append(None)
                errors.append(f"{type(problem).__name__}: {problem}")
        return outputs, errors


def embed_texts(
    df: DataFrame,
    backend: str | BackendFactory = "hashing",
    batch_size: int = 32,
    text: str = "text",
    rebalance: bool = True,
) -> DataFrame:
    """Add `embedding` for every row of `text`."""
    factory = get_backend(backend) if isinstance(backend, str) else backend
    field = T.StructField("embedding", T.ArrayType(T.FloatType()))
    return run_batched(df, factory, text, field, batch_size, rebalance=rebalance)


def dimension_report(df: DataFrame, expected: int) -> DataFrame:
    """Rows by actual vector length, flagged where it is not the configured one."""
    return (
        df.groupBy(F.size("embedding").alias("model_dim"))
        .agg(F.count("*").alias("rows"))
        .withColumn("mismatch", F.col("model_dim") != expected)
    )


def run_model(df: DataFrame, backend: BackendFactory, batch_size: int = 16) -> DataFrame:
    """(id, prompt) to (id, output, error): one model call per row, failures kept per row."""
    field = T.StructField("output", T.StringType())
    return run_batched(
        df.select("id", "prompt"), backend, "prompt", field, batch_size, isolate_errors=True
    ).select("id", "output", "error")
