"""Vectors for the papers that have none yet."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.candidates import embedding_backlog, limit_ordered
from ..operators.dedup import keep_first
from ..operators.inference import BackendFactory, embed_texts
from ..operators.reshape import embedding_inputs
from ..sources.readers import existing_vector_ids
from ..sources.writers import write_vectors


def vector_rows(
    inputs: DataFrame, model: str, backend: str | BackendFactory, generated_at: str,
    batch_size: int = 32, source: str = "embedding"
) -> DataFrame:
    """Embedded inputs in the layout of the vector table. `model_dim` is the actual length."""
    return embed_texts(inputs, backend, batch_size).select(
        F.lit(model).alias("model"),
        "year",
        "paper_id",
        "embedding",
        F.lit(generated_at).alias("generated_at"),
        F.size("embedding").alias("model_dim"),
        F.lit(source).alias("source"),
    )


def pending_inputs(
    meta: DataFrame, path: str, model: str, overwrite: bool = False, strict: bool = True
) -> DataFrame:
    """(paper_id, text, year) to embed for one model; rows without a year are an error, or left out if not `strict`."""
    inputs = embedding_inputs(meta, strict=strict)
    if not strict:
        inputs = inputs.where(F.col("year").isNotNull())
    ids = None if overwrite else existing_vector_ids(meta.sparkSession, path, model)
    if ids is None:
        return keep_first(inputs, "paper_id", ["year", "text"])
    return embedding_backlog(inputs, ids)


def embed_missing(
    meta: DataFrame,
    path: str,
    model: str,
    backend: str | BackendFactory,
    generated_at: str,
    batch_size: int = 32,
    limit: int | None = None,
    overwrite: bool = False,
    allow_truncate: bool = False,
) -> None:
    """Embed what the table at `path` lacks for `model` and store it."""
    todo = pending_inputs(meta, path, model, overwrite)
    if limit is not None:
        todo = limit_ordered(todo, ["year", "paper_id"], limit)
    write_vectors(
        vector_rows(todo, model, backend, generated_at, batch_size),
        path,
        overwrite=overwrite,
        allow_truncate=allow_truncate,
        limited=limit is not None,
        models=[model],
        only_new=not overwrite,
    )
