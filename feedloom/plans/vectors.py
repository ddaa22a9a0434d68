"""Upkeep of stored vector tables."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.vectors import vector_manifest
from ..sources.staged import discard, publish, stage
from ..sources.writers import LOOKUP_OPTIONS


def clean_stored_vectors(
    spark: SparkSession, path: str, model: str, out: str, dim: int | None = None, dry_run: bool = False, force: bool = False
) -> DataFrame:
    """Write the vectors of one model that have `dim` elements, by default its most frequent length, below `out`.

    Returns the report (year, dim, rows, kept), from the lengths of the stored vectors alone. A dry run writes nothing. Years
    are published one by one when all are written, with a manifest of rows and dimension beside them; a year that `out` has
    stays as it is unless `force`.
    """
    rows = spark.read.schema(schemas.VECTOR_TABLE).parquet(path).where(F.col("model") == model)
    lengths = rows.groupBy("year", F.size("embedding").alias("dim")).agg(F.count("*").alias("rows"))
    if dim is None:
        top = lengths.groupBy("dim").agg(F.sum("rows").alias("rows")).orderBy(F.desc("rows"), F.desc("dim")).first()
        if top is None:
            raise ValueError(f"no vectors of model {model} below {path}")
        dim = top["dim"]
    report = lengths.withColumn("kept", F.coalesce(F.col("dim") == dim, F.lit(False)))
    if not dry_run:
        aside = f"{out}/_aside/{uuid.uuid4().hex}"
        kept = rows.where(F.size("embedding") == dim)
        staged = stage(
            kept, "vectors", aside, out, partition_by=["model", "year"], sort_by=["paper_id"], compression="zstd", **LOOKUP_OPTIONS
        )
        publish(spark, staged, force)
        stored = spark.read.schema(schemas.VECTOR_TABLE).parquet(out).where(F.col("model") == model)
        manifest = stage(vector_manifest(stored).coalesce(1), "manifest", aside, f"{out}/_manifest/{model}", fmt="json")
        publish(spark, manifest, force=True)
        discard(spark, aside)
    return report
