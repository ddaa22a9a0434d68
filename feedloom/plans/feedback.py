"""Landed discussion threads into the preference table."""

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.feedback import apply_feedback, label_threads
from ..sources.readers import CSV_OPTIONS, read_threads
from ..sources.staged import discard, publish, stage
from ..sources.writers import path_exists


def update_preferences(
    spark: SparkSession, threads_path: str, existing: DataFrame | None, insert_new: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(labels of the threads, updated preferences); without a table yet, the labels become it."""
    labels = label_threads(read_threads(spark, threads_path))
    if existing is None:
        return labels, labels
    return labels, apply_feedback(existing, labels, insert_new)


def sync_feedback(
    spark: SparkSession, threads_path: str, root: str, at: datetime, insert_new: bool = False
) -> tuple[DataFrame, DataFrame]:
    """`update_preferences` with both results stored: the labels of this run, and the preferences of its month.

    The month's preferences are written aside and then take the place of the old ones. Running it again with the same
    threads changes nothing.
    """
    month = f"{root}/preferences/{at:%Y-%m}.csv"
    run = f"{root}/feedback/run_id={at:%Y%m%d-%H%M%S}"
    existing = spark.read.options(**CSV_OPTIONS).csv(month) if path_exists(spark, month) else None
    labels, updated = update_preferences(spark, threads_path, existing, insert_new)
    aside = f"{root}/_aside/{uuid.uuid4().hex}"
    # Ids are text: a CSV read without a schema leaves them so.
    staged = [
        stage(updated.select(*[F.col(c).cast("string") for c in updated.columns]), "preferences", aside, month, fmt="csv"),
        stage(labels, "labels", aside, run, fmt="csv"),
    ]
    for table in staged:
        publish(spark, table, force=True)
    discard(spark, aside)
    return spark.read.options(**CSV_OPTIONS).csv(run), spark.read.options(**CSV_OPTIONS).csv(month)
