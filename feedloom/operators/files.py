"""File manifests, retention and run discovery over file listings."""

import fnmatch
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas


def glob_match(c: Column, pattern: str) -> Column:
    """Shell pattern match of a whole text."""
    return c.rlike("^" + fnmatch.translate(pattern))


def exclude_globs(df: DataFrame, patterns: Sequence[str], path: str = "path") -> DataFrame:
    """Files that match none of the patterns, by whole path or by name alone."""
    name = F.substring_index(F.col(path), "/", -1)
    for pattern in patterns:
        df = df.where(~(glob_match(F.col(path), pattern) | glob_match(name, pattern)))
    return df


def file_manifest(files: DataFrame) -> DataFrame:
    """File count and total bytes."""
    return files.agg(
        F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")
    )


def retention_plan(
    df: DataFrame, keep: int, by: str = "dataset", modified: str = "modified", path: str = "path"
) -> DataFrame:
    """The archives to delete: all but the `keep` newest of each dataset. Deletes nothing.

    The newest ones are found first (a ranking that is pruned in the map tasks) and everything older
    than the last of them is listed by a plain comparison, so no dataset is sorted as a whole.
    """
    newest = Window.partitionBy(by).orderBy(F.desc(modified), F.desc(path))
    kept = (
        df.select(by, modified, path)
        .withColumn("rank", F.row_number().over(newest))
        .where(F.col("rank") <= keep)
    )
    edge = kept.groupBy(by).agg(F.min(F.struct(modified, path)).alias("_edge"))
    return (
        df.join(edge, by).where(F.struct(modified, path) < F.col("_edge")).drop("_edge")
        if keep > 0
        else df
    )


def latest_run(
    df: DataFrame, names: Sequence[str] = schemas.RUN_OUTPUT_FILES
) -> DataFrame:
    """The output of the newest run that has one: (run_id, file), best file name first."""
    rank = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("file"))
    return (
        df.where(F.col("file").isin(*names))
        .orderBy(F.desc("run_id"), rank)
        .limit(1)
        .select("run_id", "file")
    )
