"""Writing with a verdict: rows are counted while they are written aside, and published only if the counts allow it.

Publishing is a rename per partition folder, so readers see each folder whole or not at all, and a run that fails its checks
or dies leaves the target as it was.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .writers import CSV_WRITE_OPTIONS, partitions, path_exists


@dataclass(frozen=True)
class Staged:
    """Rows written aside for `final`, with what was seen on the way."""

    name: str
    path: str
    final: str
    fmt: str
    partition_by: tuple[str, ...]
    rows: int
    nulls: dict[str, int]
    missing: tuple[str, ...]

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.format(self.fmt).options(header=True, recursiveFileLookup=False).load(self.path)


def stage(
    df: DataFrame,
    name: str,
    aside: str,
    final: str,
    required: Sequence[str] = (),
    fmt: str = "parquet",
    partition_by: Sequence[str] = (),
    sort_by: Sequence[str] = (),
    drop: Sequence[str] = (),
    **options,
) -> Staged:
    """Write `df` below `aside`, without the columns `drop`; counts rows and nulls of the required columns in the same pass.

    The counting sits in the last stage, whose tasks count once however often they run.
    """
    present = [c for c in required if c in df.columns]
    missing = tuple(c for c in required if c not in df.columns)
    if partition_by:
        df = df.hint("rebalance", *[F.col(c) for c in partition_by])
    if sort_by:
        df = df.sortWithinPartitions(*partition_by, *sort_by)
    seen = Observation()
    nulls = [F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(present)]
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"), *nulls)
    path = f"{aside}/{name}"
    defaults = CSV_WRITE_OPTIONS if fmt == "csv" else {}
    counted.drop(*drop).write.format(fmt).partitionBy(*partition_by).options(**{**defaults, **options}).save(path)
    found = seen.get
    gaps = {c: found[f"n{i}"] for i, c in enumerate(present) if found[f"n{i}"]}
    return Staged(name, path, final, fmt, tuple(partition_by), found["rows"], gaps, missing)


def publish(spark: SparkSession, staged: Staged, force: bool = False) -> tuple[list[str], list[str]]:
    """Move the staged partitions to their place; returns (published, skipped) paths relative to the target.

    A partition that is there already is skipped, or replaced with `force`.
    """
    jvm, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    done, skipped = [], []
    for part in partitions(spark, staged.path, len(staged.partition_by)):
        end = f"{staged.final}/{part}" if part else staged.final
        source, target = jvm.Path(f"{staged.path}/{part}" if part else staged.path), jvm.Path(end)
        files = target.getFileSystem(conf)
        if path_exists(spark, end):
            if not force:
                skipped.append(part)
                continue
            files.delete(target, True)
        files.mkdirs(target.getParent())
        if not files.rename(source, target):
            raise OSError(f"cannot publish {end}")
        done.append(part)
    return done, skipped


def discard(spark: SparkSession, aside: str) -> None:
    """Delete a folder of staged rows."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(aside)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
