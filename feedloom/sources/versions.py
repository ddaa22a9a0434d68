"""Tables that are only added to: every batch is a run of its own, readers merge the runs, compaction keeps them few.

A run is a folder `run=<level>-<first>-<last>` with the rows of the batches `first` to `last`. It is written aside and
published by one rename, so a reader sees a batch whole or not at all, and a batch that is delivered again finds itself
published and adds nothing. `FAN` neighbouring runs of a level are merged into one run of the next, as in a log-structured
store: a row is rewritten once per level, not once per batch, and runs of older rows stay as they are. A run whose batches
are also in a larger one counts no more and is deleted by the next compaction, which leaves readers of the moment their files.

One writer at a time per table. Plain files or partition folders at the path, such as those of a migration, are the run
before all others.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.dedup import keep_last

#: Runs of one level that are merged into one of the next.
FAN = 4
#: Number of the batch that brought a row, stored with it; what lies at the path without a run came before all batches.
BATCH, BASE = "_batch", -1

Merge = Callable[[DataFrame], DataFrame]


def newest(key: Sequence[str], version: Sequence[str] = ()) -> Merge:
    """Of each key, the last row by `version`, and of equal ones that of the latest batch."""
    return lambda rows: keep_last(rows, list(key), [*version, BATCH])


def summed(key: Sequence[str], sums: Sequence[str], latest: Sequence[str] = ()) -> Merge:
    """Of each key, one row with the sums of some columns and the maxima of others; the batch is that of its latest row."""
    totals = [*[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in (*latest, BATCH)]]
    return lambda rows: rows.groupBy(*key).agg(*totals).select(*rows.columns)


def unmerged(rows: DataFrame) -> DataFrame:
    """All rows, for tables whose batches never repeat one."""
    return rows


@dataclass(frozen=True)
class Versions:
    """A table of runs: where it lies, how rows of several runs become one, and its partition columns.

    With a `schema` (without the batch column) no file is opened to find it.
    """

    path: str
    merge: Merge
    partition_by: tuple[str, ...] = ()
    schema: T.StructType | None = None
    fan: int = FAN


@dataclass(frozen=True)
class Run:
    level: int
    first: int
    last: int
    paths: tuple[str, ...]

    def holds(self, other: Run) -> bool:
        same = (self.first, self.last) == (other.first, other.last)
        return self.first <= other.first and other.last <= self.last and (not same or self.level > other.level)


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def all_runs(spark: SparkSession, path: str) -> list[Run]:
    """Every run at the path, those that count no more included; one listing of one folder."""
    target, files = _file_system(spark, path)
    found, base = [], []
    for status in files.listStatus(target) if files.exists(target) else []:
        name = status.getPath().getName()
        if name.startswith("run="):
            level, first, last = (int(part) for part in name[4:].split("-"))
            found.append(Run(level, first, last, (f"{path}/{name}",)))
        elif not name.startswith(("_", ".")):
            base.append(f"{path}/{name}")
    if base:
        found.append(Run(0, BASE, BASE, tuple(base)))
    return sorted(found, key=lambda run: (run.first, run.last, run.level))


def live_runs(spark: SparkSession, path: str) -> list[Run]:
    """The runs that together hold every batch once, oldest first."""
    found = all_runs(spark, path)
    return [run for run in found if not any(other.holds(run) for other in found)]


def last_batch(spark: SparkSession, path: str) -> int:
    """Number of the latest batch, BASE for a table without any."""
    return max((run.last for run in all_runs(spark, path)), default=BASE)


def _rows(spark: SparkSession, table: Versions, runs: Sequence[Run]) -> DataFrame:
    """The rows of the runs with their batch."""
    reader = spark.read.option("basePath", table.path)
    if table.schema is not None:
        reader = reader.schema(T.StructType([*table.schema.fields, T.StructField(BATCH, T.LongType())]))
    frames = [reader.parquet(*run.paths) for run in runs if run.last == BASE]
    paths = [path for run in runs if run.last != BASE for path in run.paths]
    if paths:
        frames.append(reader.parquet(*paths))
    for i, rows in enumerate(frames):
        batch = F.col(BATCH) if BATCH in rows.columns else F.lit(None).cast("long")
        frames[i] = rows.drop("run").withColumn(BATCH, F.coalesce(batch, F.lit(BASE)))
    return reduce(lambda a, b: a.unionByName(b), frames)


def read_versions(spark: SparkSession, table: Versions) -> DataFrame | None:
    """The merged rows, or None while there is nothing at the path."""
    runs = live_runs(spark, table.path)
    return table.merge(_rows(spark, table, runs)).drop(BATCH) if runs else None


def stored_rows(spark: SparkSession, table: Versions) -> DataFrame | None:
    """The rows of all batches as they are stored, with their batch, not merged."""
    runs = live_runs(spark, table.path)
    return _rows(spark, table, runs) if runs else None


def claim(spark: SparkSession, path: str, owner: str) -> None:
    """Make `owner` the one whose batch numbers count in the table: another stream's would be taken for replays."""
    mark = "_owner=" + hashlib.sha256(owner.encode()).hexdigest()[:32]
    target, files = _file_system(spark, path)
    found = [s.getPath().getName() for s in files.listStatus(target)] if files.exists(target) else []
    if any(name.startswith("_owner=") and name != mark for name in found):
        raise ValueError(f"{path} belongs to a stream with another checkpoint")
    if mark not in found:
        files.mkdirs(_file_system(spark, f"{path}/{mark}")[0])


def _publish(df: DataFrame, table: Versions, name: str) -> None:
    spark = df.sparkSession
    aside = f"{table.path}/_aside/{uuid.uuid4().hex}"
    if table.partition_by:
        df = df.hint("rebalance", *[F.col(c) for c in table.partition_by])
    df.write.partitionBy(*table.partition_by).parquet(aside)
    source, files = _file_system(spark, aside)
    target, _ = _file_system(spark, f"{table.path}/{name}")
    if not files.rename(source, target):
        raise OSError(f"cannot publish {name} below {table.path}")


def append_version(df: DataFrame, table: Versions, batch: int | None = None) -> int:
    """Publish `df` as a batch, by default the next one; returns its number. A batch that is there already adds nothing."""
    spark = df.sparkSession
    if batch is None:
        batch = last_batch(spark, table.path) + 1
    if not has_batch(spark, table.path, batch):
        _publish(df.withColumn(BATCH, F.lit(batch).cast("long")), table, f"run=0-{batch:012d}-{batch:012d}")
    return batch


def has_batch(spark: SparkSession, path: str, batch: int) -> bool:
    return any(run.first <= batch <= run.last for run in all_runs(spark, path))


def compact(spark: SparkSession, table: Versions, whole: bool = False) -> None:
    """Merge neighbouring runs wherever a level has `fan` of them, or all runs into one (`whole`).

    Runs that an earlier compaction replaced are deleted first. A compaction that ends halfway leaves what was there.
    """
    found = all_runs(spark, table.path)
    for run in found:
        if any(other.holds(run) for other in found):
            for path in run.paths:
                target, files = _file_system(spark, path)
                files.delete(target, True)
    runs = live_runs(spark, table.path)
    if whole:
        if len(runs) > 1:
            _merge(spark, table, runs)
        return
    level = 0
    while any(run.level >= level for run in runs):
        mine = [run for run in runs if run.level == level and run.last != BASE]
        if len(mine) >= table.fan:
            _merge(spark, table, mine)
            runs = live_runs(spark, table.path)
        level += 1


def _merge(spark: SparkSession, table: Versions, runs: Sequence[Run]) -> None:
    level = max(run.level for run in runs) + 1
    name = f"run={level}-{runs[0].first:012d}-{runs[-1].last:012d}"
    if runs[0].first == BASE:
        name = f"run={level}-{BASE + 1:012d}-{runs[-1].last:012d}"
    _publish(table.merge(_rows(spark, table, runs)), table, name)
    if runs[0].first == BASE:
        # Its rows are merged again until they are gone, which changes nothing for `newest`.
        for path in runs[0].paths:
            target, files = _file_system(spark, path)
            files.delete(target, True)
