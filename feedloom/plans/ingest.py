"""Landed harvest pages into the metadata table."""

import logging
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.candidates import limit_ordered
from ..operators.dedup import duplicate_report, upsert_latest
from ..operators.reshape import normalise_schema, split_by_year
from ..session import materialise
from ..sources.readers import parse_harvest, read_harvest_xml
from ..sources.versions import (
    BASE, BATCH, Versions, append_version, compact, live_runs, newest, read_versions, stored_rows,
)
from ..sources.writers import write_metadata

log = logging.getLogger(__name__)

#: Parts of a year's metadata by hash of the id; a lookup reads one. Each batch has a file for each part it touches, so more
#: of them are for tables whose batches are large.
BUCKETS = 4


def harvest(spark: SparkSession, folders: Sequence[str], limit: int | None = None) -> DataFrame:
    """Metadata rows of all harvested folders (one per category); an unreadable one is skipped."""
    frames = []
    for folder in folders:
        try:
            frames.append(parse_harvest(read_harvest_xml(spark, folder)))
        except AnalysisException as error:
            log.warning("skipping %s: %s", folder, error)
    if not frames:
        raise ValueError("none of the harvest folders can be read")
    records = reduce(DataFrame.unionByName, frames)
    if limit is not None:
        records = limit_ordered(records, ["paper_id", "updated_at", "source"], limit)
    return records


def metadata_versions(path: str) -> Versions:
    """The metadata table: the latest version of an id within its publication year, in a tie that of the newer batch.

    Rows lie by year and hash of the id. Where even the batch is the same, a hash of the row decides.
    """
    ties = newest(["year", "paper_id"], ["updated_at", BATCH, "_tie"])

    def merge(rows: DataFrame) -> DataFrame:
        return ties(_in_buckets(rows).withColumn("_tie", F.xxhash64(*schemas.METADATA_COLUMNS))).drop("_tie")

    return Versions(path, merge, ("year", "bucket"), schemas.METADATA_RUNS)


def _in_buckets(rows: DataFrame) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64("paper_id"), F.lit(BUCKETS)).cast("int"))


def upsert_metadata(records: DataFrame, path: str) -> DataFrame:
    """Merge records into the table at `path`; returns the rows without a publication year.

    A batch is written as it is and merged by the readers (`read_metadata_table`), so its cost is that of its own rows:
    nothing is ranked, and what is stored is neither read nor rewritten until a compaction. Running the same batch again
    changes nothing.
    """
    table = metadata_versions(path)
    accepted, rejected = split_by_year(normalise_schema(records))
    append_version(_in_buckets(accepted), table)
    compact(records.sparkSession, table)
    return rejected


def read_metadata_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The latest version of each id per publication year, or None while there is no table."""
    found = read_versions(spark, metadata_versions(path))
    return None if found is None else found.select(*schemas.METADATA_TABLE.names)


def deduplicate_table(spark: SparkSession, path: str) -> DataFrame:
    """Leave one row per id and year at the path; returns the report of what was there.

    A table of plain year folders has the years with repeated ids rewritten, one of versions is merged into one run.
    """
    versions = [run for run in live_runs(spark, path) if run.last != BASE]
    if versions:
        table = metadata_versions(path)
        report = materialise(duplicate_report(stored_rows(spark, table)), "duplicates")
        compact(spark, table, whole=True)
        return report
    stored = spark.read.parquet(path)
    report = materialise(duplicate_report(stored), "duplicates")
    dirty = [
        int(row["year"])
        for row in report.where("removed > 0 AND year <> 'total'").select("year").collect()
    ]
    if dirty:
        rows = stored.where(F.col("year").isin(dirty))
        write_metadata(upsert_latest(rows, tie=schemas.METADATA_COLUMNS), path)
    return report
