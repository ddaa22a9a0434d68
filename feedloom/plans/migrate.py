"""Wide yearly tables, monthly preferences and summary files into the stored layout."""

import logging
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import blank
from ..operators.dedup import keep_first, latest_snapshot
from ..operators.reports import preference_stats, raise_on_error, spread, validate, validate_rows
from ..operators.reshape import (
    missing_models, missing_wide_columns, preference_events, reshape_metadata, unpivot_vectors,
)
from ..operators.summaries import normalise_summaries
from ..session import materialise, scratch_path
from ..sources.readers import (
    parse_summaries, read_preference_months, read_summaries, read_year_files, year_files,
)
from ..sources.staged import Staged, discard, publish, stage
from ..sources.writers import write_metadata, write_table, write_vectors

log = logging.getLogger(__name__)


def migrate_wide(
    wide: DataFrame,
    root: str,
    models: Sequence[str] | None = None,
    source: str = "hf:unknown",
    dry_run: bool = False,
    strict: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Split wide yearly rows into the metadata and vector tables; returns both frames.

    The validation report decides before anything is written.
    """
    for column in missing_wide_columns(wide):
        log.warning("wide table has no column %s", column)
    for model in missing_models(wide, models or []):
        log.warning("no vector column for model %s", model)
    metadata = reshape_metadata(wide)
    vectors = unpivot_vectors(wide, models, source)
    checks = validate(metadata, "metadata", schemas.METADATA_REQUIRED, strict=strict).unionByName(
        validate(vectors, "embeddings", schemas.VECTOR_COLUMNS, allow_empty=True, strict=strict)
    )
    raise_on_error(checks)
    if not dry_run:
        write_metadata(metadata, f"{root}/metadata")
        write_vectors(vectors, f"{root}/embeddings", overwrite=True)
        snapshot = latest_snapshot(metadata).orderBy(blank(F.col("published_at")), "paper_id").drop("year")
        write_table(snapshot, f"{root}/latest", fmt="csv", overwrite=True)
    return metadata, vectors


def migrate_preferences(
    months: DataFrame, root: str, generated_at: str, dry_run: bool = False, force: bool = False
) -> DataFrame:
    """Monthly preference rows into yearly event files, sorted by id and time; returns the events.

    A year that is stored already stays as it is, as these months may be only some of it; `force` replaces it.
    """
    events = preference_events(months, generated_at)
    if not dry_run:
        aside = f"{root}/_aside/{uuid.uuid4().hex}"
        _, skipped = publish(months.sparkSession, _stage_events(events, aside, root), force)
        discard(months.sparkSession, aside)
        for part in skipped:
            log.warning("preferences of %s exist already and are left as they are", part)
    return events


def _stage_events(events: DataFrame, aside: str, root: str) -> Staged:
    return stage(
        events.select("year", *schemas.PREFERENCE_COLUMNS), "preferences", aside, f"{root}/preferences",
        schemas.PREFERENCE_COLUMNS, fmt="csv", partition_by=["year"], sort_by=["paper_id", "recorded_at"],
    )


def migrate_summaries(merged: DataFrame, root: str, dry_run: bool = False) -> DataFrame:
    """Merged summaries into JSON lines by month, sorted by id; returns them.

    Lines are written as text so that irregular keys are kept and the key order holds.
    """
    if not dry_run:
        (
            merged.select("month", "id", "json")
            .hint("rebalance", F.col("month"))
            .sortWithinPartitions("month", "id")
            .select("month", F.col("json").alias("value"))
            .write.mode("overwrite")
            .partitionBy("month")
            .option("partitionOverwriteMode", "dynamic")
            .text(f"{root}/summaries")
        )
    return merged


@dataclass(frozen=True)
class LegacyInputs:
    """What a migration reads: yearly wide files, monthly preference files, summary folders in rising priority."""

    wide: str | None = None
    preferences: str | None = None
    summaries: Sequence[tuple[str, str]] = ()
    years: Sequence[int] | None = None
    models: Sequence[str] | None = None
    source: str = "hf:unknown"


@dataclass(frozen=True)
class MigrationRun:
    """The report (section, key, value, note) of a migration, and the folders it wrote or left as they were."""

    report: DataFrame
    published: tuple[str, ...]
    skipped: tuple[str, ...]


REPORT = "section string, key string, value long, note string"


def migrate_all(
    spark: SparkSession,
    inputs: LegacyInputs,
    root: str,
    generated_at: str,
    dry_run: bool = False,
    force: bool = False,
    strict: bool = True,
) -> MigrationRun:
    """Everything a feed had stored before, into the layout below `root`.

    All tables are written aside first, counted on the way, and checked: a year, model or month without rows, a required
    column or key that is missing. With an error nothing is published. Else each year, model or month that `root` lacks is
    moved there; those it has stay as they are, with a warning, unless `force`. Text inputs are read once. A dry run checks
    and reports only.
    """
    aside = scratch_path(spark, "migration") if dry_run else f"{root}/_aside/{uuid.uuid4().hex}"
    parts = []
    if inputs.wide:
        parts.append(_stage_wide(spark, inputs, root, aside, strict))
    if inputs.preferences:
        parts.append(_stage_preferences(spark, inputs.preferences, root, aside, generated_at))
    if inputs.summaries:
        parts.append(_stage_summaries(spark, inputs.summaries, root, aside, generated_at, strict))
    tables = [table for staged, _ in parts for table in staged]
    report = materialise(reduce(DataFrame.unionByName, [rows for _, rows in parts]), "migration-checks")
    failed = report.where("section = 'validation' AND note LIKE 'error%'").orderBy("key").limit(1).collect()
    if failed:
        discard(spark, aside)
        raise ValueError(f"{failed[0]['key']} validation failed: {failed[0]['note'].removeprefix('error: ')}")
    done, kept = [], []
    for table in tables if not dry_run else ():
        published, skipped = publish(spark, table, force)
        done += [f"{table.name}/{part}" for part in published]
        kept += [f"{table.name}/{part}" for part in skipped]
    files = [(table.name.split("/")[0], "output_files", sum(d.startswith(table.name + "/") for d in done), None) for table in tables]
    warned = [("warnings", part, 1, "exists already and was left as it is") for part in kept]
    report = report.unionByName(spark.createDataFrame(files + warned, REPORT))
    discard(spark, aside)
    if not dry_run:
        if inputs.wide:
            stored = spark.read.parquet(f"{root}/metadata").withColumn("year", F.col("year").cast("string"))
            snapshot = latest_snapshot(stored).orderBy(blank(F.col("published_at")), "paper_id")
            write_table(snapshot.select(*schemas.METADATA_COLUMNS), f"{root}/latest", fmt="csv", overwrite=True)
        write_table(report, f"{root}/migration-report", fmt="json", overwrite=True)
    return MigrationRun(report, tuple(done), tuple(kept))


def _checked(spark: SparkSession, staged: Staged, targets: dict[str, int], strict: bool, allow_empty: bool = False) -> list[tuple]:
    """Validation rows of the targets of a table, by their row counts, and a warning for each column with nulls."""
    rows = []
    for target, n in sorted(targets.items()):
        issues = [f"missing columns: {', '.join(staged.missing)}"] if staged.missing else []
        issues += ["no rows produced"] if not n and not allow_empty else []
        status = ("error" if strict else "warning") if issues else "ok"
        rows.append(("validation", target, n, f"{status}: {'; '.join(issues)}" if issues else status))
    rows += [("warnings", staged.name, n, f"rows without {column}") for column, n in sorted(staged.nulls.items())]
    return rows


def _counts(spark: SparkSession, staged: Staged) -> dict[tuple, int]:
    """Rows of each partition of a staged table; its partitions are years, models and months."""
    keys = [F.col(c).cast("string").alias(c) for c in staged.partition_by]
    found = staged.read(spark).groupBy(*keys).count().collect() if staged.rows else []
    return {tuple(row)[:-1]: row["count"] for row in found}


def _stage_wide(spark, inputs: LegacyInputs, root: str, aside: str, strict: bool):
    files = year_files(spark, inputs.wide, inputs.years)
    warned, absent = [], []
    for year, path in files.items():
        columns = spark.read.parquet(path)
        warned += [("warnings", f"metadata-{year}", 1, f"no column {c}") for c in missing_wide_columns(columns)]
        lacking = missing_models(columns, inputs.models or [])
        warned += [("warnings", f"embeddings-{m}-{year}", 1, "no vector column") for m in lacking]
        absent += [(F.col("model") == m) & (F.col("year") == year) for m in lacking]
    wide = read_year_files(spark, inputs.wide, inputs.years)
    metadata = stage(
        reshape_metadata(wide), "metadata", aside, f"{root}/metadata", schemas.METADATA_REQUIRED,
        partition_by=["year"], sort_by=["paper_id"],
    )
    rows = unpivot_vectors(wide, inputs.models, inputs.source)
    if absent:
        rows = rows.where(~reduce(lambda a, b: a | b, absent))
    rows = rows.withColumn("_tie", F.xxhash64("embedding"))
    rows = keep_first(rows, ["model", "year", "paper_id"], ["generated_at", "_tie"]).drop("_tie")
    vectors = stage(
        rows, "embeddings", aside, f"{root}/embeddings", schemas.VECTOR_COLUMNS, partition_by=["model", "year"],
        sort_by=["paper_id"], compression="zstd",
    )
    by_year = {year: n for (year,), n in _counts(spark, metadata).items()}
    by_model = _counts(spark, vectors)
    checks = _checked(spark, metadata, {f"metadata-{y}": by_year.get(y, 0) for y in files}, strict)
    checks += _checked(spark, vectors, {f"embeddings-{m}-{y}": n for (m, y), n in by_model.items()}, strict, True)
    counted = [("metadata", year, n, None) for year, n in by_year.items()]
    counted += [("metadata", "total", metadata.rows, None), ("metadata", "input_files", len(files), None)]
    counted += [("embeddings", f"{m}/{y}", n, None) for (m, y), n in by_model.items()]
    return [metadata, vectors], spark.createDataFrame(counted + checks + warned, REPORT)


def _noted(df: DataFrame, section: str) -> DataFrame:
    """(key, value) rows as rows of the report."""
    return df.select(F.lit(section).alias("section"), "key", F.col("value").cast("long").alias("value"), F.lit(None).cast("string").alias("note"))


def _stage_preferences(spark, path: str, root: str, aside: str, generated_at: str):
    months = materialise(read_preference_months(spark, path), "preference-months")
    staged = _stage_events(preference_events(months, generated_at), aside, root)
    checks = _checked(spark, staged, {f"preferences-{y}": n for (y,), n in _counts(spark, staged).items()}, True)
    stats = preference_stats(months).crossJoin(months.agg(F.count_distinct("month").alias("input_files")))
    return [staged], _noted(spread(stats), "preferences").unionByName(spark.createDataFrame(checks, REPORT))


def _stage_summaries(spark, folders, root: str, aside: str, generated_at: str, strict: bool):
    read = materialise(read_summaries(spark, folders).drop("payload"), "summary-lines")
    records = parse_summaries(read)
    merged = normalise_summaries(records, generated_at)
    keys = [c for c in schemas.SUMMARY_REQUIRED if c != "id"]
    has = [F.when(F.map_contains_key("payload", F.lit(c)), F.lit("")).alias(c) for c in keys]
    merged = materialise(merged.select("id", "month", "json", *has), "summaries")
    staged = stage(
        merged.select("month", "id", F.col("json").alias("value")), "summaries", aside, f"{root}/summaries", fmt="text",
        partition_by=["month"], sort_by=["id"], drop=["id"],
    )
    checks = validate_rows(merged.withColumn("target", F.concat(F.lit("summaries-"), "month")), strict=strict)
    months = merged.groupBy(F.concat(F.lit("summaries-"), "month").alias("target")).agg(F.count("*").alias("value"))
    note = F.when(F.col("status") == "ok", F.col("status")).otherwise(F.concat_ws(": ", "status", "message"))
    checks = checks.join(months, "target").select(F.lit("validation").alias("section"), F.col("target").alias("key"), "value", note.alias("note"))
    bad = records.where("payload IS NULL").groupBy("path").agg(F.count("*").alias("value"))
    bad = bad.select(F.lit("warnings").alias("section"), F.element_at(F.split("path", "/"), -1).alias("key"), "value", F.lit("records that are not JSON").alias("note"))
    stats = read.agg(F.count_distinct("path").alias("input_files")).withColumn("records", F.lit(staged.rows))
    return [staged], reduce(DataFrame.unionByName, [_noted(spread(stats), "summaries"), checks, bad])
