"""Counts, statistics, metrics and validation tables.

All are plain aggregates: Spark combines them inside each map task before anything is shuffled.
"""

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import strip
from .dedup import with_total


def year_counts(df: DataFrame, year: str = "year") -> DataFrame:
    """Rows per year and in total."""
    counts = df.groupBy(F.col(year).cast("string").alias("year")).agg(F.count("*").alias("rows"))
    return with_total(counts, ["year"], ["rows"])


def preference_stats(df: DataFrame) -> DataFrame:
    """Usable rows, distinct ids among them and skipped rows of raw preference rows."""
    usable = (F.length(strip(F.col("paper_id"))) > 0) & (F.length(strip(F.col("preference"))) > 0)
    ok = F.coalesce(usable, F.lit(False))
    per_id = df.groupBy(F.when(ok, strip(F.col("paper_id"))).alias("id")).agg(
        F.count_if(ok).alias("rows"), F.count_if(~ok).alias("skipped")
    )
    return per_id.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.count("id").alias("unique_ids"),
        F.coalesce(F.sum("skipped"), F.lit(0)).alias("skipped_rows"),
    )


def window_stats(df: DataFrame, seq: str = "seq") -> DataFrame:
    """Record count and the dates of the first and last record received."""
    date = F.coalesce(F.nullif(F.col("updated_at"), F.lit("")), F.col("published_at"))
    return df.agg(
        F.count("*").alias("records"),
        F.min_by(date, F.col(seq)).alias("first_date"),
        F.max_by(date, F.col(seq)).alias("last_date"),
    )


def harvest_counts(records: DataFrame) -> DataFrame:
    """What becomes of harvested records, as one row: all of them, deleted ones, unusable ones without an id, and those kept."""
    deleted = F.coalesce(F.col("header._status") == "deleted", F.lit(False))
    usable = F.coalesce(F.length("metadata.arXiv.id") > 0, F.lit(False))
    return records.agg(
        F.count("*").alias("records"),
        F.count_if(deleted).alias("deleted"),
        F.count_if(~deleted & ~usable).alias("unusable"),
        F.count_if(~deleted & usable).alias("kept"),
    )


def line_counts(lines: DataFrame, key: str = "id") -> DataFrame:
    """Lines of JSON read with a schema, as one row: all of them, and those that are not JSON or have no `key`."""
    return lines.agg(F.count("*").alias("lines"), F.count_if(F.col(key).isNull()).alias("unusable"))


def job_metrics(runs: DataFrame) -> DataFrame:
    """Run counts and the latest outcome per job.

    `runs`: job, status (success/failure/dry_run), error, start_time, end_time, duration, seq. A run
    that starts clears the last error; a dry run does not start.
    """
    order = F.struct("end_time", "seq")
    dry = F.col("status") == "dry_run"
    started = F.when(~dry, order)
    return runs.groupBy("job").agg(
        F.count("*").alias("total_runs"),
        F.count_if(F.col("status") == "success").alias("success_count"),
        F.count_if(F.col("status") == "failure").alias("failure_count"),
        F.count_if(dry).alias("dry_run_count"),
        F.max_by("status", order).alias("last_status"),
        F.max_by(F.struct("error"), started)["error"].alias("last_error"),
        F.max_by(F.when(dry, F.col("end_time")).otherwise(F.col("start_time")), order).alias(
            "last_start_time"
        ),
        F.max_by("end_time", order).alias("last_end_time"),
        F.max_by(F.when(dry, F.lit(0.0)).otherwise(F.col("duration")), order).alias(
            "last_duration_seconds"
        ),
    )


def long_report(sections: Mapping[str, DataFrame]) -> DataFrame:
    """Reports in long form (section, key, value) from frames with `key` and `value`."""
    parts = [
        df.select(
            F.lit(name).alias("section"),
            F.col("key").cast("string").alias("key"),
            F.col("value").cast("long").alias("value"),
        )
        for name, df in sections.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def spread(df: DataFrame) -> DataFrame:
    """A one-row frame of counts as (key, value) rows."""
    pairs = F.create_map(*[x for c in df.columns for x in (F.lit(c), F.col(c).cast("long"))])
    return df.select(F.explode(pairs))


def run_manifest(
    preferred: DataFrame, background: DataFrame, scored: DataFrame, recommended: DataFrame
) -> DataFrame:
    """Row counts of a ranking run as (key, value)."""
    tables = {
        "preferred": preferred,
        "background": background,
        "scored": scored,
        "recommended": recommended,
    }
    parts = [
        df.agg(F.count("*").alias("value")).select(F.lit(name).alias("key"), "value")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def migration_report(
    metadata: DataFrame, vectors: DataFrame, preferences: DataFrame, summaries: DataFrame
) -> DataFrame:
    """Counts of a migration run in long form.

    `metadata` has a year, `vectors` model and year, `preferences` are raw monthly rows and
    `summaries` carry their `month`.
    """
    per_model = vectors.groupBy("model", "year").agg(F.count("*").alias("n"))
    model_key = F.concat_ws("/", "model", F.col("year").cast("string"))
    months = summaries.groupBy("month").agg(F.count("*").alias("n"))
    return long_report(
        {
            "metadata": year_counts(metadata).select(F.col("year").alias("key"), F.col("rows").alias("value")),
            "embeddings": per_model.select(model_key.alias("key"), F.col("n").alias("value")),
            "preferences": spread(preference_stats(preferences)),
            "summaries": spread(
                months.agg(
                    F.coalesce(F.sum("n"), F.lit(0)).alias("records"),
                    F.count("*").alias("output_files"),
                )
            ),
        }
    )


def summary_manifest(df: DataFrame, done: str = "summary") -> DataFrame:
    """Total, summarised and skipped sources of a summary run; skipped ones have no summary."""
    return df.agg(
        F.count("*").alias("total_sources"),
        F.count(done).alias("summarized"),
        F.count_if(F.col(done).isNull()).alias("skipped"),
    )


def _status(has_issue: Column, strict: bool) -> Column:
    return F.when(has_issue, F.lit("error" if strict else "warning")).otherwise(F.lit("ok"))


def validate(
    df: DataFrame, target: str, required: Sequence[str], allow_empty: bool = False, strict: bool = True
) -> DataFrame:
    """One row on whether `df` has its columns and any rows.

    Reads at most one row per task. See `raise_on_error` for the strict mode's failure.
    """
    missing = [c for c in required if c not in df.columns]
    column_issue = f"missing columns: {', '.join(missing)}" if missing else None
    probe = df.select(F.lit(1).alias("one")).limit(1).agg((F.count("*") == 0).alias("is_empty"))
    empty_issue = F.when(F.col("is_empty") & F.lit(not allow_empty), F.lit("no rows produced"))
    message = F.nullif(F.concat_ws("; ", F.lit(column_issue).cast("string"), empty_issue), F.lit(""))
    return probe.select(
        F.lit(target).alias("target"),
        _status(message.isNotNull(), strict).alias("status"),
        F.lit(", ".join(missing)).alias("missing"),
        "is_empty",
        message.alias("message"),
    )


def missing_keys(required: Sequence[str]) -> Column:
    """Names of the required columns that are null in a row, in the given order."""
    return F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]))


def row_warnings(df: DataFrame, required: Sequence[str] = schemas.SUMMARY_REQUIRED) -> DataFrame:
    """(target, id, keys) of every row that lacks required keys."""
    keys = F.array_join(missing_keys(required), ", ")
    return df.select("target", "id", keys.alias("keys")).where(F.length("keys") > 0)


def validate_rows(
    df: DataFrame, required: Sequence[str] = schemas.SUMMARY_REQUIRED, strict: bool = True
) -> DataFrame:
    """Per target: which required keys its rows lack, with the first three offenders by id.

    `df` has a `target` column; a null stands for a missing key.
    """
    gaps = [F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in required]
    names = F.array_compact(
        F.array(*[F.when(F.col(f"n_{c}") > 0, F.lit(c)) for c in sorted(required)])
    )
    summary = df.groupBy("target").agg(*gaps).select(
        "target", F.array_join(names, ", ").alias("missing")
    )
    order = Window.partitionBy("target").orderBy("id", "keys")
    preview = (
        row_warnings(df, required)
        .withColumn("rank", F.row_number().over(order))
        .where("rank <= 3")
        .withColumn("text", F.concat_ws(": ", "id", "keys"))
        .groupBy("target")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "text")))["text"].alias("texts"))
    )
    message = F.concat(F.lit("missing keys -> "), F.array_join("texts", ", "))
    return summary.join(preview, "target", "left").select(
        "target",
        _status(F.length("missing") > 0, strict).alias("status"),
        "missing",
        F.lit(False).alias("is_empty"),
        message.alias("message"),
    )


def raise_on_error(report: DataFrame) -> None:
    """Fail when a validation report has an error, naming the first one."""
    failed = report.where("status = 'error'").orderBy("target").limit(1).collect()
    if failed:
        raise ValueError(f"{failed[0]['target']} validation failed: {failed[0]['message']}")
