"""Incremental jobs as streaming queries.

Every job takes a streaming DataFrame and returns a running StreamingQuery. State and offsets live
in `checkpoint`, results in a table; nothing is collected on the driver.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.feedback import reaction_counts, reaction_label
from ..operators.inference import BackendFactory
from ..operators.reshape import embedding_inputs
from ..operators.reports import job_metrics
from ..plans.embed import pending_inputs, vector_rows
from ..plans.ingest import upsert_metadata
from ..sources.versions import (
    BATCH, Versions, append_version, claim, compact, has_batch, newest, read_versions, stored_rows, summed, unmerged,
)
from ..sources.writers import write_vectors

AVAILABLE_NOW = {"availableNow": True}


def file_stream(
    spark: SparkSession, path: str, schema, fmt: str = "parquet", pattern: str = "*", **options
) -> DataFrame:
    """New files below `path` as a stream."""
    return (
        spark.readStream.format(fmt)
        .schema(schema)
        .option("pathGlobFilter", pattern)
        .options(**options)
        .load(path)
    )


def _start(
    df: DataFrame,
    write: Callable[[DataFrame, int], None],
    checkpoint: str,
    mode: str,
    trigger: dict,
) -> StreamingQuery:
    return (
        df.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .foreachBatch(write)
        .start()
    )


def _append(table: Versions, checkpoint: str) -> Callable[[DataFrame, int], None]:
    """Store each batch's rows as a version of the table; a replayed batch adds nothing.

    Versions are merged level by level, so the folders left grow with the logarithm of the batches.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        claim(batch.sparkSession, table.path, checkpoint)
        append_version(batch, table, batch_id)
        compact(batch.sparkSession, table)

    return write


def latest_state(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The newest stored row per key of a streaming job's result."""
    return read_versions(spark, Versions(path, newest([key])))


def stream_job_metrics(
    runs: DataFrame, path: str, checkpoint: str, trigger: dict = AVAILABLE_NOW
) -> StreamingQuery:
    """Run counts and latest outcome per job, updated as runs finish."""
    table = Versions(path, newest(["job"]))
    return _start(job_metrics(runs), _append(table, checkpoint), checkpoint, "update", trigger)


def stream_upsert(
    records: DataFrame, path: str, checkpoint: str, trigger: dict = AVAILABLE_NOW
) -> StreamingQuery:
    """Landed metadata records into the metadata table; replaying a batch changes nothing.

    The table may have other writers before and after, so batches take its next number: a replayed one is there twice
    until a compaction, with equal rows.
    """
    def write(batch: DataFrame, _: int) -> None:
        upsert_metadata(batch, path)

    return _start(records, write, checkpoint, "append", trigger)


def stream_backlog(
    meta: DataFrame,
    path: str,
    checkpoint: str,
    model: str,
    backend: str | BackendFactory,
    generated_at: str,
    trigger: dict = AVAILABLE_NOW,
) -> StreamingQuery:
    """Vectors for new metadata. Stored ids are skipped, so a replayed batch adds nothing.

    An id that tells no year does not stop the stream: it is set aside, to be read with `rejected_ids`.
    """
    def write(batch: DataFrame, _: int) -> None:
        undated = embedding_inputs(batch, strict=False).where(F.col("year").isNull())
        table = rejected_table(path, model)
        append_version(undated.select("paper_id").distinct(), table)
        compact(batch.sparkSession, table)
        todo = pending_inputs(batch, path, model, strict=False)
        write_vectors(vector_rows(todo, model, backend, generated_at), path, models=[model], only_new=True)

    return _start(meta, write, checkpoint, "append", trigger)


def rejected_table(path: str, model: str) -> Versions:
    """Ids that `stream_backlog` could not place; a folder that readers of the vectors pass over."""
    return Versions(f"{path}/_rejected/{model}", newest(["paper_id"]), (), T.StructType.fromDDL("paper_id string"))


def rejected_ids(spark: SparkSession, path: str, model: str) -> DataFrame:
    """(paper_id): metadata without a vector because its id tells no year."""
    return read_versions(spark, rejected_table(path, model))


def _day(event_time: str) -> Column:
    return F.coalesce(F.to_date(event_time).cast("string"), F.lit("none")).alias("day")


def stream_feedback(
    reactions: DataFrame,
    path: str,
    checkpoint: str,
    event_id: str = "event_id",
    event_time: str = "updated_at",
    thread: str = "thread",
    trigger: dict = AVAILABLE_NOW,
) -> StreamingQuery:
    """Reaction counts per thread, read by `feedback_state`; an event delivered twice counts once, however late.

    Nothing is kept in the state store. The events that counted lie in a table by day, and a batch is held against the days
    that it has events of: a late event costs a look at its own day, and no id has to expire. An event keeps its id, time
    and content when it is delivered again; one without an id counts each time.
    """
    kinds = reactions.select(event_id, thread, "content").schema.fields
    day = T.StructField("day", T.StringType())
    events = Versions(f"{path}/events", unmerged, ("day",), T.StructType([*kinds, day]))
    counts = feedback_counts(path, thread)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        claim(spark, path, checkpoint)
        if has_batch(spark, counts.path, batch_id):
            return
        rows = batch.select(event_id, thread, "content", _day(event_time))
        named = rows.where(F.col(event_id).isNotNull()).dropDuplicates(["day", event_id])
        known = stored_rows(spark, events)
        if known is not None:
            days = [row["day"] for row in rows.select("day").distinct().collect()]
            # A batch that got this far before must not find its own events.
            known = known.where(F.col("day").isin(days) & (F.col(BATCH) < batch_id))
            named = named.join(known.select("day", event_id), ["day", event_id], "left_anti")
        fresh = named.unionByName(rows.where(F.col(event_id).isNull()))
        append_version(fresh.select(event_id, thread, "content", "day"), events, batch_id)
        mine = stored_rows(spark, events).where(F.col(BATCH) == batch_id)
        append_version(reaction_counts(mine, thread), counts, batch_id)
        for table in (events, counts):
            compact(spark, table)

    return _start(reactions, write, checkpoint, "append", trigger)


def feedback_counts(path: str, thread: str = "thread") -> Versions:
    """The table of counts of `stream_feedback`: each batch adds its own."""
    return Versions(f"{path}/counts", summed([thread], ["likes", "dislikes"]))


def feedback_state(spark: SparkSession, path: str, thread: str = "thread") -> DataFrame:
    """Counts and label per thread so far."""
    found = read_versions(spark, feedback_counts(path, thread))
    return found.withColumn("preference", reaction_label(F.col("likes"), F.col("dislikes")))


def window_counts(path: str) -> Versions:
    """The table of counts of `stream_preference_counts`, by whether the events came late."""
    schema = T.StructType.fromDDL("window_start string, preference string, n long, latest timestamp, late boolean")
    return Versions(path, summed(["window_start", "preference", "late"], ["n"], ["latest"]), ("late",), schema)


def stream_preference_counts(
    events: DataFrame,
    path: str,
    checkpoint: str,
    event_time: str = "recorded_at",
    window: str = "1 day",
    lateness: str = "1 day",
    trigger: dict = AVAILABLE_NOW,
) -> StreamingQuery:
    """Preference events per time window and label, those that came late apart; read by `preference_windows`.

    An event is late if its time lies more than `lateness` before the latest event of earlier batches, as with a watermark,
    but it is counted instead of dropped. The latest event is stored with the counts, so a replayed batch draws the same
    line, and nothing is kept in the state store.
    """
    table = window_counts(path)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        claim(spark, path, checkpoint)
        if has_batch(spark, path, batch_id):
            return
        before = stored_rows(spark, table)
        top = before.agg(F.max("latest").cast("string").alias("top")).first()["top"] if before is not None else None
        line = F.lit(top).cast("timestamp") - F.expr(f"INTERVAL {lateness}")
        late = F.coalesce(F.col(event_time) < line, F.lit(False))
        counts = batch.groupBy(F.window(event_time, window), "preference", late.alias("late")).agg(
            F.count("*").alias("n"), F.max(event_time).alias("latest")
        )
        start = F.col("window.start").cast("string").alias("window_start")
        append_version(counts.select(start, "preference", "n", "latest", "late"), table, batch_id)
        compact(spark, table)

    return _start(events, write, checkpoint, "append", trigger)


def preference_windows(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(window_start, preference, n) of the events in time and of the late ones; together they count every event once."""
    rows = read_versions(spark, window_counts(path)).select("window_start", "preference", "n", "late")
    return rows.where("NOT late").drop("late"), rows.where("late").drop("late")
