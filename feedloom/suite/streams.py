"""Streaming jobs run to the end of the given tables; their results must equal the batch ones."""

from pyspark.sql import functions as F

from ..plans.ingest import read_metadata_table
from ..session import scratch_path
from ..sources.versions import FAN, all_runs
from ..sources.writers import is_folder, write_vectors
from ..streaming.jobs import (
    feedback_state, file_stream, latest_state, preference_windows, rejected_ids, stream_backlog, stream_feedback,
    stream_job_metrics, stream_preference_counts, stream_upsert,
)
from . import views
from .registry import SQL, query
from .tables import metrics_columns
from .views import coded_id, coded_id_sql


class StreamSource:
    """Stands in for the session: `spark.read.parquet` becomes the streaming reader.

    A table is a folder of files, or one file, which a stream can only find by its name in the folder it lies in.
    """

    def __init__(self, spark):
        self.spark = spark
        self.read = self

    def parquet(self, path):
        schema = self.spark.read.parquet(path).schema
        if is_folder(self.spark, path):
            return file_stream(self.spark, path, schema)
        folder, name = path.rsplit("/", 1)
        return file_stream(self.spark, folder, schema, pattern=name)


def finish(job):
    job.awaitTermination()


@query(SQL["job_run_metrics"], name="stream_job_metrics")
def stream_metrics(spark, folder):
    path = scratch_path(spark, "metrics")
    runs = views.job_runs(StreamSource(spark), folder)
    finish(stream_job_metrics(runs, path, path + "-offsets"))
    return metrics_columns(latest_state(spark, path, "job"))


LANDINGS = 20


@query(f"SELECT *, true AS few_folders FROM ({SQL['job_run_metrics']})")
def stream_metrics_of_many_landings(spark, folder):
    """One micro-batch per landing; the versions of the result are merged on the way and few folders are left."""
    source, path = scratch_path(spark, "runs"), scratch_path(spark, "metrics")
    rows = views.job_runs(spark, folder)
    rows.repartition(LANDINGS).write.parquet(source)
    landed = file_stream(spark, source, rows.schema, maxFilesPerTrigger=1)
    finish(stream_job_metrics(landed, path, path + "-offsets"))
    few = len(all_runs(spark, path)) <= 3 * FAN
    return metrics_columns(latest_state(spark, path, "job")).withColumn("few_folders", F.lit(few))


@query(SQL["upsert_into_table"], name="stream_upsert")
def stream_into_table(spark, folder):
    path = scratch_path(spark, "upserts")
    finish(stream_upsert(views.versions(StreamSource(spark), folder), path, path + "-offsets"))
    return read_metadata_table(spark, path).select("paper_id", "updated_at", "year")


@query(SQL["feedback_labels"], name="stream_feedback")
def stream_labels(spark, folder):
    """Every reaction is delivered twice and counted once."""
    path = scratch_path(spark, "labels")
    rows = views.reactions(StreamSource(spark), folder).withColumnRenamed("seq", "event_id")
    rows = rows.withColumn("updated_at", F.col("updated_at").cast("timestamp"))
    twice = rows.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    finish(stream_feedback(twice, path, path + "-offsets"))
    return feedback_state(spark, path)


FIRST_LANDING, SECOND_LANDING = "2024-01-12", "2024-01-21"
LANDING_SQL = f"""CASE WHEN event_id % 20 = 0 THEN 2 WHEN ts < TIMESTAMP '{FIRST_LANDING}' THEN 0
    WHEN ts < TIMESTAMP '{SECOND_LANDING}' THEN 1 ELSE 2 END"""


def landing_of(event_id: str, time: str):
    """Events land in the order of their time, but every twentieth in the last landing."""
    at = F.col(time)
    return (
        F.when(F.col(event_id) % 20 == 0, 2)
        .when(at < F.lit(FIRST_LANDING).cast("timestamp"), 0)
        .when(at < F.lit(SECOND_LANDING).cast("timestamp"), 1)
        .otherwise(2)
    )


def land(spark, rows, name, run):
    """Write the rows landing by landing (column `landing`), and run the job on what is there after each."""
    source = scratch_path(spark, name)
    for number in range(3):
        rows.where(F.col("landing") == number).drop("landing").write.mode("append").parquet(source)
        finish(run(file_stream(spark, source, rows.drop("landing").schema)))


@query(SQL["feedback_labels"])
def stream_late_feedback(spark, folder):
    """Three landings: late events in the last one, and an event of the first again in each."""
    path = scratch_path(spark, "labels")
    rows = views.reactions(spark, folder).withColumnRenamed("seq", "event_id")
    rows = rows.withColumn("updated_at", F.col("updated_at").cast("timestamp"))
    first = landing_of("event_id", "updated_at")
    again = F.when(F.col("event_id") % 10 == 1, F.sequence(first, F.lit(2))).otherwise(F.array(first))
    land(spark, rows.withColumn("landing", F.explode(again)), "reactions", lambda rows: stream_feedback(rows, path, path + "-offsets"))
    return feedback_state(spark, path)


@query(f"""
WITH landed AS (SELECT *, {LANDING_SQL} AS landing FROM events),
lines AS (SELECT n, max(ts) - INTERVAL 1 DAY AS line FROM landed, (VALUES (1), (2)) numbers(n) WHERE landing < n GROUP BY n)
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type AS preference,
  coalesce(ts < line, false) AS late, count(*) AS n
FROM landed LEFT JOIN lines ON n = landing GROUP BY ALL""")
def stream_late_events(spark, folder):
    """Three landings: events in time and late ones are counted in tables of their own."""
    path = scratch_path(spark, "counts")
    rows = views.table(spark, folder, "events").select(
        F.col("ts").cast("timestamp").alias("recorded_at"), F.col("event_type").alias("preference"),
        landing_of("event_id", "ts").alias("landing"),
    )
    land(spark, rows, "preferences", lambda rows: stream_preference_counts(rows, path, path + "-offsets"))
    in_time, late = preference_windows(spark, path)
    return in_time.withColumn("late", F.lit(False)).unionByName(late.withColumn("late", F.lit(True)))


@query("""
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type AS preference,
  count(*) AS n FROM events GROUP BY ALL""", name="stream_preference_counts")
def stream_counts(spark, folder):
    path = scratch_path(spark, "counts")
    rows = views.table(StreamSource(spark), folder, "events").select(
        F.col("ts").cast("timestamp").alias("recorded_at"), F.col("event_type").alias("preference")
    )
    finish(stream_preference_counts(rows, path, path + "-offsets"))
    in_time, late = preference_windows(spark, path)
    return in_time.unionByName(late)


@query(f"""
SELECT source, '20' || substr(paper_id, 5, 2) AS year, paper_id FROM (
  SELECT {coded_id_sql('vec_id')} AS paper_id, 'stored' AS source FROM embeddings
  UNION ALL SELECT {coded_id_sql('doc_id')}, 'embedding' FROM documents
  WHERE doc_id NOT IN (SELECT vec_id FROM embeddings))""", name="stream_backlog")
def stream_missing_vectors(spark, folder):
    """The table starts with the given vectors; the stream adds those of all other documents."""
    path = scratch_path(spark, "vectors")
    stored = views.table(spark, folder, "embeddings").select(
        F.lit("m").alias("model"), coded_id(F.col("vec_id")).alias("paper_id"), "embedding",
        F.lit("2024").alias("generated_at"), F.lit(64).alias("model_dim"), F.lit("stored").alias("source"),
    )
    stored = stored.withColumn("year", F.concat(F.lit("20"), F.substring("paper_id", 5, 2)))
    write_vectors(stored, path)
    meta = views.papers(StreamSource(spark), folder)
    meta = meta.withColumn("paper_id", coded_id(F.col("paper_id").cast("long")))
    finish(stream_backlog(meta, path, path + "-offsets", "m", "hashing", "2025"))
    return spark.read.parquet(path).select("source", F.col("year").cast("string").alias("year"), "paper_id")


@query(f"""
SELECT 'stored' AS place, {coded_id_sql('doc_id')} AS paper_id FROM documents WHERE doc_id % 9 <> 4
UNION ALL SELECT 'rejected', 'no year ' || CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id % 9 = 4""")
def stream_backlog_of_bad_ids(spark, folder):
    """Ids that tell no year are set aside; the others get their vectors."""
    path, key = scratch_path(spark, "vectors"), F.col("paper_id").cast("long")
    meta = views.papers(StreamSource(spark), folder)
    bad = F.concat(F.lit("no year "), F.col("paper_id"))
    meta = meta.withColumn("paper_id", F.when(key % 9 == 4, bad).otherwise(coded_id(key)))
    finish(stream_backlog(meta, path, path + "-offsets", "m", "hashing", "2025"))
    stored = spark.read.parquet(path).select(F.lit("stored").alias("place"), "paper_id")
    return stored.unionByName(rejected_ids(spark, path, "m").select(F.lit("rejected").alias("place"), "paper_id"))
