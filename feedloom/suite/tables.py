"""Deduplication, upserts, vector upkeep, reshaping, reports and validation."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import schemas
from ..operators.dedup import duplicate_report, latest_snapshot, order_metadata, upsert_latest
from ..operators.files import retention_plan
from ..operators.reports import (
    job_metrics, migration_report, preference_stats, validate, validate_rows, window_stats,
)
from ..operators.reshape import (
    align_union, preference_events, reshape_metadata, union_all, unpivot_vectors,
)
from ..operators.sampling import random_id_batches
from ..operators.vectors import (
    clean_vectors, dominant_dim, length_histogram, merge_vectors, vector_manifest,
)
from ..plans.ingest import read_metadata_table, upsert_metadata
from ..plans.migrate import LegacyInputs, migrate_all, migrate_wide
from ..session import scratch_path
from ..sources.readers import read_metadata, read_year_files, with_line_numbers
from ..sources.staged import partitions
from ..sources.writers import write_table, write_vectors
from .registry import query
from .views import (
    NOW_TEXT, damaged, day, day_sql, job_runs, name_part, papers, preference_months, table, vec_a, versions,
    with_views,
)

VERSION_COLUMNS = ["paper_id", "title", "abstract", "published_at", "updated_at", "seq", "year"]


def _pick_sql(key: str, order: str) -> str:
    return f"""
SELECT {', '.join(VERSION_COLUMNS)} FROM versions
QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {order}) = 1"""


@query(with_views("versions", _pick_sql("paper_id", "updated_at DESC, seq DESC")))
def upsert_latest_version(spark, folder):
    return upsert_latest(versions(spark, folder), scope="global", tie=["seq"])


@query(with_views("versions", _pick_sql("year, paper_id", "updated_at DESC, seq DESC")))
def upsert_latest_per_year(spark, folder):
    return upsert_latest(versions(spark, folder), scope="year", tie=["seq"])


@query(with_views("versions", """
SELECT paper_id, updated_at, year FROM versions
QUALIFY row_number() OVER (PARTITION BY paper_id, year ORDER BY updated_at DESC) = 1"""))
def upsert_into_table(spark, folder):
    """The table is filled in two batches, the newer versions first; the older ones change nothing."""
    path = scratch_path(spark, "upsert")
    rows = versions(spark, folder)
    late = F.substring("updated_at", 6, 2) >= "07"
    upsert_metadata(rows.where(late), path)
    upsert_metadata(rows.where(~late), path)
    upsert_metadata(rows.where(~late), path)
    return read_metadata_table(spark, path).select("paper_id", "updated_at", "year")


@query(with_views("versions", _pick_sql("paper_id", "year DESC, updated_at DESC, title DESC, seq DESC")), name="latest_snapshot")
def latest_metadata_snapshot(spark, folder):
    rows = versions(spark, folder)
    return latest_snapshot(upsert_latest(rows, tie=["title", "seq"]))


@query(with_views("papers", "SELECT paper_id, published_at, title FROM papers ORDER BY published_at DESC, paper_id"))
def ordered_metadata(spark, folder):
    return order_metadata(papers(spark, folder)).select("paper_id", "published_at", "title")


@query(with_views("versions", """
, counted AS (SELECT CAST(year AS VARCHAR) AS year, count(*) AS rows, count(DISTINCT paper_id) AS unique_ids
  FROM versions GROUP BY year),
complete AS (SELECT * FROM counted UNION ALL
  SELECT 'total', CAST(sum(rows) AS BIGINT), CAST(sum(unique_ids) AS BIGINT) FROM counted)
SELECT year, rows, unique_ids, rows - unique_ids AS removed FROM complete"""), name="duplicate_report")
def report_duplicates(spark, folder):
    return duplicate_report(versions(spark, folder))


@query(with_views("versions", """
SELECT count(*) AS records, arg_min(updated_at, seq) AS first_date, arg_max(updated_at, seq) AS last_date
FROM versions"""))
def ingest_window_stats(spark, folder):
    return window_stats(versions(spark, folder))


@query(with_views("damaged", "SELECT len(vector) AS dim, count(*) AS rows FROM damaged GROUP BY 1"))
def vector_length_histogram(spark, folder):
    counts = length_histogram(damaged(spark, folder), "vector")
    return counts.select(F.col("dim").cast("long").alias("dim"), "rows")


@query(with_views("damaged", """
SELECT len(vector) AS dim, count(*) AS rows FROM damaged GROUP BY 1 ORDER BY rows DESC, dim DESC LIMIT 1"""))
def dominant_dimension(spark, folder):
    top = dominant_dim(damaged(spark, folder), "vector")
    return top.select(F.col("dim").cast("long").alias("dim"), "rows")


@query(with_views("damaged", "SELECT id, len(vector) AS dim FROM damaged WHERE len(vector) = 64"), name="clean_vectors")
def keep_dominant_vectors(spark, folder):
    kept = clean_vectors(damaged(spark, folder), vector="vector")
    return kept.select("id", F.size("vector").cast("long").alias("dim"))


def _vector_table(spark, folder):
    """Vectors of two models by year; `stored` and `new` overlap."""
    c = F.col("vec_id")
    return table(spark, folder, "embeddings").select(
        F.lit("m1").alias("model"),
        F.substring(day(c), 1, 4).alias("year"),
        c.cast("string").alias("paper_id"),
        "embedding",
        F.lit("2024-01-01").alias("generated_at"),
        F.size("embedding").alias("model_dim"),
        F.lit("stored").alias("source"),
        "label",
    )


MERGED_SQL = f"""
SELECT {day_sql('vec_id')}[1:4] AS year, CAST(vec_id AS VARCHAR) AS paper_id,
  CASE WHEN label <= 6 THEN 64 ELSE 16 END AS dim, CASE WHEN label <= 6 THEN 'stored' ELSE 'new' END AS source
FROM embeddings"""


def _stored_and_new(spark, folder):
    rows = _vector_table(spark, folder)
    new = rows.withColumns(
        {"embedding": F.slice("embedding", 1, 16), "source": F.lit("new"), "model_dim": F.lit(16)}
    )
    return rows.where("label <= 6").drop("label"), new.where("label >= 4").drop("label")


@query(MERGED_SQL)
def merge_embeddings_existing_wins(spark, folder):
    stored, new = _stored_and_new(spark, folder)
    merged = merge_vectors(stored.drop("model"), new.drop("model"))
    return merged.select("year", "paper_id", F.size("embedding").cast("int").alias("dim"), "source")


@query(MERGED_SQL)
def store_missing_vectors(spark, folder):
    """The same merge through the stored table: only vectors it lacks are appended."""
    path = scratch_path(spark, "vectors")
    stored, new = _stored_and_new(spark, folder)
    write_vectors(stored, path)
    write_vectors(new, path)
    write_vectors(new, path)
    rows = spark.read.parquet(path)
    return rows.select(
        F.col("year").cast("string").alias("year"), "paper_id",
        F.size("embedding").cast("int").alias("dim"), "source",
    )


@query(f"""
WITH rows AS (SELECT 'm1' AS model, {day_sql('vec_id')}[1:4] AS year, len(embedding) AS dim FROM embeddings
  UNION ALL SELECT 'm2', {day_sql('vec_id')}[1:4], 16 FROM embeddings)
SELECT model, year, count(*) AS rows, max(dim) AS dimension FROM rows GROUP BY model, year
UNION ALL SELECT model, 'total', count(*), max(dim) FROM rows GROUP BY model""")
def embedding_manifest(spark, folder):
    rows = _vector_table(spark, folder)
    second = rows.withColumns({"model": F.lit("m2"), "embedding": F.slice("embedding", 1, 16)})
    manifest = vector_manifest(rows.unionByName(second))
    return manifest.withColumn("dimension", F.col("dimension").cast("long"))


@query("""
SELECT CAST(vec_id AS VARCHAR) AS paper_id, CAST(n AS INTEGER) AS batch FROM (
  SELECT vec_id, n, row_number() OVER (PARTITION BY n ORDER BY
    md5('7:' || CAST(n AS VARCHAR) || ':' || CAST(vec_id AS VARCHAR))) AS place
  FROM embeddings, range(4) AS batches(n)) WHERE place <= 32""", name="random_id_batches")
def draw_id_batches(spark, folder):
    ids = vec_a(spark, folder).withColumnRenamed("id", "paper_id")
    return random_id_batches(ids, 4, 32, 7)


@query("""
SELECT CAST(doc_id AS VARCHAR) AS paper_id, CAST(n AS INTEGER) AS batch FROM (
  SELECT doc_id, n, row_number() OVER (PARTITION BY n ORDER BY
    md5('8:' || CAST(n AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR))) AS place
  FROM documents, range(100) AS batches(n)) WHERE place <= 50""")
def hundred_id_batches(spark, folder):
    """Every id comes twice; all batches are drawn in the same passes."""
    ids = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("paper_id"))
    return random_id_batches(ids.union(ids), 100, 50, 8)


def wide(spark, folder):
    """A yearly record with both models' vectors as columns, for the ids that have vectors."""
    docs = table(spark, folder, "documents")
    c = F.col("doc_id")
    vectors = table(spark, folder, "embeddings").withColumnRenamed("vec_id", "doc_id")
    return docs.join(vectors, "doc_id", "left").select(
        c.cast("string").alias("id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("abstract"),
        F.array("source", "lang").alias("categories"),
        F.when(c % 5 > 0, F.array("lang", F.lit("a b"))).alias("authors"),
        day(c).alias("created"),
        day(c, "2025-01-01").alias("updated"),
        F.substring(day(c), 1, 4).alias("year"),
        F.col("embedding").alias("m1"),
        F.slice("embedding", 1, 16).alias("m2"),
    )


@query(f"""
SELECT CAST(doc_id AS VARCHAR) AS paper_id, split_part(text, chr(10), 1) AS title,
  md5(text) AS abstract_md5, source || ';' || lang AS categories, source AS primary_category,
  CASE WHEN doc_id % 5 > 0 THEN lang || ';a b' ELSE '' END AS authors,
  {day_sql('doc_id')} AS published_at, {day_sql('doc_id', '2025-01-01')} AS updated_at,
  '' AS doi, 'legacy_migration' AS source FROM documents""")
def reshape_wide_metadata(spark, folder):
    return reshape_metadata(wide(spark, folder)).select(
        "paper_id", "title", F.md5(F.col("abstract").cast("binary")).alias("abstract_md5"),
        "categories", "primary_category", "authors", "published_at", "updated_at", "doi", "source",
    )


@query(f"""
SELECT model, CAST(doc_id AS VARCHAR) AS paper_id, dim AS model_dim, CAST(head AS DOUBLE) AS head,
  {day_sql('doc_id', '2025-01-01')} AS generated_at, 'hf:set' AS source FROM (
  SELECT doc_id, 'm1' AS model, len(embedding) AS dim, embedding[1] AS head FROM documents
    LEFT JOIN embeddings ON vec_id = doc_id
  UNION ALL SELECT doc_id, 'm2', len(embedding[1:16]), embedding[1] FROM documents
    LEFT JOIN embeddings ON vec_id = doc_id)""", name="unpivot_vectors")
def unpivot_model_vectors(spark, folder):
    rows = unpivot_vectors(wide(spark, folder), ["m1", "m2", "m1", "absent"], "hf:set")
    return rows.select(
        "model", "paper_id", F.col("model_dim").cast("long").alias("model_dim"),
        F.get("embedding", F.lit(0)).cast("double").alias("head"), "generated_at", "source",
    )


EVENTS_SQL = f"""
, usable AS (SELECT trim(paper_id) AS paper_id, trim(preference) AS preference, month
  FROM preference_months WHERE trim(paper_id) <> ''),
events AS (SELECT paper_id, preference, month AS source_month,
  CASE WHEN regexp_matches(month, '^\\d{{4}}-\\d{{2}}') THEN month || '-01T00:00:00+00:00' ELSE '{NOW_TEXT}' END
    AS recorded_at,
  CASE WHEN regexp_matches(month, '^\\d{{4}}-\\d{{2}}') THEN substr(month, 1, 4) ELSE 'unknown' END AS year
  FROM usable)"""


@query(with_views("preference_months", EVENTS_SQL + """
SELECT paper_id, preference, recorded_at, source_month, year FROM events"""))
def preference_events_by_month(spark, folder):
    return preference_events(preference_months(spark, folder), NOW_TEXT)


@query(with_views("preference_months", EVENTS_SQL + """
SELECT count(*) AS rows, count(DISTINCT paper_id) AS unique_ids,
  (SELECT count(*) FROM preference_months) - count(*) AS skipped_rows FROM events"""), name="preference_stats")
def preference_statistics(spark, folder):
    return preference_stats(preference_months(spark, folder))


@query(with_views("job_runs", """
SELECT job, count(*) AS total_runs, CAST(count_if(status = 'success') AS BIGINT) AS success_count,
  CAST(count_if(status = 'failure') AS BIGINT) AS failure_count, CAST(count_if(status = 'dry_run') AS BIGINT) AS dry_run_count,
  arg_max(status, (end_time, seq)) AS last_status,
  arg_max([error], (end_time, seq)) FILTER (status <> 'dry_run')[1] AS last_error,
  strftime(max(end_time), '%Y-%m-%d %H:%M:%S') AS last_end_time,
  arg_max(CASE WHEN status = 'dry_run' THEN 0.0 ELSE duration END, (end_time, seq)) AS last_duration_seconds
FROM job_runs GROUP BY job"""))
def job_run_metrics(spark, folder):
    return metrics_columns(job_metrics(job_runs(spark, folder)))


def metrics_columns(metrics):
    return metrics.select(
        "job", "total_runs", "success_count", "failure_count", "dry_run_count", "last_status",
        "last_error", F.date_format("last_end_time", "yyyy-MM-dd HH:mm:ss").alias("last_end_time"),
        "last_duration_seconds",
    )


@query("""
SELECT o_orderstatus AS dataset, CAST(o_orderkey AS VARCHAR) AS path FROM orders
QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR) DESC) > 20""", name="retention_plan")
def plan_retention(spark, folder):
    archives = table(spark, folder, "orders").select(
        F.col("o_orderstatus").alias("dataset"), F.col("o_orderdate").alias("modified"),
        F.col("o_orderkey").cast("string").alias("path"),
    )
    return retention_plan(archives, 20).select("dataset", "path")


@query("""
SELECT CAST(s_suppkey AS VARCHAR) AS id, CAST(s_acctbal AS DOUBLE) AS amount, s_name AS name FROM supplier
UNION ALL SELECT CAST(c_custkey AS VARCHAR), c_acctbal, c_name FROM customer
UNION ALL SELECT CAST(p_partkey AS VARCHAR), CAST(p_size AS DOUBLE), p_name FROM part""", name="union_all")
def union_with_casts(spark, folder):
    """Rows of three tables whose column types differ, cast to the first one's."""
    def pick(name, key, amount, label):
        return table(spark, folder, name).select(
            F.col(key).alias("id"), F.col(amount).alias("amount"), F.col(label).alias("name")
        )

    first = pick("supplier", "s_suppkey", "s_acctbal", "s_name")
    target = first.withColumn("id", F.col("id").cast("string")).schema
    return union_all(
        first, pick("customer", "c_custkey", "c_acctbal", "c_name"),
        pick("part", "p_partkey", "p_size", "p_name"), schema=target,
    )


@query("""
SELECT CAST(vec_id AS VARCHAR) AS paper_id, CAST(NULL AS INTEGER) AS label, 'now' AS generated_at, 64 AS model_dim,
  'default' AS source FROM embeddings
UNION ALL SELECT CAST(vec_id AS VARCHAR), label, 'today', 16, 'default' FROM embeddings""")
def align_and_union(spark, folder):
    rows = table(spark, folder, "embeddings")
    old = rows.select(F.col("vec_id").cast("string").alias("paper_id"))
    new = rows.select(
        F.col("vec_id").cast("string").alias("paper_id"), "label",
        F.lit("today").alias("generated_at"), F.lit(16).alias("model_dim"),
    ).withColumn("source", F.lit("default"))
    defaults = {
        "generated_at": F.lit("now"), "model_dim": F.lit(64), "source": F.lit("default")
    }
    return align_union(old, new, defaults)


@query("""
SELECT 'papers' AS target, CASE WHEN count(*) = 0 THEN 'warning' ELSE 'ok' END AS status, '' AS missing,
  count(*) = 0 AS is_empty, CAST(NULL AS VARCHAR) AS message FROM documents
UNION ALL SELECT 'labels', 'warning', 'source, text', count(*) = 0, 'missing columns: source, text' FROM labels
UNION ALL SELECT 'none', 'error', '', count(*) = 0, 'no rows produced' FROM documents WHERE n_chars < 0""", name="validate_frame")
def validate_tables(spark, folder):
    docs = table(spark, folder, "documents")
    checks = [
        validate(docs, "papers", ["doc_id", "text"], strict=False),
        validate(table(spark, folder, "labels"), "labels", ["source", "doc_id", "text"], strict=False),
        validate(docs.where("n_chars < 0"), "none", ["doc_id"]),
    ]
    return checks[0].unionByName(checks[1]).unionByName(checks[2])


GAPS_SQL = """WITH rows AS (
  SELECT role AS target, lpad(CAST(conv_id AS VARCHAR), 12, '0') || '/' || CAST(turn AS VARCHAR) AS id,
    CASE WHEN turn = 3 AND role = 'assistant' THEN NULL ELSE text END AS summary,
    CASE WHEN turn = 2 AND role = 'user' THEN NULL ELSE 'x' END AS summary_time,
    CASE WHEN turn IN (2, 4) AND role = 'user' THEN NULL ELSE 'x' END AS source_file FROM conversations),
gaps AS (SELECT target, id, concat_ws(', ', CASE WHEN summary IS NULL THEN 'summary' END,
  CASE WHEN summary_time IS NULL THEN 'summary_time' END,
  CASE WHEN source_file IS NULL THEN 'source_file' END) AS keys FROM rows),
ranked AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY id) AS place FROM gaps WHERE keys <> ''),
preview AS (SELECT target, string_agg(id || ': ' || keys, ', ' ORDER BY place) AS texts FROM ranked
  WHERE place <= 3 GROUP BY target)
SELECT r.target, CASE WHEN p.texts IS NULL THEN 'ok' ELSE 'warning' END AS status,
  concat_ws(', ', CASE WHEN bool_or(source_file IS NULL) THEN 'source_file' END,
    CASE WHEN bool_or(summary IS NULL) THEN 'summary' END,
    CASE WHEN bool_or(summary_time IS NULL) THEN 'summary_time' END) AS missing, false AS is_empty,
  'missing keys -> ' || p.texts AS message
FROM rows r LEFT JOIN preview p USING (target) GROUP BY r.target, p.texts"""


@query(GAPS_SQL, name="validate_rows")
def validate_summary_rows(spark, folder):
    turn, role = F.col("turn"), F.col("role")

    def gap(when, value):
        return F.when(~when, value)

    rows = table(spark, folder, "conversations").select(
        role.alias("target"),
        F.concat(
            F.lpad(F.col("conv_id").cast("string"), 12, "0"), F.lit("/"), turn.cast("string")
        ).alias("id"),
        gap((turn == 3) & (role == "assistant"), F.col("text")).alias("summary"),
        gap((turn == 2) & (role == "user"), F.lit("x")).alias("summary_time"),
        gap(turn.isin(2, 4) & (role == "user"), F.lit("x")).alias("source_file"),
        F.lit("x").alias("migrated_at"), F.lit("x").alias("source"),
    )
    return validate_rows(rows, schemas.SUMMARY_REQUIRED, strict=False)


@query(with_views("preference_months", EVENTS_SQL + f"""
, meta AS (SELECT {day_sql('doc_id')}[1:4] AS year FROM documents),
vectors AS (SELECT {day_sql('vec_id')}[1:4] AS year FROM embeddings),
months AS (SELECT CAST(turn AS VARCHAR) AS month, count(*) AS n FROM conversations GROUP BY 1)
SELECT 'metadata' AS section, year AS key, count(*) AS value FROM meta GROUP BY year
UNION ALL SELECT 'metadata', 'total', count(*) FROM meta
UNION ALL SELECT 'embeddings', 'm1/' || year, count(*) FROM vectors GROUP BY year
UNION ALL SELECT 'preferences', 'rows', count(*) FROM events
UNION ALL SELECT 'preferences', 'unique_ids', count(DISTINCT paper_id) FROM events
UNION ALL SELECT 'preferences', 'skipped_rows', (SELECT count(*) FROM preference_months) - count(*) FROM events
UNION ALL SELECT 'summaries', 'records', CAST(sum(n) AS BIGINT) FROM months
UNION ALL SELECT 'summaries', 'output_files', count(*) FROM months"""), name="migration_report")
def report_migration(spark, folder):
    docs = table(spark, folder, "documents").select(
        F.substring(day(F.col("doc_id")), 1, 4).alias("year")
    )
    months = table(spark, folder, "conversations").select(F.col("turn").cast("string").alias("month"))
    return migration_report(
        docs, _vector_table(spark, folder), preference_months(spark, folder), months
    )


@query(f"""
WITH wide AS (SELECT {day_sql('doc_id')}[1:4] AS year, CAST(doc_id AS VARCHAR) AS paper_id, text, embedding
  FROM documents LEFT JOIN embeddings ON vec_id = doc_id)
SELECT 'metadata' AS part, year, paper_id, md5(text) AS detail FROM wide
UNION ALL SELECT 'm1', year, paper_id, CAST(len(embedding) AS VARCHAR) FROM wide
UNION ALL SELECT 'm2', year, paper_id, CAST(len(embedding[1:16]) AS VARCHAR) FROM wide
UNION ALL SELECT 'latest', 'all', paper_id, split_part(text, chr(10), 1) FROM wide""")
def migrate_wide_years(spark, folder):
    """Yearly wide files, read by name, through the whole migration; what is stored is read back."""
    root = scratch_path(spark, "migration")
    rows = wide(spark, folder)
    for year in ("2024", "2025"):
        rows.where(F.col("year") == year).drop("year").write.parquet(f"{root}/in/{year}.parquet")
    migrate_wide(read_year_files(spark, f"{root}/in"), f"{root}/out", ["m1", "m2", "absent"])
    year = F.col("year").cast("string").alias("year")
    stored, vectors = (spark.read.parquet(f"{root}/out/{name}") for name in ("metadata", "embeddings"))
    latest = read_metadata(spark, f"{root}/out/latest")
    parts = [
        stored.select(F.lit("metadata").alias("part"), year, "paper_id", F.md5(F.col("abstract").cast("binary")).alias("detail")),
        vectors.select("model", year, "paper_id", F.col("model_dim").cast("string")),
        latest.select(F.lit("latest"), F.lit("all"), "paper_id", "title"),
    ]
    return parts[0].union(parts[1]).union(parts[2])


@query(with_views("preference_months", EVENTS_SQL + f"""
, wide AS (SELECT {day_sql('doc_id')}[1:4] AS year FROM documents),
years AS (SELECT year, count(*) AS n FROM wide GROUP BY year),
shares AS (SELECT year AS part, count(*) AS n FROM events GROUP BY year),
lines AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN 'unknown' ELSE '2024-0' || CAST(1 + turn % 5 AS VARCHAR) END AS month,
  conv_id % 10 = 9 AS bad FROM conversations),
kept AS (SELECT month FROM lines WHERE NOT bad QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1),
months AS (SELECT month, count(*) AS n FROM kept GROUP BY month),
counts AS (
  SELECT 'metadata' AS section, year AS key, n AS value, NULL AS note FROM years
  UNION ALL SELECT 'metadata', 'total', CAST(sum(n) AS BIGINT), NULL FROM years
  UNION ALL SELECT 'embeddings', m || '/' || year, n, NULL FROM years, (VALUES ('m1'), ('m2')) models(m)
  UNION ALL SELECT 'metadata', f || '_files', count(*), NULL FROM years, (VALUES ('input'), ('output')) kinds(f) GROUP BY f
  UNION ALL SELECT 'embeddings', 'output_files', count(*) * 2, NULL FROM years
  UNION ALL SELECT 'preferences', 'rows', count(*), NULL FROM events
  UNION ALL SELECT 'preferences', 'unique_ids', count(DISTINCT paper_id), NULL FROM events
  UNION ALL SELECT 'preferences', 'skipped_rows', (SELECT count(*) FROM preference_months) - count(*), NULL FROM events
  UNION ALL SELECT 'preferences', 'input_files', count(DISTINCT month), NULL FROM preference_months
  UNION ALL SELECT 'preferences', 'output_files', count(*), NULL FROM shares
  UNION ALL SELECT 'summaries', 'records', CAST(sum(n) AS BIGINT), NULL FROM months
  UNION ALL SELECT 'summaries', 'input_files', 1, NULL FROM range(1)
  UNION ALL SELECT 'summaries', 'output_files', count(*), NULL FROM months
  UNION ALL SELECT 'validation', 'metadata-' || year, n, 'ok' FROM years
  UNION ALL SELECT 'validation', 'embeddings-' || m || '-' || year, n, 'ok' FROM years, (VALUES ('m1'), ('m2')) models(m)
  UNION ALL SELECT 'validation', 'preferences-' || part, n, 'ok' FROM shares
  UNION ALL SELECT 'validation', 'summaries-' || month, n, 'ok' FROM months
  UNION ALL SELECT 'warnings', 'embeddings-absent-' || year, 1, 'no vector column' FROM years
  UNION ALL SELECT 'warnings', 'all.jsonl', count(*), 'records that are not JSON' FROM lines WHERE bad HAVING count(*) > 0
  UNION ALL SELECT 'warnings', 'embeddings', count(*), 'rows without ' || c FROM documents, (VALUES ('embedding'), ('model_dim')) gaps(c)
    WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) GROUP BY c HAVING count(*) > 0)
SELECT section, key, CAST(CASE WHEN section = 'warnings' AND key = 'embeddings' THEN value * 2 ELSE value END AS BIGINT) AS value, note
FROM counts"""))
def migrate_everything(spark, folder):
    """Wide years, preference months and summary lines through one migration; its report has the log, warnings and counts."""
    root = scratch_path(spark, "migration")
    rows = wide(spark, folder)
    for year in sorted(row["year"] for row in rows.select("year").distinct().collect()):
        rows.where(F.col("year") == year).drop("year").write.parquet(f"{root}/in/{year}.parquet")
    months = preference_months(spark, folder).withColumnRenamed("paper_id", "id").repartition("month")
    write_table(months, f"{root}/by-month", fmt="csv", partition_by=["month"])
    for part in partitions(spark, f"{root}/by-month", 1):
        name_part(spark, f"{root}/by-month/{part}", f"{root}/months/{part.removeprefix('month=')}.csv")
    turn = F.col("turn")
    stamp = F.when(turn % 5 == 4, "").otherwise(F.concat(F.lit("2024-0"), (1 + turn % 5).cast("string"), F.lit("-02T00:00:00Z")))
    record = F.to_json(F.struct(F.col("conv_id").cast("string").alias("id"), F.col("text").alias("summary"), stamp.alias("summary_time")))
    lines = table(spark, folder, "conversations").orderBy("conv_id", "turn")
    value = F.when(F.col("conv_id") % 10 == 9, "not JSON").otherwise(record)
    lines.select(value.alias("value")).coalesce(1).write.text(f"{root}/lines")
    name_part(spark, f"{root}/lines", f"{root}/summaries/all.jsonl")
    inputs = LegacyInputs(f"{root}/in", f"{root}/months", [(f"{root}/summaries", "raw")], models=["m1", "m2", "absent"])
    return migrate_all(spark, inputs, f"{root}/out", NOW_TEXT).report


GUARDED_SQL = """
WITH rows AS (SELECT lpad(CAST(o_orderkey % 12 AS VARCHAR), 1 + CAST(o_orderkey % 2 AS INTEGER), '0') AS part, o_orderkey FROM orders)
SELECT part, count(*) AS rows, CAST(sum(CASE WHEN o_orderkey % 12 < 6 THEN 1 ELSE 10 END) AS BIGINT) AS marks FROM rows GROUP BY part"""


@query(GUARDED_SQL)
def write_missing_partitions(spark, folder):
    """A second write adds the partitions that the table lacks and leaves the others; values such as 05 are text."""
    path, key = scratch_path(spark, "guarded"), F.col("o_orderkey")
    part = F.lpad((key % 12).cast("string"), F.lit(1) + (key % 2).cast("int"), F.lit("0")).alias("part")
    rows = table(spark, folder, "orders").select(part, key)
    write_table(rows.where(key % 12 < 6).withColumn("mark", F.lit(1)), path, partition_by=["part"])
    for _ in range(2):
        write_table(rows.withColumn("mark", F.lit(10)), path, partition_by=["part"])
    stored = spark.read.schema("o_orderkey long, mark int, part string").parquet(path)
    return stored.groupBy("part").agg(F.count("*").alias("rows"), F.sum("mark").alias("marks"))


@query(f"""
WITH rows AS (SELECT *, {day_sql('doc_id')}[1:4] AS year FROM documents LEFT JOIN embeddings ON vec_id = doc_id)
SELECT year, CAST(doc_id AS VARCHAR) AS id, year = '2025' AND vec_id IS NOT NULL AS has_new,
  round(CAST(embedding[1] AS DOUBLE), 6) AS head, CASE WHEN year = '2024' THEN CAST(doc_id AS VARCHAR) END AS old_only FROM rows""")
def read_years_of_other_schemas(spark, folder):
    """Yearly wide files that differ: a model only one year has, a column only the other has, floats and doubles."""
    root = scratch_path(spark, "years")
    rows = wide(spark, folder)
    first = rows.where("year = '2024'").withColumn("old_only", F.col("id")).withColumn("m1", F.col("m1").cast("array<float>"))
    first.drop("year", "m2").write.parquet(f"{root}/2024.parquet")
    rows.where("year = '2025'").withColumn("m1", F.col("m1").cast("array<double>")).drop("year").write.parquet(f"{root}/2025.parquet")
    read = read_year_files(spark, root)
    head = F.round(F.get("m1", F.lit(0)), 6).alias("head")
    return read.select("year", "id", F.col("m2").isNotNull().alias("has_new"), head, "old_only")


@query(with_views("papers", """
SELECT CAST(row_number() OVER (ORDER BY published_at, paper_id) AS BIGINT) + 1 AS line, paper_id FROM papers"""))
def snapshot_order(spark, folder):
    """The snapshot that a migration stores lists the oldest publication first; places are read back from its lines."""
    root = scratch_path(spark, "snapshot")
    rows = papers(spark, folder).select(
        F.col("paper_id").alias("id"), F.lit("t").alias("title"), F.lit("a").alias("abstract"), F.array(F.lit("c")).alias("categories"),
        F.array(F.lit("x")).alias("authors"), F.col("published_at").alias("created"), F.col("updated_at").alias("updated"),
    )
    rows.write.parquet(f"{root}/in/2024.parquet")
    migrate_all(spark, LegacyInputs(f"{root}/in"), f"{root}/out", NOW_TEXT)
    files = spark.read.option("pathGlobFilter", "*.csv").text(f"{root}/out/latest")
    lines = with_line_numbers(files).withColumn("file", F.element_at(F.split("path", "/"), -1))
    # Files are in order too, each with a header line of its own.
    before = lines.groupBy("file").agg((F.count("*") - 1).alias("n"))
    places = before.withColumn("skip", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    named = lines.where("line > 1").join(places, "file")
    return named.select((F.col("line") + F.col("skip")).alias("line"), F.split_part("value", F.lit(","), F.lit(1)).alias("paper_id"))
