"""Deduplication, upserts, vectors, reshaping, reports, validation, files."""

import os

import pytest
from conftest import rows
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from feedloom import schemas
from feedloom.operators.candidates import (
    drop_known, embedding_backlog, filter_date_window, filter_year, join_vectors, limit_ordered,
    lookup_by_id, split_candidates,
)
from feedloom.operators.summaries import order_summary_columns
from feedloom.operators.dedup import (
    duplicate_report, keep_first, keep_latest_any, order_metadata, upsert_latest,
)
from feedloom.operators.files import exclude_globs, file_manifest, latest_run, retention_plan
from feedloom.operators.reports import (
    job_metrics, preference_stats, raise_on_error, validate, validate_rows, window_stats, year_counts,
)
from feedloom.operators.reshape import (
    align_union, detect_vector_columns, embedding_inputs, missing_models, normalise_schema,
    preference_events, reshape_metadata, split_by_year, unpivot_vectors,
)
from feedloom.operators.vectors import clean_vectors, dominant_dim, merge_vectors, vector_manifest
from feedloom.plans.ingest import deduplicate_table, read_metadata_table, upsert_metadata
from feedloom.plans.vectors import clean_stored_vectors
from feedloom.sources.readers import list_files
from feedloom.sources.writers import write_table, write_vectors


def meta(spark, items):
    """Metadata rows of (id, published, updated, comment)."""
    df = spark.createDataFrame(items, "paper_id string, published_at string, updated_at string, comment string")
    return normalise_schema(df)


def test_later_update_wins(spark, folder):
    upsert_metadata(meta(spark, [("2302.11801", "2023-01-01", "2023-01-01", "old")]), folder)
    upsert_metadata(meta(spark, [("2302.11801", "2023-01-01", "2023-01-05", "new")]), folder)
    upsert_metadata(meta(spark, [("2302.11801", "2023-01-01", "2023-01-02", "late")]), folder)
    assert rows(read_metadata_table(spark, folder), "paper_id", "comment") == [("2302.11801", "new")]


def test_upsert_is_repeatable(spark, folder):
    upsert_metadata(meta(spark, [("a", "2022-01-01", "1", ""), ("b", "2023-01-01", "1", "")]), folder)
    batch = meta(spark, [("b", "2023-01-01", "1", "again"), ("c", "bad", "1", "")])
    rejected = upsert_metadata(batch, folder)
    upsert_metadata(batch, folder)
    assert rows(read_metadata_table(spark, folder), "paper_id", "comment") == [("a", ""), ("b", "again")]
    assert rows(rejected, "paper_id") == [("c",)]


def test_deduplicate_table(spark, folder):
    items = [
        ("1", "2023-01-01", "2023-01-01", "old"), ("1", "2023-01-01", "2023-01-02", "new"),
        ("2", "2023-01-01", "2023-01-02", ""),
    ]
    meta(spark, items).withColumn("year", F.lit(2023)).write.mode("append").partitionBy("year").parquet(folder)
    report = deduplicate_table(spark, folder)
    assert rows(report, "year", "removed") == [("2023", 1), ("total", 1)]
    assert rows(spark.read.parquet(folder), "paper_id", "comment") == [("1", "new"), ("2", "")]
    assert rows(deduplicate_table(spark, folder).where("removed > 0")) == []


def test_scope_of_an_upsert(spark):
    df = meta(spark, [("a", "2022-01-01", "1", ""), ("a", "2023-01-01", "2", "")])
    accepted, _ = split_by_year(df)
    assert upsert_latest(accepted).count() == 2
    assert rows(upsert_latest(accepted, scope="global"), "year") == [(2023,)]
    with pytest.raises(ValueError):
        upsert_latest(accepted, scope="month")


def test_one_key_with_a_third_of_all_rows(spark):
    """The hot key is cut to one row per task before the shuffle."""
    df = spark.range(0, 30000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"),
        F.col("id").alias("v"),
    )
    latest = keep_latest_any(df, "k", ["v"])
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert latest.where("k = 'hot'").first()["v"] == 29997 and latest.count() == 20001
    assert keep_first(df, "k", ["v"]).where("k = 'hot'").first()["v"] == 0


def test_hot_ids_do_not_multiply_in_joins(spark):
    hot = spark.range(2000).select(F.lit("h").alias("id"), F.array(F.col("id").cast("float")).alias("v"))
    left = spark.range(2000).select(F.lit("h").alias("id"), F.col("id").cast("string").alias("updated"))
    assert join_vectors(left, {"v": hot}).count() == 1


def test_order_puts_missing_dates_last(spark):
    df = meta(spark, [("b", "2023", "", ""), ("a", "2023", "", ""), ("c", None, "", ""), ("d", "2024", "", "")])
    assert [r.paper_id for r in order_metadata(df).select("paper_id").collect()] == ["d", "a", "b", "c"]


def test_reports(spark):
    df = meta(spark, [("1", "2023-01", "u1", ""), ("1", "2023-02", "u2", ""), ("2", "2024", "", "")])
    accepted, _ = split_by_year(df)
    assert rows(year_counts(accepted)) == [("2023", 2), ("2024", 1), ("total", 3)]
    assert rows(duplicate_report(accepted)) == [("2023", 2, 1, 1), ("2024", 1, 1, 0), ("total", 3, 2, 1)]
    stats = window_stats(df.withColumn("seq", F.length("paper_id") + F.ascii("paper_id")))
    assert stats.first()["records"] == 3 and stats.first()["last_date"] == "2024"


def test_preference_months(spark):
    items = [
        ("memo-111", "like", "2024-01"), ("memo-112", "skip", "2024-01"), ("", "ignored", "2024-01"),
        ("memo-111", "love", "2024-02"), (" memo-113 ", "star", "2024-02"),
    ]
    df = spark.createDataFrame(items, "paper_id string, preference string, month string")
    events = preference_events(df, "now")
    assert rows(events.groupBy("recorded_at").count()) == [
        ("2024-01-01T00:00:00+00:00", 2), ("2024-02-01T00:00:00+00:00", 2)
    ]
    assert rows(preference_stats(df)) == [(4, 3, 1)]


def test_candidate_filters(spark):
    df = spark.createDataFrame(
        [("a", "2025-01-31"), ("b", "2025-01-31T10:00"), ("c", "2024-12-31"), ("d", "x"), ("e", "")],
        "id string, updated string",
    )
    from datetime import datetime

    now = datetime(2025, 2, 1)
    assert rows(filter_date_window(df, "2025-01-01", "2025-01-31", 1, now), "id") == [("a",)]
    assert rows(filter_date_window(df, "2025-01-01", None, 1, now), "id") == [("a",), ("b",), ("d",)]
    assert rows(filter_year(df, 2025), "id") == [("a",), ("b",)]
    assert filter_year(df, None).count() == 5


def test_split_and_known(spark):
    cands = spark.createDataFrame([("a",), ("b",), (None,)], "id string")
    prefs = spark.createDataFrame(
        [("a", "like", "1"), ("a", None, "2"), (None, "like", "1")],
        "id string, preference string, recorded_at string",
    )
    preferred, background = split_candidates(cands, prefs)
    assert rows(preferred) == [("a", None)]
    assert rows(background) == [("b", "unrated")]
    assert rows(drop_known(cands, prefs)) == [("b",)]


def test_backlog(spark):
    items = [("2401.00001", "Title", "Abstract"), ("2401.00002", "Another", "Summary"), ("", "x", "y")]
    inputs = embedding_inputs(spark.createDataFrame(items, "paper_id string, title string, abstract string"))
    stored = spark.createDataFrame([("2024", "2401.00001")], "year string, paper_id string")
    assert rows(embedding_backlog(inputs, stored), "text", "year") == [("Another\n\nSummary", "2024")]


def test_input_without_year_is_an_error(spark):
    df = spark.createDataFrame([("junk", "t", "a", "/x/2020/f.csv")], "paper_id string, title string, abstract string, p string")
    assert embedding_inputs(df, F.col("p")).first()["year"] == "2020"
    with pytest.raises(PySparkException, match="junk"):
        embedding_inputs(df).collect()


def vectors(spark, items):
    return spark.createDataFrame(
        [("m", y, i, v, "t", len(v), s) for y, i, v, s in items],
        "model string, year string, paper_id string, embedding array<float>, generated_at string, "
        "model_dim int, source string",
    )


def test_stored_vectors_win_unless_overwritten(spark, folder):
    old = vectors(spark, [("2024", "a", [1.0], "old"), ("2024", "b", [1.0], "old"), ("2023", "c", [1.0], "old")])
    new = vectors(spark, [("2024", "a", [2.0], "new"), ("2024", "d", [2.0], "new"), ("2024", "d", [3.0], "new")])
    write_vectors(old, folder)
    write_vectors(new, folder)
    got = rows(spark.read.parquet(folder), "paper_id", "source")
    assert got == [("a", "old"), ("b", "old"), ("c", "old"), ("d", "new")]
    assert rows(merge_vectors(old.drop("model"), new.drop("model")), "paper_id", "source") == got
    with pytest.raises(ValueError, match="allow_truncate"):
        write_vectors(new, folder, overwrite=True, limited=True)
    write_vectors(new, folder, overwrite=True, limited=True, allow_truncate=True)
    replaced = rows(spark.read.parquet(folder), "paper_id", "source")
    assert replaced == [("a", "new"), ("c", "old"), ("d", "new")]
    assert rows(merge_vectors(old.drop("model"), new.drop("model"), overwrite=True), "paper_id", "source") == replaced


def test_vector_upkeep(spark):
    df = vectors(spark, [("2024", "a", [1.0, 2.0], ""), ("2024", "b", [1.0], ""), ("2025", "c", [3.0, 4.0], "")])
    assert rows(dominant_dim(df)) == [(2, 2)]
    assert rows(clean_vectors(df), "paper_id") == [("a",), ("c",)]
    assert rows(clean_vectors(df, 1), "paper_id") == [("b",)]
    assert rows(vector_manifest(df)) == [("m", "2024", 2, 2), ("m", "2025", 1, 2), ("m", "total", 3, 2)]
    ids = spark.createDataFrame([("a",), ("a",), ("z",)], "paper_id string")
    assert rows(lookup_by_id(df, ids), "paper_id") == [("a",)]


def test_wide_records(spark):
    df = spark.createDataFrame(
        [("1", "T", None, ["cs.AI", None], ["A", "B"], "2024-01-01", "2024-02-01", [1.0, 2.0], 3),
         ("2", None, "x", None, None, None, "u", None, 4)],
        "id string, title string, abstract string, categories array<string>, authors array<string>, "
        "created string, updated string, m1 array<double>, n int",
    )
    got = rows(reshape_metadata(df), "paper_id", "title", "categories", "primary_category", "authors", "doi")
    assert got == [("1", "T", "cs.AI", "cs.AI", "A;B", ""), ("2", None, "", "", "", "")]
    assert reshape_metadata(df).columns == schemas.METADATA_COLUMNS
    assert detect_vector_columns(df) == ["m1"] and missing_models(df, ["m1", "m9"]) == ["m9"]
    assert rows(unpivot_vectors(df), "model", "paper_id", "model_dim", "generated_at") == [
        ("m1", "1", 2, "2024-02-01"), ("m1", "2", None, "u")
    ]


def test_align_union(spark):
    old = spark.createDataFrame([("a", 1.0)], "paper_id string, x double")
    new = spark.createDataFrame([("b", None)], "paper_id string, source string")
    got = align_union(old, new, {"source": F.lit("s")})
    assert got.columns == ["paper_id", "x", "source"] and rows(got) == [("a", 1.0, "s"), ("b", None, None)]


def test_frame_validation(spark):
    df = spark.createDataFrame([("a",)], "paper_id string")
    ok = validate(df, "t", ["paper_id"])
    assert rows(ok) == [("t", "ok", "", False, None)]
    raise_on_error(ok)
    bad = validate(df.where("false"), "t", ["paper_id", "x"])
    assert rows(bad) == [("t", "error", "x", True, "missing columns: x; no rows produced")]
    with pytest.raises(ValueError, match="t validation failed"):
        raise_on_error(bad)
    assert validate(df.where("false"), "t", [], allow_empty=True).first()["status"] == "ok"


def test_summary_row_validation(spark):
    columns = ", ".join(f"{c} string" for c in schemas.SUMMARY_REQUIRED)
    items = [("summaries-2024-01", f"p{i}", None if i else "s", "t", "m", "s", "f") for i in range(5)]
    df = spark.createDataFrame(items, f"target string, {columns}")
    strict = validate_rows(df)
    assert strict.first()["message"] == "missing keys -> p1: summary, p2: summary, p3: summary"
    with pytest.raises(ValueError, match="summaries-2024-01"):
        raise_on_error(strict)
    assert validate_rows(df, strict=False).first()["status"] == "warning"
    assert validate_rows(df.where("id = 'p0'")).first()["status"] == "ok"


def test_job_metrics(spark):
    runs = [("j", "failure", "boom", 1.0, 2.0, 1.0, 1), ("j", "dry_run", None, 3.0, 3.0, 9.0, 2),
            ("k", "failure", "x", 1.0, 2.0, 1.0, 3), ("k", "success", None, 3.0, 5.0, 2.0, 4)]
    df = spark.createDataFrame(runs, "job string, status string, error string, start_time double, end_time double, duration double, seq int")
    got = {r.job: r for r in job_metrics(df).collect()}
    assert (got["j"].total_runs, got["j"].failure_count, got["j"].dry_run_count) == (2, 1, 1)
    assert (got["j"].last_status, got["j"].last_error, got["j"].last_duration_seconds) == ("dry_run", "boom", 0.0)
    assert (got["k"].last_status, got["k"].last_error, got["k"].last_duration_seconds) == ("success", None, 2.0)


def test_files(spark, folder):
    for name in ("include.txt", "skip.log", "sub/deep.log", "sub/keep.txt"):
        os.makedirs(os.path.dirname(f"{folder}/{name}"), exist_ok=True)
        with open(f"{folder}/{name}", "w") as f:
            f.write("12345")
    open(f"{folder}/empty.txt", "w").close()
    files = exclude_globs(list_files(spark, folder), ["*.log"])
    assert rows(file_manifest(files)) == [(3, 10)]
    assert rows(file_manifest(exclude_globs(files, ["*/sub/*"]))) == [(2, 5)]


def test_partition_values_are_text(spark, folder):
    df = spark.createDataFrame([("01", 1), ("1", 2), (None, 3), ("a b/c", 4)], "part string, n int")
    write_table(df, f"{folder}/t", partition_by=["part"])
    write_table(df, f"{folder}/t", partition_by=["part"])
    assert spark.read.parquet(f"{folder}/t").count() == 4
    write_table(spark.createDataFrame([("001", 5), ("1", 6)], "part string, n int"), f"{folder}/t", partition_by=["part"])
    assert rows(spark.read.parquet(f"{folder}/t"), "n") == [(1,), (2,), (3,), (4,), (5,)]


def test_clean_stored_vectors(spark, folder):
    items = [("m", "2024", "a", [1.0, 2.0]), ("m", "2024", "b", [1.0]), ("m", "2025", "c", [1.0, 2.0]), ("m", "2025", "d", None), ("n", "2024", "e", [1.0])]
    df = spark.createDataFrame(items, "model string, year string, paper_id string, embedding array<float>")
    df = df.withColumns({"generated_at": F.lit("t"), "model_dim": F.size("embedding"), "source": F.lit("s")})
    write_vectors(df, f"{folder}/in")
    want = [("2024", 1, 1, False), ("2024", 2, 1, True), ("2025", 2, 1, True), ("2025", None, 1, False)]
    report = clean_stored_vectors(spark, f"{folder}/in", "m", f"{folder}/out", dry_run=True)
    got = [(y, None if d == -1 else d, n, k) for y, d, n, k in rows(report, "year", "dim", "rows", "kept")]
    assert sorted(got, key=str) == sorted(want, key=str) and not os.path.exists(f"{folder}/out")
    clean_stored_vectors(spark, f"{folder}/in", "m", f"{folder}/out")
    assert rows(spark.read.parquet(f"{folder}/out"), "model", "paper_id") == [("m", "a"), ("m", "c")]
    assert rows(spark.read.json(f"{folder}/out/_manifest/m"), "year", "rows") == [("2024", 1), ("2025", 1), ("total", 2)]
    clean_stored_vectors(spark, f"{folder}/in", "m", f"{folder}/out", dim=1)
    assert spark.read.parquet(f"{folder}/out").count() == 2  # years that are there stay
    clean_stored_vectors(spark, f"{folder}/in", "m", f"{folder}/out", dim=1, force=True)
    assert rows(spark.read.parquet(f"{folder}/out"), "paper_id") == [("b",), ("c",)]
    with pytest.raises(ValueError, match="no vectors"):
        clean_stored_vectors(spark, f"{folder}/in", "absent", f"{folder}/out")


def test_retention_and_latest_run(spark):
    df = spark.createDataFrame([("d", i, f"f{i}") for i in range(5)] + [("e", 1, "g")], "dataset string, modified int, path string")
    assert rows(retention_plan(df, 3), "path") == [("f0",), ("f1",)]
    assert retention_plan(df, 0).count() == 6
    runs = spark.createDataFrame(
        [("2", "predictions.parquet"), ("2", "recommended.jsonl"), ("1", "recommended.parquet"), ("3", "x")],
        "run_id string, file string",
    )
    assert rows(latest_run(runs)) == [("2", "recommended.jsonl")]


def test_column_order_and_limit(spark):
    df = spark.createDataFrame([(1, 2, 3, 4), (0, 5, 6, 7)], "zeta int, summary int, alpha int, id int")
    assert order_summary_columns(df).columns == ["id", "summary", "alpha", "zeta"]
    assert rows(limit_ordered(df, ["zeta"], 1), "id") == [(7,)]


def test_write_guard(spark, folder):
    one, two = spark.range(1), spark.range(2)
    write_table(one, f"{folder}/t", dry_run=True)
    assert not os.path.exists(f"{folder}/t")
    write_table(one, f"{folder}/t")
    write_table(two, f"{folder}/t")
    assert spark.read.parquet(f"{folder}/t").count() == 1
    write_table(two, f"{folder}/t", overwrite=True)
    assert spark.read.parquet(f"{folder}/t").count() == 2
